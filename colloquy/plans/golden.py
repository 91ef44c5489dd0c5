"""From threads to a sample for hand labelling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.rules import INTENT_PATTERNS, first_match
from colloquy.operators.sampling import blank_labels, golden_sample, shuffled

SEED = 2024


def golden_set(threads: DataFrame, rules: Mapping[str, Sequence[str]] = INTENT_PATTERNS,
               seed: int = SEED) -> DataFrame:
    """A stratified sample of threads in random order with blank label columns."""
    rows = threads.dropna(subset=["customer_text", "brand_reply"]).withColumn(
        "keyword_intent", first_match(F.col("customer_text"), rules))
    picked = golden_sample(rows, "keyword_intent", "thread_id", seed)
    return shuffled(blank_labels(picked), seed, "thread_id").select(
        "thread_id", "customer_text", "brand_reply", "suggested_intent", "escalated",
        "intent", "should_escalate", "reply_quality")
