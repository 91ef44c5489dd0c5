"""How closely a draft follows the replies it was given as examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.vectors import cosine


def source_vectors(drafts: DataFrame, replies: DataFrame, draft_id: str, sources: str,
                   reply_id: str = "thread_id", vec: str = "embedding") -> DataFrame:
    """``(draft_id, source_id, source_vec)``: listed sources that exist; unknown ids drop out."""
    listed = drafts.select(draft_id, F.explode(sources).alias("source_id"))
    known = replies.select(F.col(reply_id).alias("source_id"), F.col(vec).alias("source_vec"))
    return listed.join(known, "source_id").select(draft_id, "source_id", "source_vec")


def grounding_scores(drafts: DataFrame, replies: DataFrame, *, draft_id: str, draft_vec: str,
                     sources: str, reply_id: str = "thread_id", vec: str = "embedding",
                     draft_text: str | None = None) -> DataFrame:
    """``(draft_id, n_sources, grounding)``: mean cosine of a draft to its sources.

    0 for a draft without known sources, and for a blank one if ``draft_text`` is given.
    """
    pairs = source_vectors(drafts, replies, draft_id, sources, reply_id, vec)
    scored = (
        pairs.join(drafts.select(draft_id, draft_vec), draft_id)
        .groupBy(draft_id)
        .agg(F.count(F.lit(1)).alias("n_sources"),
             F.avg(cosine(F.col(draft_vec), F.col("source_vec"))).alias("mean"))
    )
    out = drafts.join(scored, draft_id, "left")
    mean = F.coalesce("mean", F.lit(0.0))
    if draft_text:
        mean = F.when(F.trim(F.coalesce(draft_text, F.lit(""))) == "", 0.0).otherwise(mean)
    return out.select(draft_id, F.coalesce("n_sources", F.lit(0)).alias("n_sources"),
                      mean.alias("grounding"))
