"""Reading structured answers out of free model text, with fall-backs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.context import shortened
from colloquy.functions.text import strip

DEFAULT_SCORE = 3


def _object(raw: Column) -> Column:
    """The answer as a variant when it is a JSON object, else null."""
    value = F.try_parse_json(strip(raw))
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def _field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "string")


def read_intent(raw: Column, intents: Sequence[str], default: str = "other") -> tuple[Column, Column]:
    """``(intent, confidence)``: the JSON fields, or the first intent named in the text."""
    value = _object(raw)
    stated = _field(value, "intent")
    text = F.lower(F.coalesce(raw, F.lit("")))
    named = F.coalesce(*[F.when(F.contains(text, F.lit(i)), F.lit(i)) for i in intents],
                       F.lit(default))
    known = F.when(stated.isin(*intents), stated).otherwise(F.lit(default))
    return (
        F.when(value.isNotNull(), known).otherwise(named),
        F.when(value.isNotNull(), _field(value, "confidence")).otherwise(F.lit("low")),
    )


def read_decision(raw: Column, reason_chars: int | None = None) -> tuple[Column, Column]:
    """``(decision, reason)``: the JSON fields, or whether the text says "escalate".

    The reason is then the text itself, cut to ``reason_chars`` where that is given.
    """
    value = _object(raw)
    stated = _field(value, "decision")
    text = F.coalesce(raw, F.lit(""))
    said = F.when(F.contains(F.lower(text), F.lit("escalate")), "escalate").otherwise("auto")
    known = F.when(stated.isin("auto", "escalate"), stated).otherwise(F.lit("auto"))
    return (
        F.when(value.isNotNull(), known).otherwise(said),
        F.when(value.isNotNull(), _field(value, "reason")).otherwise(shortened(text, reason_chars)),
    )


def read_score(raw: Column) -> tuple[Column, Column]:
    """``(score, reason)`` with the score cut to an integer and clamped to 1..5.

    A missing score counts as the default. A score that is no number, or an answer that
    is no JSON object, gives the default and the reason "parse error".
    """
    value = _object(raw)
    score = F.try_variant_get(value, "$.score", "variant")
    kind = F.schema_of_variant(score)
    text = _field(value, "score")
    number = (
        F.when(kind == "STRING", F.when(strip(text).rlike(r"^[+-]?\d+$"),
                                        strip(text).try_cast("double")))
        .when(kind == "BOOLEAN", F.when(text == "true", 1.0).otherwise(0.0))
        .otherwise(text.try_cast("double"))
    )
    cut = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))
    clamped = F.when(cut.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(5), cut))).cast("int")
    missing = value.isNotNull() & score.isNull()
    return (
        F.when(missing, DEFAULT_SCORE).otherwise(F.coalesce(clamped, F.lit(DEFAULT_SCORE))),
        F.when(missing | clamped.isNotNull(),
               F.coalesce(_field(value, "reason"), F.lit(""))).otherwise(F.lit("parse error")),
    )
