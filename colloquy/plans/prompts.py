"""Prompt texts as column expressions over caller-supplied templates."""

from __future__ import annotations

from dataclasses import dataclass
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.context import CONTEXT_TURNS


def render(template: str, **fields: Column) -> Column:
    """The template with each ``{name}`` replaced by a column; null counts as empty."""
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name:
            parts.append(F.coalesce(fields[name], F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def section(template: str, block: Column) -> Column:
    """The template filled with ``{block}``, or nothing when the block is empty."""
    return F.when(F.coalesce(block, F.lit("")) != "", render(template, block=block)).otherwise("")


@dataclass(frozen=True)
class Templates:
    """Wording of the prompts; replace any of it to suit the model."""

    brand_role: str = "Support"
    # What goes into a prompt: None takes all turns, or whole texts.
    context_turns: int | None = CONTEXT_TURNS
    turn_chars: int | None = None
    tried_chars: int | None = None
    example_chars: int | None = None
    reason_chars: int | None = None
    classify_system: str = "Name the intent of a support message. Answer in JSON."
    classify: str = "{context}Message:\n{text}"
    draft_system: str = "Write a support reply in the manner of the examples."
    draft: str = "Intent: {intent}\n{context}{tried}Similar cases:\n{examples}\n\nMessage:\n{text}"
    decide_system: str = "Decide between auto and escalate. Answer in JSON."
    decide: str = "Intent: {intent}\n{context}Message:\n{text}\nDraft:\n{draft}"
    judge_system: str = "Score a support reply from 1 to 5. Answer in JSON."
    judge: str = "Message:\n{text}\nReply:\n{reply}"
    context: str = "Earlier turns:\n{block}\n"
    tried: str = "Already suggested:\n{block}\n"
    example: str = "Case {n}:\n  Customer: {customer}\n  {role}: {reply}"
