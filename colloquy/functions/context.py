"""Prior turns of a thread: predicates and prompt blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CONTEXT_TURNS = 4
TRIED_MIN_CHARS = 20
CUSTOMER_ROLE = "Customer"


def has_context(turns: Column) -> Column:
    return F.coalesce(F.size(turns) > 0, F.lit(False))


def last_turns(turns: Column, n: int = CONTEXT_TURNS) -> Column:
    return F.slice(turns, F.greatest(F.size(turns) - (n - 1), F.lit(1)), F.lit(n))


def _from_brand(turn: Column) -> Column:
    return ~F.coalesce(turn["inbound"], F.lit(True))


def shortened(text: Column, chars: int | None) -> Column:
    """The text, or its first ``chars`` characters; null is empty."""
    whole = F.coalesce(text, F.lit(""))
    return whole if chars is None else F.substring(whole, 1, chars)


def context_block(turns: Column, brand_role: str, n: int | None = CONTEXT_TURNS,
                  chars: int | None = None) -> Column:
    """The last ``n`` turns (None: all) as ``  Role: text`` lines; empty without turns.

    ``chars`` cuts each text to its first characters.
    """
    lines = F.transform(
        turns if n is None else last_turns(turns, n),
        lambda t: F.concat(
            F.lit("  "),
            F.when(_from_brand(t), F.lit(brand_role)).otherwise(F.lit(CUSTOMER_ROLE)),
            F.lit(": "),
            shortened(t["text"], chars),
        ),
    )
    return F.coalesce(F.array_join(lines, "\n"), F.lit(""))


def tried_steps(turns: Column, chars: int | None = None) -> Column:
    """What the brand already suggested, over all turns, as ``  - text`` lines."""
    told = F.filter(
        turns, lambda t: _from_brand(t) & (F.length(t["text"]) > TRIED_MIN_CHARS))
    lines = F.transform(told, lambda t: F.concat(F.lit("  - "), shortened(t["text"], chars)))
    return F.coalesce(F.array_join(lines, "\n"), F.lit(""))
