"""A reply graph in the raw tweet layout, derived from a table of conversation turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BRAND = "brand"


def _piece_id(turn: Column, part: Column) -> Column:
    whole = F.col("conv_id").cast("decimal(26,0)") * F.lit(1000000).cast("decimal(7,0)")
    whole = (whole + turn.cast("decimal(20,0)")).cast("decimal(31,0)")
    whole = whole * F.lit(1000000).cast("decimal(7,0)")
    return (whole + part.cast("decimal(20,0)")).cast("decimal(38,0)").cast("string")


def conversation_graph(turns: DataFrame, star: bool = False) -> DataFrame:
    """Assistant turns are cut into one brand tweet per non-empty line.

    Every piece answers the piece before it. With ``star``, all lines of an assistant
    turn answer the turn before, so that one message has several replies. Turns count
    from 0 without gaps, so neighbours meet in a join on ``(conv_id, turn)``; no
    conversation is ever gathered in one task.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    some = F.when((F.col("role") == "assistant") & (F.size(lines) > 0), lines)
    pieces = turns.select(
        "conv_id", "turn", "role",
        F.coalesce(some, F.array(F.coalesce("text", F.lit("")))).alias("pieces"))
    sizes = pieces.select("conv_id", "turn", F.size("pieces").alias("n"))
    before = sizes.select("conv_id", (F.col("turn") + 1).alias("turn"),
                          F.col("n").alias("n_before"))
    after = sizes.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("n").alias("n_after"))
    rows = (
        pieces.join(before, ["conv_id", "turn"], "left")
        .join(after, ["conv_id", "turn"], "left")
        .select("*", F.posexplode_outer("pieces").alias("part", "piece"))
    )
    last = F.col("part") == F.size("pieces") - 1
    up_turn = F.when(F.col("n_before").isNotNull(),
                     _piece_id(F.col("turn") - 1, F.col("n_before") - 1))
    down_turn = F.when(F.col("n_after").isNotNull(), _piece_id(F.col("turn") + 1, F.lit(0)))
    inner_up = F.when(F.col("part") > 0, _piece_id(F.col("turn"), F.col("part") - 1))
    inner_down = F.when(~last, _piece_id(F.col("turn"), F.col("part") + 1))
    return rows.select(
        _piece_id(F.col("turn"), F.col("part")).alias("tweet_id"),
        F.when(F.col("role") == "assistant", BRAND).otherwise(F.col("role")).alias("author_id"),
        (F.col("role") == "user").alias("inbound"),
        F.lit(None).cast("string").alias("created_at"),
        F.col("piece").alias("text"),
        (down_turn if star else F.coalesce(inner_down, down_turn)).alias("response_tweet_id"),
        (up_turn if star else F.coalesce(inner_up, up_turn)).alias("in_response_to_tweet_id"),
    )
