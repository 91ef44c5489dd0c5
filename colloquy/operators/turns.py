"""The rolling buffer of the last turns before each turn of a conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUFFER_TURNS = 6
CHUNK_TURNS = 100_000


def rolling_buffer(turns: DataFrame, conv: str, order: str, *columns: str,
                   size: int = BUFFER_TURNS, chunk: int = CHUNK_TURNS) -> DataFrame:
    """``turns`` with ``buffer``: the last ``size`` turns before it, oldest first.

    A conversation is cut into chunks by its numeric order column, so a very long one is
    worked on by many tasks. Each chunk starts from the last turns of the chunks before
    it; every chunk that exists has at least one turn, so ``size`` chunks back suffice.
    """
    entry = F.struct(F.col(order).alias("at"), F.struct(*columns).alias("turn"))
    rows = turns.withColumn("_chunk", F.floor(F.col(order) / chunk))
    inside = Window.partitionBy(conv, "_chunk").orderBy(order)
    local = rows.withColumn("_own", F.collect_list(entry).over(inside.rowsBetween(-size, -1)))

    latest = Window.partitionBy(conv, "_chunk").orderBy(F.col(order).desc())
    ends = (
        rows.withColumn("_place", F.row_number().over(latest)).where(F.col("_place") <= size)
        .groupBy(conv, "_chunk").agg(F.array_sort(F.collect_list(entry)).alias("_end"))
    )
    back = Window.partitionBy(conv).orderBy("_chunk").rowsBetween(-size, -1)
    carried = ends.select(
        conv, "_chunk", F.flatten(F.collect_list("_end").over(back)).alias("_carried"))
    seen = F.concat("_carried", "_own")
    start = F.greatest(F.size(seen) - (size - 1), F.lit(1))
    carried = carried.select(F.col(conv).alias("_of"), F.col("_chunk").alias("_at"), "_carried")
    own = F.col(conv).eqNullSafe(F.col("_of")) & F.col("_chunk").eqNullSafe(F.col("_at"))
    return (
        local.join(carried, own)
        .withColumn("buffer", F.slice(seen, start, F.lit(size))["turn"])
        .drop("_chunk", "_own", "_carried", "_of", "_at")
    )
