"""A stored vector table whose cells are folders, and exact top-k that reads few of them.

Vectors lie in the folder of their nearest pivot, with their payload. A small table keeps every
cell's pivot and its range of angles. A search reads the cells nearest to its queries, takes
the k-th best score there as a bound, and then reads only cells that can hold something as good
by the triangle inequality on the unit sphere. Both reads carry partition filters, so other
folders are never opened.

Null vectors are not stored. Zero vectors have a cell of their own and score 0. Ties go to the
lowest id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.vectors import unit
from colloquy.operators.vector_topk import BLOCK_ROWS, blocks_topk, nearest_cell, pivot_vectors, visits
from colloquy.session import materialise


def write_cells(vectors: DataFrame, path: str, *, id_col: str = "vec_id", vec_col: str = "embedding",
                payload: Sequence[str] = (), cells: int | None = None) -> None:
    """Stores ``d``, ``vec`` (unit length) and the payload, one folder per cell.

    ``cells`` is the square root of the number of vectors unless given.
    """
    rows = vectors.where(F.col(vec_col).isNotNull()).select(
        F.col(id_col).alias("d"), unit(F.col(vec_col)).alias("vec"), F.struct(*payload).alias("payload")
        if payload else F.lit(None).cast("string").alias("payload"))
    rows = materialise(rows, "vectors")
    pivots = pivot_vectors(rows, cells or max(1, math.ceil(math.sqrt(rows.count()))))
    if not len(pivots):
        first = rows.select("vec").first()
        pivots = np.eye(1, len(first["vec"]) if first else 1)
    placed = materialise(nearest_cell(rows, pivots), "cells")
    # Each folder gets few files: rows are dealt by cell, a large cell over several tasks.
    sizes = placed.groupBy("cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"),
                                       F.count(F.lit(1)).alias("n"))
    (placed.join(sizes.select("cell", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("subs")), "cell")
     .withColumn("sub", F.pmod(F.xxhash64("d"), F.col("subs")).cast("int"))
     .repartition("cell", "sub").select("d", "vec", "payload", "sub", "cell")
     .write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows"))
    spark = vectors.sparkSession
    known = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(pivots)],
                                  "cell int, pivot array<double>")
    sizes.join(known, "cell", "left").write.mode("overwrite").parquet(f"{path}/cells")


def read_cells(spark: SparkSession, path: str, cells: Sequence[int] | None = None) -> DataFrame:
    """The stored rows, or those of some cells."""
    rows = spark.read.parquet(f"{path}/rows")
    return rows if cells is None else rows.where(F.col("cell").isin([int(c) for c in cells]))


def _blocks(rows: DataFrame) -> DataFrame:
    return rows.select("d", "vec", _name(F.col("cell"), F.col("sub")).alias("block"))


def _name(cell: Column, sub: Column) -> Column:
    return F.concat_ws("-", cell.cast("string"), sub.cast("string"))


def _first_cells(asked: DataFrame, known: pd.DataFrame, places: np.ndarray, pivots: np.ndarray,
                 keep: int) -> DataFrame:
    """``(q, cell)``: the nearest cells of each query that together hold ``keep`` vectors."""
    shared = asked.sparkSession.sparkContext.broadcast((known, places, pivots))  # one row per cell

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, places, pivots = shared.value
        sizes = known.set_index("cell")["n"]
        rest = [c for c in known["cell"].tolist() if c not in set(places.tolist())]
        for batch in batches:
            q, cells = [], []
            for key, vec in zip(batch["q"].tolist(), batch["vec"], strict=True):
                order = places[np.argsort(-(pivots @ vec), kind="stable")].tolist() if len(places) else []
                held = 0
                for cell in [*order, *rest] if np.any(vec) else [*rest, *order]:
                    if held >= keep:
                        break
                    q.append(key)
                    cells.append(cell)
                    held += int(sizes[cell])
            yield pd.DataFrame({"q": pd.Series(q, dtype=batch["q"].dtype), "cell": pd.Series(cells, dtype="int32")})

    return asked.select("q", "vec").mapInPandas(run, T.StructType([asked.schema["q"], T.StructField("cell", T.IntegerType())]))


def stored_topk(spark: SparkSession, path: str, queries: DataFrame, *, k: int = 3, query_id: str = "query_id",
                query_vec: str = "embedding", exclude_self: bool = False) -> tuple[DataFrame, set[int]]:
    """``(query_id, rank, neighbour_id, score)`` over a stored table, and the cells that were read."""
    keep = k + 1 if exclude_self else k
    known = spark.read.parquet(f"{path}/cells").toPandas().sort_values("cell")  # one row per cell
    owned = materialise(queries.where(F.col(query_vec).isNotNull()).select(
        F.col(query_id).alias("query_id"), F.col(query_vec).alias("raw")), "queries")
    if known.empty:
        none = owned.limit(0).select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("neighbour_id"),
                                     F.lit(0.0).alias("score"))
        return none, set()
    owners = owned.groupBy("raw").agg(F.min("query_id").alias("q"))
    asked = materialise(owners.select("q", unit(F.col("raw")).alias("vec")), "asked")
    full = known[known["pivot"].notna()]  # all but the cell of zero vectors
    places = full["cell"].to_numpy()
    pivots = np.stack(full["pivot"].to_list()) if len(full) else np.zeros((0, 1))
    homes = materialise(_first_cells(asked, known, places, pivots, keep), "homes")
    subs = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    sizes = spark.read.parquet(f"{path}/cells").select("cell", subs.alias("subs"))

    def search(wanted: DataFrame) -> tuple[DataFrame, set[int]]:
        cells = {r["cell"] for r in wanted.select("cell").distinct().collect()}  # at most one per cell
        blocks = _blocks(read_cells(spark, path, sorted(cells)))
        asks = wanted.join(sizes, "cell").withColumn(
            "sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).select(
            "q", _name(F.col("cell"), F.col("sub")).alias("block"))
        return materialise(blocks_topk(asks, asked, blocks, keep, BLOCK_ROWS), "found"), cells

    near, read = search(homes)
    place = Window.partitionBy("q").orderBy(F.col("score").desc(), "d")
    best = near.withColumn("place", F.row_number().over(place)).where(F.col("place") <= keep)
    bounds = best.groupBy("q").agg(F.when(F.count(F.lit(1)) >= keep, F.min("score")).alias("bound"))
    bounded = asked.join(bounds, "q", "left").withColumn("bound", F.coalesce("bound", F.lit(-1.0)))
    first = asked.first()
    matrix = np.zeros((max(1, int(known["cell"].max()) + 1), len(first["vec"]) if first else 1))
    if len(places):
        matrix[places] = pivots
    onward = materialise(visits(bounded, matrix, known[["cell", "low", "high"]]).join(
        homes, ["q", "cell"], "left_anti"), "visits")
    more, also = search(onward)
    top = near.unionByName(more)
    rows = owned.join(owners, "raw").join(top, "q").select("query_id", "score", F.col("d").alias("neighbour_id"))
    if exclude_self:
        rows = rows.where(F.col("neighbour_id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "neighbour_id")
    return (rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "neighbour_id", "score"), read | also)
