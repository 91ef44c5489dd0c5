"""CSV with line breaks inside quoted fields, read by many tasks per file.

A line break ends a record where the number of quotes before it is even. Every task counts the
quotes of its byte range, prefix sums over the ranges of a file tell which of them begin
inside a quoted field, and then each range cuts its own records. What is open at the end of a
range and what closes it in a later one are the only lines that move, at most two per range.

Line breaks inside fields stay as they are written. Quotes inside a field must be doubled and the field quoted, as writers do; a lone quote inside
a bare field would shift the count (the plain multi-line reader is there for such files).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.session import materialise

WHOLE, CLOSES, OPEN = 0, 1, 2  # a record, the rest of an earlier one, the beginning of a later one
PIECE = "file string, start long, kind int, first boolean, record string"
OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true"}


def _cut(inside: dict[str, set[int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(value, file, start) lines in file order to records and pieces of records."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, kind, first = None, [], WHOLE, False

        def close(out: list[tuple]) -> None:
            """A range that ends inside quotes leaves an open piece; one that never left them, a middle."""
            if now is not None and held:
                out.append((*now, kind if kind == CLOSES else OPEN, first, "\n".join(held)))

        for batch in batches:
            quotes = pc.count_substring(batch.column(0), '"').to_numpy(zero_copy_only=False)
            files, starts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            lines, out = batch.column(0).to_pylist(), []
            odd = (quotes % 2 == 1).tolist()
            for line, flips, file, start in zip(lines, odd, files, starts, strict=True):
                if now != (file, start):
                    close(out)
                    now, held, first = (file, start), [], start == 0
                    kind = CLOSES if start in inside.get(file, ()) else WHOLE
                    quoted = kind == CLOSES
                held.append(line)
                quoted ^= flips
                if not quoted:
                    out.append((file, start, kind, first, "\n".join(held)))
                    held, kind, first = [], WHOLE, False
            yield _piece_batch(out)
        out = []
        close(out)
        yield _piece_batch(out)
    return run


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in PIECE.split(", ")])


def _ranges_inside_quotes(lines: DataFrame) -> dict[str, set[int]]:
    """The byte ranges that begin inside a quoted field; at most one entry per range of the scan."""
    n = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    ranges = lines.groupBy("file", "start").agg(F.sum(n).alias("n"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    odd = ranges.withColumn("before", F.sum("n").over(earlier)).where(F.pmod("before", F.lit(2)) == 1)
    out: dict[str, set[int]] = {}
    for r in odd.select("file", "start").toLocalIterator():
        out.setdefault(r["file"], set()).add(r["start"])
    return out


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(first, record): every record as text; ``first`` marks the first one of a file."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    pieces = lines.mapInArrow(_cut(_ranges_inside_quotes(lines)), PIECE)
    whole = pieces.where(F.col("kind") == WHOLE).select("first", "record")
    order = Window.partitionBy("file").orderBy("start", "kind")
    broken = materialise(pieces.where(F.col("kind") != WHOLE), "csv-pieces").withColumn(
        "number", F.sum((F.col("kind") == OPEN).cast("int")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("start", "kind", "record")))
    joined = broken.groupBy("file", "number").agg(
        F.max("first").alias("first"), F.array_join(parts["record"], "\n").alias("record"))
    return whole.unionByName(joined.select("first", "record"))


def read_split_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """Rows of CSV files in which one file is read by as many tasks as it has byte ranges."""
    rows = csv_records(spark, path)
    if header:
        rows = rows.where(~F.col("first"))
    bare = F.regexp_replace("record", "\r$", "")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    parsed = F.from_csv(bare, fields, OPTIONS)
    return rows.where(bare != "").select(parsed.alias("_row")).select(
        *[F.col(f"_row.`{f.name}`").alias(f.name) for f in schema])
