"""Column helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed patterns: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_BREAK = r"[\x20\x09-\x0D]+"
ASCII_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"

ROW = "_row"  # carries the caller's columns, whatever their names
BATCH_ROWS = 1_000  # rows per Arrow batch handed to Python


def carry(docs: DataFrame, columns: Iterable[str] | None = None, **named: Column) -> DataFrame:
    """``named`` columns next to one struct with the caller's, so names cannot clash."""
    kept = [f"`{c}`" for c in (docs.columns if columns is None else columns)]
    return docs.select(F.struct(*kept).alias(ROW), *[c.alias(n) for n, c in named.items()])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(ASCII_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, WORD_BREAK))


def count_words(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds what one Python worker holds of a table of long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
