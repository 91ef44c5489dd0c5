"""Exact dedup in two passes over a Bloom filter.

Pass one sets bits for the hash of every text and keeps the bits that two rows or more have
set. A text that occurs twice finds all its bits among them; a row that misses one is unique
and passes straight through. Only the other rows are shuffled and compared by SHA-256, so a
false hit costs a shuffled row, never a wrong answer.

The filter's size follows the row count up to ``max_filter_mb``, which bounds what is
broadcast; beyond that more rows shuffle and results stay the same.

Null texts equal empty ones. Of equal texts the row with the largest id stays, null ids lowest;
of repeated rows with that id one stays. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.bloom import MAX_FILTER_MB, build_filter, filter_blocks, apply_filter
from colloquy.llm.common import ROW, carry
from colloquy.session import materialise

def flag_repeats(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None,
                 max_filter_mb: int = MAX_FILTER_MB) -> DataFrame:
    """Rows with ``text`` (null as empty) and ``maybe``: false only where no other row is equal."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    blocks = filter_blocks(docs.count(), max_filter_mb)
    filters = build_filter(docs.select(F.xxhash64(text).alias("h")), blocks, times=2)
    rows = carry(docs, keep, text=text, h=F.xxhash64(text))
    return apply_filter(rows, "h", filters, blocks, "maybe").drop("h")


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                max_filter_mb: int = MAX_FILTER_MB) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns.

    Copies are reduced to one row inside each map task before the shuffle, so a text that a
    third of all rows share costs one row per task.
    """
    rows = flag_repeats(docs, text_col, max_filter_mb=max_filter_mb)
    key = F.col(ROW)[id_col]
    passed = rows.where(~F.col("maybe")).select(ROW)
    reduced = (rows.where("maybe").groupBy(F.sha2("text", 256).alias("sha"))
               .agg(F.max_by(ROW, F.struct(key.isNotNull(), key)).alias(ROW)).select(ROW))
    return passed.unionByName(reduced).select(f"{ROW}.*")


def copy_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                max_filter_mb: int = MAX_FILTER_MB) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    flagged = flag_repeats(docs, text_col, [id_col], max_filter_mb)
    rows = materialise(flagged.select(
        F.col(ROW)[id_col].alias("doc_id"), "maybe", F.sha2("text", 256).alias("text_sha256")),
        "text-hashes")
    passed = rows.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    same = rows.where("maybe").groupBy("text_sha256", "doc_id").agg(F.count("*").alias("n"))
    groups = materialise(same.groupBy("text_sha256").agg(
        F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")), "copy-groups")
    members = same.join(groups, "text_sha256")
    copies = members.select(
        "doc_id", "keep_id", "group_size", "text_sha256",
        F.posexplode(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("nth", "_"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 0)
    return passed.unionByName(copies.select(
        "doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256"))
