"""Token ids as Parquet list columns that can be read in part.

Ids are dictionary encoded while the dictionary of a row group holds them and delta encoded
beyond that (version 2 pages); row groups and pages have set sizes, and page indexes are
written, so a range of ids skips row groups and pages, and a read of counts touches no token.

Null texts are empty and hold the end id only; null ids come first; ties are ordered by the
hash of the text. An empty table gives files without rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.llm.common import small_batches
from colloquy.llm.tokens import ENCODED, END_ID, encode_batches
from colloquy.session import materialise

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
ENCODED_ROWS = 300  # texts encoded at a time
LAYOUT = "doc_id long, part int, local long, n_tokens long, ids array<int>"


def parquet_options(row_group: int = ROW_GROUP_BYTES, page: int = PAGE_BYTES) -> dict[str, str]:
    """Writer options: encodings, row groups, pages and their checksums."""
    return {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0",
            "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20),
            "parquet.block.size": str(row_group), "parquet.page.size": str(page),
            "parquet.page.write-checksum.enabled": "true"}


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID, *,
                     id_col: str = "doc_id", text_col: str = "text", packed: bool = False) -> DataFrame:
    """(doc_id, part, local, n_tokens, ids) in the order in which tasks read ``docs``."""
    small_batches(docs.sparkSession, ENCODED_ROWS)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").alias("doc_id"))
    return rows.mapInArrow(encode_batches(tokenizer, end_id, packed),
                           f"doc_id {kind}, {ENCODED}{'binary' if packed else 'array<int>'}")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, *,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of every text in ascending id order, one range of ids per file.

    Equal ids are dealt by the hash of their text, so that no id fills one file alone.
    """
    text, key = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    rows = docs.select(key.alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    encode_documents(ordered, tokenizer, end_id).write.options(**parquet_options()).parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: Column | None = None,
                columns: tuple[str, ...] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """Selected columns of the documents that meet a condition on ``doc_id``."""
    rows = spark.read.parquet(path)
    return (rows if ids is None else rows.where(ids)).select(*columns)


def part_starts(rows: DataFrame) -> DataFrame:
    """(part, before): the ids in all earlier parts; one row per written part."""
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return materialise(totals.select(
        "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "part-starts")


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens) of every document, from the count columns only."""
    rows = read_tokens(spark, path, columns=("doc_id", "part", "local", "n_tokens"))
    return rows.join(part_starts(rows), "part").select(
        "doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens")


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """The index with the crc32 of each document's ids, read back from the files."""
    def digest(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        for batch in batches:
            lists = batch.column(4)
            values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<u4")
            at = lists.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), pa.array(crc, pa.int64())],
                names=["doc_id", "part", "local", "n_tokens", "ids_crc32"])

    small_batches(spark)
    rows = read_tokens(spark, path, columns=("doc_id", "part", "local", "n_tokens", "ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    crc = rows.mapInArrow(digest, f"doc_id {kind}, part int, local long, n_tokens long, ids_crc32 long")
    starts = part_starts(read_tokens(spark, path, columns=("part", "n_tokens")))
    return crc.join(starts, "part").select(
        "doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
