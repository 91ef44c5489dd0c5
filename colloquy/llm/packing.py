"""Packing by concatenate and cut.

Pass one encodes every document and writes the ids with their offset inside the writing task.
The totals of all parts, summed in order, turn that into a global offset. Pass two cuts the
stream at every multiple of the sequence length: a document that crosses a cut becomes several
pieces, and a piece needs nothing but its own row, also where a sequence begins in one part
and ends in another. Only the last sequence can need padding.

Null texts are empty and hold the end id only. Null and repeated ids are documents like any
other. An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import small_batches
from colloquy.llm.token_files import encode_documents, part_starts
from colloquy.llm.tokens import END_ID
from colloquy.session import scratch_path

SEQUENCE = 2_048


def _packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of packed ids, and where each row's begin."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    values = np.frombuffer(raw, "<u4", offset=int(at[0])) if raw is not None and len(column) else np.zeros(0, "<u4")
    return values, (at - at[0]) // 4 if len(column) else np.zeros(1, np.int64)


def _cut(length: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib
        for batch in batches:
            values, at = _packed(batch.column(batch.schema.get_field_index("ids")))
            sizes = at[1:] - at[:-1]
            begin = batch.column(batch.schema.get_field_index("begin")).to_numpy()
            first, last = begin // length, (begin + sizes - 1) // length
            counts = np.where(sizes > 0, last - first + 1, 0)
            row = np.repeat(np.arange(len(sizes)), counts)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            sequence = first[row] + nth
            start = np.maximum(sequence * length - begin[row], 0)
            end = np.minimum((sequence + 1) * length - begin[row], sizes[row])
            slices = [values[a:b] for a, b in zip(at[row] + start, at[row] + end, strict=True)]
            out = [batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(row)),
                   pa.array(start), pa.array(end - start),
                   pa.array([zlib.crc32(x) for x in slices], pa.int64()), pa.array(sizes[row]),
                   pa.array(sequence), pa.array(begin[row] + start - sequence * length)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                edges = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
                kept = np.concatenate(slices) if slices else np.zeros(0, "<u4")
                out.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(kept.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)
    return run


def pack(docs: DataFrame, tokenizer: str, *, length: int = SEQUENCE, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``with_ids`` adds the ids of the piece; grouping by ``sequence_id`` and ordering by
    ``offset`` gives the sequences.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "packed")
    encode_documents(docs, tokenizer, end_id, id_col=id_col, text_col=text_col, packed=True).write.option(
        "compression", "zstd").parquet(path)
    rows = spark.read.parquet(path)
    placed = rows.join(part_starts(rows.select("part", "n_tokens")), "part").select(
        "doc_id", (F.col("before") + F.col("local")).alias("begin"), "ids")
    small_batches(spark)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
              "sequence_id long, offset long") + (", ids array<int>" if with_ids else "")
    return placed.mapInArrow(_cut(length, with_ids), schema)
