"""Packing by sums of squares: few sequences, and no document cut without need.

Only documents longer than a sequence are cut, into full pieces; the first piece takes what is
left over. A full piece is a sequence of its own. All other pieces are dealt by a hash into
groups of a bounded number of pieces, and every group is packed on its own, the longest pieces
first: a piece goes to the open sequence for which the sum over all fill levels of (number of
open sequences at that level) squared becomes smallest, the fuller one on ties, and a new
sequence begins only when it fits in none. A group wastes about one sequence in six thousand.

Null texts are empty and hold the end id only. Null and repeated ids are documents like any
other. A text of any length is a row of pieces. An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import small_batches
from colloquy.llm.packing import SEQUENCE
from colloquy.llm.tokens import encode_batches
from colloquy.session import materialise

END_ID = 0
ENCODE_ROWS = 300  # texts encoded at a time
GROUP_PIECES = 16_384  # pieces packed together
NO_PLACE = np.int64(1) << 60


def piece_lengths(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, number, length) of every piece of documents of these sizes."""
    counts = -(-sizes // length)
    doc = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = sizes - (counts - 1) * length
    return doc, nth, np.where(nth == 0, first[doc], length)


def _cut(path: str, length: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    encode = encode_batches(path, end_id, packed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in encode(batches):
            ids, part, local, sizes = (batch.column(batch.schema.get_field_index(c))
                                       for c in ("ids", "part", "local", "n_tokens"))
            sizes = sizes.to_numpy()
            doc, nth, n = piece_lengths(sizes, length)
            ends = np.cumsum(n)
            begins = ends - n
            start = begins - np.repeat(begins[nth == 0], np.bincount(doc, minlength=len(sizes)))
            raw = ids.buffers()[2]
            lists = pa.Array.from_buffers(pa.binary(), len(n), [
                None, pa.py_buffer((4 * np.append(0, ends)).astype(np.int32)), raw])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), part.take(pa.array(doc)),
                 pa.array(local.to_numpy()[doc] + start), pa.array(nth.astype(np.int32)), pa.array(start),
                 pa.array(n), pa.array(sizes[doc]), lists],
                names=["doc_id", "part", "begin", "piece", "start", "length", "doc_tokens", "ids"])
    return run


def cut_pieces(docs: DataFrame, tokenizer: str, *, length: int = SEQUENCE, end_id: int = END_ID,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written pieces of all documents.

    Columns: doc_id, part and begin (writing task and ids before the piece in it: the key of a
    piece), piece, start, length, doc_tokens, ids (little-endian unsigned 32-bit).
    """
    small_batches(docs.sparkSession, ENCODE_ROWS)
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").alias("doc_id"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return materialise(rows.mapInArrow(
        _cut(tokenizer, length, end_id),
        f"doc_id {kind}, part int, begin long, piece int, start long, length long, doc_tokens long, "
        "ids binary"), "pieces")


def sum_of_squares(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces shorter than ``length``, placed in the given order.

    With N(h) open sequences filled to h, moving one from h to h + s changes the sum of squares
    by 2 (N(h + s) - N(h) + 1), or by 1 - 2 N(h) when it becomes full and is open no more.
    """
    level = np.zeros(length + 1, dtype=np.int64)  # open sequences by fill; full ones are not counted
    waiting: list[list[int]] = [[] for _ in range(length)]
    sequence = np.empty(len(sizes), dtype=np.int64)
    offset = np.empty(len(sizes), dtype=np.int64)
    opened = 0
    for i, s in enumerate(sizes.tolist()):
        last = length - s
        change = 2 * (level[s:] - level[:last + 1] + 1)
        change[last] -= 1
        change[level[:last + 1] == 0] = NO_PLACE
        h = last - int(change[::-1].argmin())
        if level[h]:
            level[h] -= 1
            sequence[i] = waiting[h].pop()
        else:
            h, sequence[i] = 0, opened
            opened += 1
        offset[i] = h
        if h + s < length:
            level[h + s] += 1
            waiting[h + s].append(int(sequence[i]))
    return sequence, offset


def _pack_group(length: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("part", "ascending"), ("begin", "ascending")])
        sequence, offset = sum_of_squares(group["length"].to_numpy(), length)
        first = np.int64(group["group"][0].as_py()) << 32
        return pa.table({"part": group["part"], "begin": group["begin"],
                         "sequence_id": pa.array(first + sequence), "offset": pa.array(offset)})
    return run


def place_pieces(pieces: DataFrame, *, length: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` instead of their key.

    Needs part, begin and length; whatever else a piece carries comes back with it.
    """
    spark = pieces.sparkSession
    short = pieces.where(F.col("length") < length).select("part", "begin", "length")
    groups = max(1, -(-short.count() // group_pieces))
    dealt = short.withColumn("group", F.pmod(F.xxhash64("part", "begin"), F.lit(groups)))
    placed = materialise(
        dealt.repartition(groups, "group").groupBy("group").applyInArrow(
            _pack_group(length), "part int, begin long, sequence_id long, offset long"), "places")
    alone = -(F.shiftleft(F.col("part").cast("long"), 44) + F.col("begin") + 1)
    rest = [c for c in pieces.columns if c not in ("part", "begin")]
    full = pieces.where(F.col("length") >= length).select(
        *rest, alone.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    small_batches(spark)
    return pieces.where(F.col("length") < length).join(placed, ["part", "begin"]).select(
        *rest, "sequence_id", "offset").unionByName(full)


def pack_best_fit(docs: DataFrame, tokenizer: str, *, length: int = SEQUENCE, end_id: int = END_ID,
                  id_col: str = "doc_id", text_col: str = "text",
                  group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, doc_tokens, ids, sequence_id, offset."""
    pieces = cut_pieces(docs, tokenizer, length=length, end_id=end_id, id_col=id_col, text_col=text_col)
    return place_pieces(pieces, length=length, group_pieces=group_pieces)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the ids of each sequence; a sequence holds one bounded row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda have, p: F.concat(have, p["ids"]))
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), joined.alias("ids"))
