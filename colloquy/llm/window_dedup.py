"""Substring dedup over fixed-length windows of words.

The texts are dealt to batches once. Every batch computes two Rabin-Karp hashes of each window:
the first names it, the second names its bucket, so both together tell windows apart. A batch
sends each different hash once, with the smallest id that has it, so a passage shared by a
third of the corpus costs one entry per batch. Buckets count the batches of a hash and send
back to each batch the hashes that occur earlier elsewhere. The batch hashes its texts again,
marks every word under such a window or under one that an earlier document of the batch has,
and merges marks into maximal intervals.

Two different windows are mistaken for each other with probability 2**-64 / buckets a pair.

Nulls: a null text has no words; a null id is below every other id; rows with equal ids do not
remove words from each other. Texts shorter than a window lose nothing. Empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import ROW, carry
from colloquy.llm.rolling import BASE, OTHER_BASE, mix, rolling, text_bytes, word_edges, word_hashes

WINDOW = 50
BATCH_BYTES = 4 << 20  # text of one batch; raise it with the corpus so that blocks stay large
BUCKET_BYTES = 8 << 20  # text whose windows fill one bucket
NULL_ID = np.iinfo(np.int64).min


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy()


class Windows:
    """The windows of a batch, in ascending order of id."""

    def __init__(self, table: pa.Table, width: int) -> None:
        self.ids = _ids(table["id"])
        self.data, self.offsets = text_bytes(table["text"])
        self.starts, self.ends, self.text = word_edges(self.data, self.offsets)
        words = word_hashes(self.data, self.starts, self.ends)
        n = max(0, len(words) - width + 1)
        self.at = np.flatnonzero(self.text[:n] == self.text[width - 1:width - 1 + n])
        self.hashes = rolling(words, width, BASE)[self.at]
        self.second = lambda: rolling(mix(words + np.uint64(1)), width, OTHER_BASE)[self.at]
        self.owner = self.ids[self.text[self.at]]

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The first window of every hash in order of id, and for each window which hash it has."""
        order = np.lexsort((self.owner, self.hashes))
        sorted_hashes = self.hashes[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = sorted_hashes[1:] != sorted_hashes[:-1]
        which = np.empty(len(order), dtype=np.int64)
        which[order] = np.cumsum(new) - 1
        return order[new], which


def _send(width: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        windows = Windows(table, width)
        first, _ = windows.distinct()
        bucket = (mix(windows.second()[first]) % np.uint64(buckets)).astype(np.int64)
        owner = windows.owner[first]
        order = np.lexsort((owner, bucket))
        first, bucket, owner = first[order], bucket[order], owner[order]
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        rows = {"bucket": [], "batch": [], "hashes": [], "owners": [], "runs": []}
        batch = table["batch"][0].as_py()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            runs = np.flatnonzero(np.diff(owner[a:b], prepend=owner[a] - 1 if owner[a] > NULL_ID else 0))
            rows["bucket"].append(bucket[a])
            rows["batch"].append(batch)
            rows["hashes"].append(windows.hashes[first[a:b]].tobytes())
            rows["owners"].append(owner[a:b][runs].tobytes())
            rows["runs"].append(np.diff(runs, append=b - a).astype("<u4").tobytes())
        return pa.table(rows, schema=pa.schema([
            ("bucket", pa.int64()), ("batch", pa.int64()), ("hashes", pa.binary()),
            ("owners", pa.binary()), ("runs", pa.binary())]))
    return run


def _count(table: pa.Table) -> pa.Table:
    blocks = table.to_pylist()
    hashes = np.concatenate([np.frombuffer(b["hashes"], "<u8") for b in blocks])
    owner = np.concatenate([np.repeat(np.frombuffer(b["owners"], "<i8"), np.frombuffer(b["runs"], "<u4"))
                            for b in blocks])
    sizes = [len(b["hashes"]) // 8 for b in blocks]
    batch = np.repeat(np.array([b["batch"] for b in blocks]), sizes)
    order = np.argsort(hashes, kind="stable")
    hashes, owner, batch = hashes[order], owner[order], batch[order]
    heads = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    smallest = np.repeat(np.minimum.reduceat(owner, heads), np.diff(heads, append=len(hashes)))
    earlier = np.flatnonzero(owner > smallest)
    earlier = earlier[np.argsort(batch[earlier], kind="stable")]
    to = batch[earlier]
    edges = np.flatnonzero(np.diff(to, prepend=-1, append=-1))
    return pa.table({
        "batch": pa.array(to[edges[:-1]], pa.int64()),
        "seen": pa.array([hashes[earlier[a:b]].tobytes()
                          for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())})


def _remove(width: int):
    def run(table: pa.Table, lists: pa.Table) -> pa.Table:
        windows = Windows(table, width)
        first, which = windows.distinct()
        seen = np.frombuffer(b"".join(lists["seen"].to_pylist()), "<u8")
        bad = np.isin(windows.hashes[first], seen)
        bad = bad[which] | (windows.owner > windows.owner[first][which])
        step = np.zeros(len(windows.starts) + 1, dtype=np.int64)
        np.add.at(step, windows.at[bad], 1)
        np.add.at(step, windows.at[bad] + width, -1)
        marked = np.cumsum(step[:-1]) > 0
        edge = np.searchsorted(windows.text, np.arange(len(windows.ids) + 1))
        texts, spans = [], []
        raw = windows.data.tobytes()
        for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
            words = raw[windows.offsets[i]:windows.offsets[i + 1]].split()
            mask = marked[a:b]
            found = []
            if mask.any():
                flips = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
                found = [{"start": int(s), "end": int(e)} for s, e in flips.reshape(-1, 2)]
                words = [w for w, gone in zip(words, mask.tolist(), strict=True) if not gone]
            texts.append(b" ".join(words).decode())
            spans.append(found)
        counts = np.diff(edge)
        removed = np.diff(np.concatenate([[0], np.cumsum(marked)])[edge])
        return pa.table({
            ROW: table[ROW], "n_words": pa.array(counts, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(texts, pa.string()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})
    return run


def dealt(docs: DataFrame, id_col: str, text_col: str, keep: Sequence[str] | None,
          batch_bytes: int) -> tuple[DataFrame, int]:
    """Rows dealt to batches of about ``batch_bytes`` of text, and the bytes of all texts.

    A batch is a hash of id and text length, so many rows without id still spread.
    """
    text, key = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    batches = max(1, -(-total // batch_bytes))
    rows = carry(docs, keep, id=key.cast("long"), text=text, tie=F.xxhash64(text),
                 batch=F.pmod(F.xxhash64(key, F.octet_length(text)), F.lit(batches)).cast("long"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "batch"), total


def remove_repeats(docs: DataFrame, *, width: int = WINDOW, id_col: str = "doc_id",
                   text_col: str = "text", keep: Sequence[str] | None = None,
                   batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every row with n_words, n_removed, kept_text (words joined by one space) and spans.

    A window goes when its words also start in a row with a smaller id, judged on the input.
    Spans are maximal runs of removed words, end exclusive. The caller's columns ``keep``
    (default all) come back in the struct ``_row``.
    """
    rows, total = dealt(docs, id_col, text_col, keep, batch_bytes)
    buckets = max(1, -(-total // bucket_bytes))
    # Both passes read the same columns of the same shuffle, so the texts move once.
    entries = rows.groupBy("batch").applyInArrow(
        _send(width, buckets), "bucket long, batch long, hashes binary, owners binary, runs binary")
    seen = entries.groupBy("bucket").applyInArrow(_count, "batch long, seen binary")
    row = rows.schema[ROW].dataType.simpleString()
    return rows.groupBy("batch").cogroup(seen.groupBy("batch")).applyInArrow(
        _remove(width), f"{ROW} {row}, n_words long, n_removed long, kept_text string, "
        "spans array<struct<start: long, end: long>>")
