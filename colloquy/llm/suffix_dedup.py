"""Substring dedup on bytes with suffix arrays.

Each window of ``width`` bytes is keyed by the smallest hash of the shorter strings inside it,
so equal windows have equal keys wherever they stand. Consecutive windows with one key form a
segment. Batches of texts send their keys once to be counted; only segments whose key occurs
again are sent to the shard of that key, equal segments of a batch once. A shard joins its
different segments, builds their suffix array by induced sorting and marks the windows whose
common prefix with a neighbour in order is at least a window long. Here no hash decides: a key
only says which shard to look in.

A hot key has more than ``HOT_BYTES`` of segments in all batches, as with a line that very many
texts share between different neighbours, or a segment above ``LONG_SEGMENT``, as in long runs of
one letter. Its segments stay where they are. Each batch sends the different windows under it as
two 64-bit hashes, spread over all shards by hash, and is told which of them start again. Two
different windows are mistaken for each other with probability 2**-128 a pair.

Null texts are empty; null and repeated ids are rows like any other. Texts below ``width``
bytes lose nothing. An empty table stays empty. A cut may end inside a character, so what is
kept is bytes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import ROW
from colloquy.llm.rolling import BASE, BYTE_VALUES, OTHER_BASE, mix, rolling, text_bytes
from colloquy.llm.suffix_array import common_prefixes, suffix_array
from colloquy.llm.window_dedup import dealt

WIDTH = 200
ANCHOR = 64  # bytes of the strings whose hashes key a window
BATCH_BYTES = 2 << 20
SHARD_BYTES = 8 << 20  # text whose keys fill one shard
HOT_BYTES = 2 << 20  # segments of one key that go to one shard
LONG_SEGMENT = 4 << 10
SEPARATOR = 255  # in no UTF-8 text


def _sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The best value of every run of ``width`` values, by doubling."""
    size = 1
    while 2 * size <= width:
        values = best(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return best(values[:len(values) - rest], values[rest:]) if rest else values


def in_order(table: pa.Table) -> pa.Table:
    """The rows of a batch by id and text hash; rows that tie are equal."""
    ids = table["id"].cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()
    return table.take(pa.array(np.lexsort((table["tie"].to_numpy(), ids))))


class Segments:
    """The windows of a batch, keyed; rows are in a fixed order, whatever order they came in."""

    def __init__(self, table: pa.Table, width: int, anchor: int) -> None:
        self.data, self.offsets = text_bytes(in_order(table)["text"])
        self.width = width
        self.text = np.repeat(np.arange(len(self.offsets) - 1, dtype=np.int32), np.diff(self.offsets))
        n = len(self.data)
        self.keys = self.inner = self.first = self.last = np.zeros(0, dtype=np.uint64)
        self.start = self.count = np.zeros(0, dtype=np.int64)
        if n < width:
            return
        hashes = mix(rolling(BYTE_VALUES[self.data], anchor, BASE)) | np.uint64(1)
        reach = width - anchor + 1
        least = _sliding(hashes, reach, np.minimum)
        valid = self.text[:n - width + 1] == self.text[width - 1:]
        least[~valid] = 0
        new = valid.copy()
        new[1:] &= (least[1:] != least[:-1])
        self.start = np.flatnonzero(new)
        edge = valid.copy()
        edge[:-1] &= (least[1:] != least[:-1])
        self.count = np.flatnonzero(edge) + 1 - self.start
        self.keys = least[self.start]
        pad = np.zeros(reach - 1, dtype=np.uint64)
        most = _sliding(np.concatenate([pad, least, pad]), reach, np.maximum)
        self.inner = hashes[(hashes == most)]  # a key for every place that gives one
        self.first = hashes[self.start]
        self.last = hashes[self.start + self.count + width - 1 - anchor]

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """The different keys and how many places have each."""
        return np.unique(self.inner, return_counts=True)

    def sizes(self, keys: np.ndarray, long: int, most: int) -> np.ndarray:
        """The bytes of the different segments of each key; above ``most`` where one is ``long``.

        Segments with equal ends and length count as equal: this only says how much is sent.
        """
        length = self.count + self.width - 1
        order = np.lexsort((self.last, self.first, length, self.keys))
        new = np.ones(len(order), dtype=bool)
        for column in (self.last, self.first, length, self.keys):
            new[1:] &= column[order][1:] == column[order][:-1]
        new[1:] = ~new[1:]
        once = order[new]
        cost = np.where(length[once] > long, most + 1, length[once])
        total = np.bincount(np.searchsorted(keys, self.keys[once]), cost, len(keys))
        return np.minimum(total, most + 1).astype("<u4")


def _blobs(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.array([values[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())


def _keys(width: int, anchor: int, shards: int, hot_bytes: int, long: int):
    def run(table: pa.Table) -> pa.Table:
        found = Segments(table, width, anchor)
        keys, _ = found.counted()
        sizes = found.sizes(keys, long, hot_bytes)
        shard = (mix(keys) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        keys, sizes, shard = keys[order], sizes[order], shard[order]
        edges = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
        return pa.table({
            "shard": pa.array(shard[edges[:-1]], pa.int64()),
            "batch": pa.array([table["batch"][0].as_py()] * (len(edges) - 1), pa.int64()),
            "keys": _blobs(keys, edges), "sizes": _blobs(sizes, edges)})
    return run


def _by_batch(values: np.ndarray, batch: np.ndarray, name: str) -> pa.Table:
    order = np.argsort(batch, kind="stable")
    values, batch = values[order], batch[order]
    edges = np.flatnonzero(np.diff(batch, prepend=-1, append=-1))
    return pa.table({"batch": pa.array(batch[edges[:-1]], pa.int64()), name: _blobs(values, edges)})


def _shared(hot_bytes: int):
    """Keys that two batches or more have, and hot keys, back to each of them."""
    def run(table: pa.Table) -> pa.Table:
        blocks = [np.frombuffer(k, "<u8") for k in table["keys"].to_pylist()]
        keys = np.concatenate(blocks)
        size = np.concatenate([np.frombuffer(s, "<u4") for s in table["sizes"].to_pylist()])
        batch = np.repeat(table["batch"].to_numpy(), [len(b) for b in blocks])
        _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
        hot = (np.bincount(which, size) > hot_bytes)[which]
        often = (times[which] > 1) & ~hot
        again, heated = _by_batch(keys[often], batch[often], "again"), _by_batch(keys[hot], batch[hot], "hot")
        return pa.concat_tables([
            again.append_column("hot", pa.nulls(len(again), pa.binary())),
            heated.add_column(1, "again", pa.nulls(len(heated), pa.binary()))])
    return run


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Two hashes of every run of ``width`` bytes, as rows."""
    values = BYTE_VALUES[data]
    return np.stack([mix(rolling(values, width, BASE)),
                     mix(rolling(mix(values), width, OTHER_BASE))], axis=1)


def _joined(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.drop_null().to_pylist()), "<u8")


def segment_windows(data: np.ndarray, start: np.ndarray, count: np.ndarray,
                    width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows of segments start, and their hashes; other bytes are not hashed."""
    length = count + width - 1
    begin = np.cumsum(length) - length
    at = np.repeat(start - begin, length) + np.arange(length.sum())
    own = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
    return at[own], window_hashes(data[at], width)[own]


def _hot_windows(found: Segments, hot: np.ndarray, batch: int, shards: int) -> pa.Table:
    """The different windows under hot keys, a window with two places or more twice.

    One more row says where the segments are (start and number of windows) and comes back to
    the batch as it is.
    """
    where = np.flatnonzero(np.isin(found.keys, hot))
    start, count = found.start[where], found.count[where]
    _, pairs = segment_windows(found.data, start, count, found.width)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    same = np.zeros(len(pairs) + 1, dtype=bool)
    same[1:-1] = (pairs[1:] == pairs[:-1]).all(axis=1)
    third = np.zeros(len(pairs), dtype=bool)
    third[2:] = same[2:-1] & same[1:-2]
    pairs = pairs[~third]
    shard = (pairs[:, 1] % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    pairs, shard = pairs[order], shard[order]
    edges = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
    windows = _blobs(pairs, edges)
    return pa.table({"shard": pa.array([*shard[edges[:-1]], batch % shards], pa.int64()),
                     "batch": pa.array([batch] * len(edges), pa.int64()),
                     "at": pa.array([*[None] * len(windows), np.stack([start, count]).astype("<i8").tobytes()],
                                    pa.binary()),
                     "windows": pa.concat_arrays([windows, pa.array([b""], pa.binary())])})


def _repeated_hot(table: pa.Table) -> pa.Table:
    """Windows of hot keys with two places or more, back to each batch that has them."""
    blocks = [np.frombuffer(w, "<u8").reshape(-1, 2) for w in table["windows"].to_pylist()]
    pairs = np.concatenate(blocks)
    batch = np.repeat(table["batch"].to_numpy(), [len(b) for b in blocks])
    order = np.lexsort((batch, pairs[:, 1], pairs[:, 0]))
    pairs, batch = pairs[order], batch[order]
    same = np.zeros(len(pairs) + 1, dtype=bool)
    same[1:-1] = (pairs[1:] == pairs[:-1]).all(axis=1)
    repeated = same[1:] | same[:-1]
    twice = same[:-1].copy()
    twice[1:] &= batch[1:] == batch[:-1]
    repeated &= ~twice  # a batch is told once
    return _by_batch(pairs[repeated], batch[repeated], "windows")


def _segments(width: int, anchor: int, shards: int):
    def run(table: pa.Table, lists: pa.Table) -> pa.Table:
        found = Segments(table, width, anchor)
        batch = table["batch"][0].as_py() if table.num_rows else 0
        own, times = found.counted()
        again, hot = _joined(lists["again"]), _joined(lists["hot"])
        again = np.setdiff1d(np.concatenate([own[times > 1], again]), hot)
        wanted = np.flatnonzero(np.isin(found.keys, again))
        raw = found.data.tobytes()
        places: dict[bytes, list[int]] = {}
        for i in wanted.tolist():
            a = int(found.start[i])
            places.setdefault(raw[a:a + int(found.count[i]) + width - 1], []).append(i)
        first = np.array([p[0] for p in places.values()], dtype=np.int64)
        row = [found.text[found.start[p]] for p in places.values()]
        at = [found.start[p] - found.offsets[r] for p, r in zip(places.values(), row, strict=True)]
        keys = found.keys[first]
        sent = pa.table({
            "shard": pa.array((mix(keys) % np.uint64(shards)).astype(np.int64)),
            "batch": pa.array([batch] * len(first), pa.int64()),
            "key": pa.array(keys.view(np.int64)),
            "segment": pa.array(list(places), pa.binary()),
            "rows": pa.array([r.astype("<i4").tobytes() for r in row], pa.binary()),
            "at": pa.array([a.astype("<i8").tobytes() for a in at], pa.binary()),
            "windows": pa.nulls(len(first), pa.binary())})
        if not len(hot):
            return sent
        windows = _hot_windows(found, hot, batch, shards)
        return pa.concat_tables([sent, pa.table(
            [windows[c] if c in windows.schema.names else pa.nulls(len(windows), sent.schema.field(c).type)
             for c in sent.schema.names], schema=sent.schema)])
    return run


def repeated_windows(segments: list[bytes], width: int) -> list[np.ndarray]:
    """For every segment, which of its windows also start elsewhere in these segments."""
    joined = np.frombuffer(b"".join(s + bytes([SEPARATOR]) for s in segments), np.uint8)
    before, length = common_prefixes(joined, suffix_array(joined))
    twin = length >= width
    marked = twin.copy()
    marked[before[twin]] = True
    sizes = np.array([len(s) for s in segments])
    begin = np.cumsum(sizes + 1) - sizes - 1
    return [marked[b:b + n - width + 1] for b, n in zip(begin, sizes, strict=True)]


def _suffixes(width: int):
    def segments(table: pa.Table) -> pa.Table:
        texts, keys = table["segment"].to_pylist(), table["key"].to_numpy()
        number: dict[bytes, int] = {}
        which = np.array([number.setdefault(t, len(number)) for t in texts])
        copies = np.bincount(which, [len(r) // 4 for r in table["rows"].to_pylist()], len(number))
        distinct = list(number)
        key = np.empty(len(distinct), dtype=np.int64)
        key[which] = keys
        _, group, times = np.unique(key, return_inverse=True, return_counts=True)
        # A segment alone under its key can still repeat itself, when it holds two places of the key.
        alone = times[group] == 1
        long = np.array([len(t) for t in distinct]) > width
        needed = np.flatnonzero((copies == 1) & (~alone | long) | ~alone)
        flags = [np.full(len(t) - width + 1, copies[i] > 1) for i, t in enumerate(distinct)]
        if len(needed):
            for i, marks in zip(needed, repeated_windows([distinct[i] for i in needed], width), strict=True):
                flags[i] = flags[i] | marks
        rows = {"batch": [], "rows": [], "at": [], "flags": []}
        for i, batch, of, at in zip(which, table["batch"].to_pylist(), table["rows"].to_pylist(),
                                    table["at"].to_pylist(), strict=True):
            if flags[i].any():
                rows["batch"].append(batch)
                rows["rows"].append(of)
                rows["at"].append(at)
                rows["flags"].append(len(flags[i]).to_bytes(4, "little") + np.packbits(flags[i]).tobytes())
        marked = pa.table(rows, schema=pa.schema([("batch", pa.int64()), ("rows", pa.binary()),
                                                  ("at", pa.binary()), ("flags", pa.binary())]))
        return marked.append_column("windows", pa.nulls(len(marked), pa.binary()))

    def run(table: pa.Table) -> pa.Table:
        hot = table.filter(pc.is_valid(table["windows"]))
        plain = table.filter(pc.is_null(table["windows"]))
        if not len(hot):
            return segments(plain)
        told, places = _repeated_hot(hot), hot.filter(pc.is_valid(hot["at"]))
        empty, blank = pa.nulls(len(told), pa.binary()), pa.nulls(len(places), pa.binary())
        told = pa.concat_tables([
            pa.table({"batch": told["batch"], "rows": empty, "at": empty, "flags": empty,
                      "windows": told["windows"]}),
            pa.table({"batch": places["batch"], "rows": blank, "at": places["at"], "flags": blank,
                      "windows": places["windows"]})])
        return pa.concat_tables([segments(plain), told]) if len(plain) else told
    return run


def among(own: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Which rows of two hashes are among ``pairs``."""
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    left = np.searchsorted(pairs[:, 0], own[:, 0])
    hit = np.zeros(len(own), dtype=bool)
    rest = np.arange(len(own))
    while len(rest):  # a second round only where two pairs agree in the first hash
        rest = rest[left[rest] < len(pairs)]
        rest = rest[pairs[left[rest], 0] == own[rest, 0]]
        hit[rest] = pairs[left[rest], 1] == own[rest, 1]
        left[rest] += 1
        rest = rest[~hit[rest]]
    return hit


def _remove(width: int):
    def run(table: pa.Table, lists: pa.Table) -> pa.Table:
        table = in_order(table)
        data, offsets = text_bytes(table["text"])
        step = np.zeros(len(data) + 1, dtype=np.int32)
        hot = _joined(lists["windows"]).reshape(-1, 2)
        if len(hot):
            places = lists.filter(pc.is_valid(lists["windows"]))["at"]
            start, count = _joined(places).view("<i8").reshape(2, -1)
            starts, own = segment_windows(data, start, count, width)
            starts = starts[among(own, hot)]
            np.add.at(step, starts, 1)
            np.add.at(step, starts + width, -1)
        lists = lists.filter(pc.is_null(lists["windows"]))
        for rows, at, flags in zip(*(lists[c].to_pylist() for c in ("rows", "at", "flags")), strict=True):
            n = int.from_bytes(flags[:4], "little")
            marks = np.flatnonzero(np.unpackbits(np.frombuffer(flags, np.uint8, offset=4), count=n))
            begin = offsets[np.frombuffer(rows, "<i4")] + np.frombuffer(at, "<i8")
            starts = (begin[:, None] + marks[None, :]).ravel()
            np.add.at(step, starts, 1)
            np.add.at(step, starts + width, -1)
        gone = np.cumsum(step[:-1]) > 0
        raw, kept, removed, spans = data.tobytes(), [], [], []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            flips = np.flatnonzero(np.diff(gone[a:b].astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
            edges = [0, *flips.ravel().tolist(), int(b - a)]
            kept.append(b"".join(raw[a + x:a + y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
            removed.append(int((flips[:, 1] - flips[:, 0]).sum()))
            spans.append([{"start": int(s), "end": int(e)} for s, e in flips])
        return pa.table({
            ROW: table[ROW], "n_bytes": pa.array(np.diff(offsets), pa.int64()),
            "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})
    return run


def remove_repeated_bytes(docs: DataFrame, *, width: int = WIDTH, anchor: int = ANCHOR,
                          id_col: str = "doc_id", text_col: str = "text",
                          keep: Sequence[str] | None = None, batch_bytes: int = BATCH_BYTES,
                          shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES,
                          long_segment: int = LONG_SEGMENT) -> DataFrame:
    """Every row with n_bytes, n_removed, kept (bytes) and spans (maximal, end exclusive).

    A byte goes when a string of ``width`` bytes over it also starts anywhere else, in the same
    text or another, judged on the input. The caller's columns ``keep`` (default all) come
    back in the struct ``_row``.
    """
    rows, total = dealt(docs, id_col, text_col, keep, batch_bytes)
    shards = max(1, -(-total // shard_bytes))
    keys = rows.groupBy("batch").applyInArrow(
        _keys(width, anchor, shards, hot_bytes, long_segment),
        "shard long, batch long, keys binary, sizes binary")
    again = keys.groupBy("shard").applyInArrow(_shared(hot_bytes), "batch long, again binary, hot binary")
    segments = rows.groupBy("batch").cogroup(again.groupBy("batch")).applyInArrow(
        _segments(width, anchor, shards),
        "shard long, batch long, key long, segment binary, rows binary, at binary, windows binary")
    marked = segments.groupBy("shard").applyInArrow(
        _suffixes(width), "batch long, rows binary, at binary, flags binary, windows binary")
    row = rows.schema[ROW].dataType.simpleString()
    return rows.groupBy("batch").cogroup(marked.groupBy("batch")).applyInArrow(
        _remove(width), f"{ROW} {row}, n_bytes long, n_removed long, kept binary, "
        "spans array<struct<start: long, end: long>>")
