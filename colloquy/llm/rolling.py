"""Rabin-Karp hashes over whole Arrow columns of text, modulo 2**64."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
OTHER_BASE = 0xD1342543DE82EF95
BLOCK = 512 << 10  # bytes hashed at a time

_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1); kept, and grown when more are asked for."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK // 4), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def rolling(x: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """The polynomial hash of every run of ``width`` values, by doubling."""
    if len(x) < width:
        return np.zeros(0, dtype=np.uint64)
    done, out, block, size = 0, None, x, 1
    while True:
        if width & size:
            if out is None:
                out = block
            else:
                n = len(x) - done - size + 1
                out = out[:n] * np.uint64(pow(base, size, 1 << 64)) + block[done:done + n]
            done += size
        if done == width:
            return out[:len(x) - width + 1]
        n = len(x) - 2 * size + 1
        block = block[:n] * np.uint64(pow(base, size, 1 << 64)) + block[size:size + n]
        size *= 2


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a column and the offset of every text; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def word_edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; words never cross texts."""
    solid = (data != 32) & ((data < 9) | (data > 13))
    first = np.ones(len(data) + 1, dtype=bool)
    first[1:-1] = ~solid[:-1]
    first[offsets] = True
    starts = np.flatnonzero(solid & first[:-1])
    last = np.ones(len(data), dtype=bool)
    last[:-1] = first[1:-1] | ~solid[1:]
    ends = np.flatnonzero(solid & last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word, from prefix sums over blocks of whole words."""
    out = np.empty(len(starts), dtype=np.uint64)
    inverse = pow(BASE, -1, 1 << 64)
    w = 0
    while w < len(starts):
        origin = starts[w]
        stop = max(w + 1, int(np.searchsorted(ends, origin + BLOCK)))
        n = int(ends[stop - 1] - origin)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUES[data[origin:origin + n]] * powers(BASE, n), out=sums[1:])
        a, b = starts[w:stop] - origin, ends[w:stop] - origin
        out[w:stop] = mix((sums[b] - sums[a]) * powers(inverse, n + 1)[a] + (b - a).astype(np.uint64))
        w = stop
    return out
