"""Token ids of whole texts by a public tokenizer, in Arrow batches.

Most words of a corpus recur, so every Python worker keeps the ids of the pieces it has met
and calls the tokenizer for new ones only. Latin texts are cut into pieces exactly where the
tokenizer cuts them, so ids equal those of the whole text; other texts, and all texts of a
tokenizer whose rules are not known here, go to it whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from colloquy.llm.rolling import text_bytes, word_hashes

END_ID = 1
# The white space of Unicode, and the letters and digits below U+0180.
SPACE = "\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f"
DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
BARE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
OTHER, LETTER, DIGIT, BLANK = range(4)
KNOWN_PIECES = 1_000_000  # in a worker's table; it starts anew when it is full

_encoders: dict[str, ChunkEncoder] = {}


def piece_family(config: dict) -> str | None:
    """How a tokenizer of this configuration splits: "spaced", "bare", or None if not known here."""
    before, norm = config.get("pre_tokenizer") or {}, config.get("normalizer")
    if before.get("type") == "ByteLevel" and not norm:
        return "spaced" if before.get("use_regex") and not before.get("add_prefix_space") else None
    parts = before.get("pretokenizers", [])
    if [p.get("type") for p in parts] != ["Split", "ByteLevel"] or [
            n.get("type") for n in (norm or {}).get("normalizers", [])] != ["NFC", "Replace", "Lowercase"]:
        return None
    pattern = parts[0]["pattern"].get("Regex")
    return "bare" if parts[0]["behavior"] == "Removed" and parts[0]["invert"] and pattern == BARE else None


def byte_letters() -> dict[int, str]:
    """The visible letter that byte-level vocabularies write for each byte."""
    visible = [*range(0x21, 0x7f), *range(0xa1, 0xad), *range(0xae, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def letter_classes() -> np.ndarray:
    """The class of every character below U+0180."""
    out = np.full(0x180, OTHER, dtype=np.uint8)
    for name, value in ((LETTERS, LETTER), (DIGITS, DIGIT), (SPACE, BLANK)):
        out[[c for c in range(0x180) if re.match(f"[{name}]", chr(c))]] = value
    return out


CLASSES = letter_classes()


def piece_edges(data: np.ndarray, offsets: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of all pieces of Latin texts in UTF-8.

    Without ``spaced`` white space is dropped and every digit is a piece; with it a space joins
    the piece behind it and longer white space keeps all but its last character.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    follows = (data >= 0x80) & (data < 0xc0)
    code = data.astype(np.int16)
    lead = np.flatnonzero(data >= 0xc0)
    code[lead] = ((data[lead] & 0x1f).astype(np.int16) << 6) | (data[lead + 1] & 0x3f)
    kind = CLASSES[np.where(follows, 0, code)]
    kind[lead + 1] = kind[lead]
    begins = np.zeros(n + 1, dtype=bool)
    begins[offsets] = True
    edge = begins.copy()
    edge[1:n] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(edge[:n])  # runs of one class
    stop = np.append(runs[1:], n)
    blank = kind[runs] == BLANK
    if spaced:
        closed = np.flatnonzero(blank & ~begins[stop])  # white space with text behind it
        last = stop[closed] - 1
        last -= follows[last]
        edge[last] = True
        edge[last[data[last] == 0x20] + 1] = False
    else:
        edge[:n] |= (kind == DIGIT) & ~follows
    mark = runs[(data[runs] == 0x27) & (stop - runs == 1) & ~begins[stop]]
    mark = mark[edge[mark] & (kind[mark + 1] == LETTER)]
    padded = np.append(data, [0, 0])
    one, two = padded[mark + 1], padded[mark + 2]
    single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    double = np.zeros(len(mark), dtype=bool)
    for a, b in (b"re", b"ve", b"ll"):
        double |= (one == a) & (two == b) & ~begins[np.minimum(mark + 2, n)]
    short = mark[single | double]
    edge[short + 1] = False
    edge[short + np.where(double, 3, 2)[single | double]] = True
    starts = np.flatnonzero(edge[:n])
    ends = np.append(starts[1:], n)
    if not spaced:
        solid = kind[starts] != BLANK
        starts, ends = starts[solid], ends[solid]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


class PieceTable:
    """The ids of known pieces, found by a 64-bit hash of their bytes.

    Two of the at most ``KNOWN_PIECES`` pieces of a table share a hash with a probability
    below 2**-24.
    """

    def __init__(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.begin = self.count = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def unknown(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        return np.flatnonzero(self.hashes[at] != hashes) if len(self.hashes) else np.arange(len(hashes))

    def add(self, hashes: np.ndarray, ids: list[list[int]]) -> None:
        """New sorted hashes with their ids."""
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        begin = len(self.ids) + np.cumsum(count) - count
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.begin, self.count = np.insert(self.begin, at, begin), np.insert(self.count, at, count)
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in ids for i in x), np.uint32, int(count.sum()))])

    def gather(self, hashes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``hashes[which]`` end to end, and how many each has."""
        at = np.searchsorted(self.hashes, hashes)
        count, begin = self.count[at][which], self.begin[at][which]
        total = np.cumsum(count)
        shift = np.repeat(begin - (total - count), count)
        return self.ids[shift + np.arange(len(shift))], count


class ChunkEncoder:
    """Encodes a column of texts.

    Latin texts are split into the tokenizer's own pieces in numpy, and only pieces that the
    worker has not met go to the BPE model. Other texts go through the whole tokenizer.
    """

    def __init__(self, path: str, known: int = KNOWN_PIECES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task per core
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        self.family = piece_family(config)
        self.marks = [t["content"].encode() for t in config.get("added_tokens", [])]
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.known = known
        self.table = PieceTable()

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype=np.uint32)
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts are Latin and hold none of the tokenizer's special strings."""
        hard = data >= 0xc6
        after = np.append(data[1:], 0) if len(data) else data
        hard |= (data == 0xc4) & (after == 0xb0)  # its lower case has two characters
        for mark in self.marks:
            hard |= (data == mark[0]) & (after == mark[1])
        hard = np.concatenate([[0], np.cumsum(hard)])
        return hard[offsets[1:]] == hard[offsets[:-1]]

    def _pieces(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each has."""
        data, offsets = text_bytes(pc.utf8_lower(column) if self.family == "bare" else column)
        starts, ends, text = piece_edges(data, offsets, self.family == "spaced")
        hashes, first, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.table.hashes) > self.known:
            self.table = PieceTable()
        new = self.table.unknown(hashes)
        raw, tokenize, letters = data.tobytes(), self.tokenizer.model.tokenize, self.letters
        self.table.add(hashes[new], [
            [t.id for t in tokenize(raw[a:b].decode("latin-1").translate(letters))]
            for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
        ids, count = self.table.gather(hashes, which)
        return ids, np.bincount(text, count, len(offsets) - 1).astype(np.int64)

    def __call__(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, offsets); ``end_id`` closes every text."""
        column = column.fill_null("")
        tail = 0 if end_id is None else 1
        plain = np.zeros(len(column), dtype=bool)
        if self.family:
            plain = self._plain(*text_bytes(column))
        ids, count = self._pieces(pc.if_else(pa.array(plain), column, "")) if plain.any() else (
            np.zeros(0, np.uint32), np.zeros(len(column), np.int64))
        hard = np.flatnonzero(~plain)
        others = self.whole(column.take(pa.array(hard)).to_pylist())
        size = count.copy()
        size[hard] = [len(x) for x in others]
        offsets = np.concatenate([[0], np.cumsum(size + tail)])
        out = np.full(offsets[-1], end_id or 0, dtype=np.uint32)
        out[np.repeat(offsets[:-1] - (np.cumsum(count) - count), count) + np.arange(len(ids))] = ids
        for i, x in zip(hard, others, strict=True):
            out[offsets[i]:offsets[i] + len(x)] = x
        return out, offsets


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def encode_batches(path: str, end_id: int = END_ID,
                   packed: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: a batch with ``text`` first to (…, part, local, n_tokens, ids).

    ``end_id`` ends every document; ``packed`` gives the ids as little-endian bytes. ``local`` counts the ids of earlier rows of the task and
    ``part`` is the task's partition, so that totals per part turn it into a global offset.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, before, encode = TaskContext.get().partitionId(), 0, encoder(path)
        for batch in batches:
            ids, offsets = encode(batch.column(0), end_id)
            sizes = np.diff(offsets)
            if packed:
                buffers = [None, pa.py_buffer((4 * offsets).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))]
                lists = pa.Array.from_buffers(pa.binary(), len(sizes), buffers)
            else:
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32)))
            rest = [batch.column(i) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(np.full(len(sizes), part, dtype=np.int32)),
                 pa.array(before + offsets[:-1]), pa.array(sizes), lists],
                names=[*batch.schema.names[1:], "part", "local", "n_tokens", "ids"])
            before += int(offsets[-1])
    return run


ENCODED = "part int, local long, n_tokens long, ids "
