"""How the tokens of two tokenizers meet in the same texts.

Every text is encoded twice: with a space before it by a byte-level vocabulary (A), and by a
sentence-piece model (B), which adds that space itself. Byte offsets where tokens of both
sides end cut the tokens into groups, and tokens whose byte ranges overlap are linked.

A space between two visible characters is an edge for both sides, so texts are cut there and
each worker aligns a word it has met only once. Models that could join across such a space
get whole texts.

The number of documents that hold a pair of ids is counted outside memory. Each batch of
documents is written as one zstd run per radix of the A id: its pairs in A-major order, the
documents of each pair and how often they hold it. Runs are merged on a heap, a bounded number
at a time, until one is left per radix. It lies in A-major order, so the highest count of an A
id is known when its pairs end. Then the runs stream past the merged counts of their radix
and give each document its sums. What is shuffled for counting is a batch's pairs, not its
documents, and a pair that all documents hold is one record a batch.

Texts that are null or empty, or that a side does not give back byte for byte, have no tokens.
Null and repeated ids are documents like any other. A text of any length is one row; a very
long word is aligned whole. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import small_batches
from colloquy.llm.rolling import mix
from colloquy.llm.tokens import byte_letters, piece_family
from colloquy.session import materialise

BATCH_DOCUMENTS = 500
RADIXES = 16
FAN_IN = 64  # runs merged at a time
KNOWN_UNITS = 250_000  # in a worker's table; it starts anew when it is full
KNOWN_LINKS = 4_000_000
JOINED_UNITS = 256  # new words encoded as one text
INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
ODD_SPACE = re.compile(r" (?:(?<=\s\s)|(?=\s))")
PIECE_SPACE = "▁"  # fixed value: how sentence pieces write a space

_units: dict[tuple[str, str], UnitTable] = {}


def byte_level_tokens(path: str) -> list[bytes]:
    """The bytes of every entry of a byte-level vocabulary."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    byte_of = {letter: byte for byte, letter in byte_letters().items()}
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return out


def sentence_piece_tokens(model) -> list[bytes]:
    """The bytes of every piece: its text with spaces, or the one byte that it stands for."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i)
                   else piece.replace(PIECE_SPACE, " ").encode())
    return out


class Side:
    """Byte lengths and decimal forms of one vocabulary's ids."""

    def __init__(self, tokens: list[bytes], last: str) -> None:
        self.tokens = tokens
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.inner = np.array([f"{i}," for i in range(len(tokens))], dtype=object)
        self.last = np.array([f"{i}{last}" for i in range(len(tokens))], dtype=object)


class UnitTable:
    """The alignment of every word a worker has met, looked up by the word itself."""

    def __init__(self, path_a: str, path_b: str, known: int = KNOWN_UNITS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task per core
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        with open(path_a, encoding="utf-8") as file:
            self.cuts = piece_family(json.load(file)) == "spaced" and not any(
                re.search(f"[^{PIECE_SPACE}]{PIECE_SPACE}", p) for p in pieces)
        self.side_a, self.side_b = Side(byte_level_tokens(path_a), "|"), Side(sentence_piece_tokens(self.b), ";")
        self.end = np.array([f"{i}\n" for i in range(len(pieces))], dtype=object)
        self.known = known
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.zeros((0, 4), dtype=np.int64)  # tokens of A and B, groups, links
        self.good = np.zeros(0, dtype=bool)
        self.first = np.zeros(0, dtype=np.int64)
        self.links = np.zeros(0, dtype=np.int32)  # places in ``pairs``
        self.pairs = np.zeros(0, dtype=np.int64)  # A id << 32 | B id

    def units(self, text: str) -> list[str]:
        if not self.cuts:
            return [text]
        odd = text[0] == " " or text[-1] == " " or ODD_SPACE.search(text)
        return INNER_SPACE.split(text) if odd else text.split(" ")

    def look_up(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(unit, text) of every unit of every text."""
        if len(self.index) > self.known or len(self.links) > KNOWN_LINKS:
            self.clear()
        words = [self.units(t) if t else [] for t in texts]
        index = self.index
        fresh = [u for u in dict.fromkeys(chain.from_iterable(words)) if u not in index]
        # Words without white space at their edges meet at edges of both sides, also when joined.
        bare = [bool(self.cuts and u and not u[0].isspace() and not u[-1].isspace()) for u in fresh]
        joined = [u for u, b in zip(fresh, bare, strict=True) if b]
        for at in range(0, len(joined), 64 * JOINED_UNITS):
            some = joined[at:at + 64 * JOINED_UNITS]
            self._add([some[i:i + JOINED_UNITS] for i in range(0, len(some), JOINED_UNITS)])
        alone = [[u] for u, b in zip(fresh, bare, strict=True) if not b]
        for at in range(0, len(alone), JOINED_UNITS):
            self._add(alone[at:at + JOINED_UNITS])
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        units = np.fromiter(map(index.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        return units, np.repeat(np.arange(len(texts)), sizes)

    def _add(self, rows: list[list[str]]) -> None:
        """New words; each row of them is encoded as one text."""
        texts = [" ".join(r) for r in rows]
        sides = (
            (self.side_a, [e.ids for e in self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]),
            (self.side_b, self.b.encode(texts, num_threads=1)))
        whole = [all(b"".join([side.tokens[i] for i in ids[at]]) == f" {t}".encode() for side, ids in sides)
                 for at, t in enumerate(texts)]
        kept = [at for at, ok in enumerate(whole) if ok]
        words = [w for at in kept for w in rows[at]]
        if words:
            self._align(words, *(np.fromiter(chain.from_iterable(ids[at] for at in kept), np.int64)
                                 for _, ids in sides))
        for at in (at for at, ok in enumerate(whole) if not ok):
            if len(rows[at]) > 1:  # find the one that does not come back
                self._add([[w] for w in rows[at]])
            else:
                self._store(rows[at], np.zeros((1, 4), np.int64), [""], np.zeros(0, np.int64), good=False)

    def _store(self, words: list[str], counts: np.ndarray, groups: list[str], links: np.ndarray,
               good: bool = True) -> None:
        start = len(self.groups)
        self.index.update(zip(words, range(start, start + len(words)), strict=True))
        self.groups.extend(groups)
        self.first = np.append(self.first, len(self.links) + np.cumsum(counts[:, 3]) - counts[:, 3])
        self.good = np.append(self.good, np.full(len(words), good))
        self.counts = np.vstack([self.counts, counts])
        known = np.argsort(self.pairs)
        pairs, which = np.unique(links, return_inverse=True)
        at = np.searchsorted(self.pairs[known], pairs)
        new = np.append(self.pairs[known], -1)[at] != pairs
        place = np.append(known, 0)[at]
        place[new] = len(self.pairs) + np.arange(new.sum())
        self.pairs = np.append(self.pairs, pairs[new])
        self.links = np.append(self.links, place[which].astype(np.int32))

    def _align(self, words: list[str], a: np.ndarray, b: np.ndarray) -> None:
        """Stores words whose ids on both sides, end to end, spell them with a space before each."""
        counts = np.zeros((len(words), 4), dtype=np.int64)
        edge = np.cumsum([len(w.encode()) + 1 for w in words])
        end_a, end_b = np.cumsum(self.side_a.size[a]), np.cumsum(self.side_b.size[b])
        ends = np.concatenate([end_a, end_b])
        ends.sort(kind="stable")
        repeated = np.diff(ends, prepend=-1) == 0
        both, edges = ends[repeated], ends[~repeated]
        # Between two neighbouring ends of either side lies one token of each: these two are linked.
        link_a, link_b = np.searchsorted(end_a, edges), np.searchsorted(end_b, edges)
        for column, at in enumerate((end_a, end_b, both, edges)):
            counts[:, column] = np.diff(np.searchsorted(at, edge, side="right"), prepend=0)
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        forms_a = np.where(both[group_a] == end_a, self.side_a.last[a], self.side_a.inner[a])
        forms_b = np.where(both[group_b] == end_b, self.side_b.last[b], self.side_b.inner[b])
        last = np.searchsorted(end_b, edge)
        forms_b[last] = self.end[b[last]]
        forms = np.empty(len(a) + len(b), dtype=object)
        forms[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = forms_a
        forms[np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")] = forms_b
        self._store(words, counts, "".join(forms.tolist()).split("\n")[:-1], a[link_a] << 32 | b[link_b])


def units_of(path_a: str, path_b: str) -> UnitTable:
    """The worker's table for two vocabulary files."""
    if (path_a, path_b) not in _units:
        _units[path_a, path_b] = UnitTable(path_a, path_b)
    return _units[path_a, path_b]


def pack_numbers(values: np.ndarray, ascending: bool = False) -> bytes:
    """Integers as a zstd block: equal bytes of all values lie together, steps instead of rising values."""
    values = np.ascontiguousarray(values, dtype="<i8")
    steps = np.diff(values, prepend=np.int64(0)) if ascending else values
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_numbers(block: bytes, ascending: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8).reshape(8, -1)
    steps = np.ascontiguousarray(planes.T).view("<i8").ravel()
    return np.cumsum(steps) if ascending else steps


def radix_of(pairs: np.ndarray, radixes: int) -> np.ndarray:
    """The partition of the A id of each pair."""
    return (mix((pairs >> 32).astype(np.uint64)) % np.uint64(radixes)).astype(np.int64)


def _runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of an equal value begin, and how long they are."""
    new = np.flatnonzero(np.diff(values, prepend=-1))
    return new, np.diff(np.append(new, len(values)))


def _records(table: UnitTable, units: np.ndarray, text: np.ndarray, n_texts: int,
             radixes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(radix, pair, text, times) of all links, one record per pair and text, in this order."""
    known = len(table.good)
    met = np.sort(text * known + units)
    new, repeats = _runs_of(met)
    met = met[new]
    unit = met % known
    n = table.counts[unit, 3]
    ends = np.cumsum(n)
    at = np.repeat(table.first[unit] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
    radix = radix_of(table.pairs, radixes)
    order = np.lexsort((table.pairs, radix))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    place = rank[table.links[at]] * n_texts + np.repeat(met // known, n)
    by_place = np.argsort(place)
    place = place[by_place]
    new, _ = _runs_of(place)
    times = np.add.reduceat(np.repeat(repeats, n)[by_place], new) if len(new) else np.zeros(0, np.int64)
    pair = order[place[new] // n_texts]
    return radix[pair], table.pairs[pair], place[new] % n_texts, times


RUN = "pairs binary, counts binary"
RECORDS = f"batch long, radix int, {RUN}, places binary, times binary, " \
          "place int, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string"


def _spill(path_a: str, path_b: str, radixes: int, kind: pa.DataType) -> Callable[
        [Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: (text, doc_id) to one row per document and one run per radix of a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        table, first = units_of(path_a, path_b), TaskContext.get().partitionId() << 32
        for number, rows in enumerate(batches):
            n = rows.num_rows
            units, text = table.look_up(rows.column(0).to_pylist())
            whole = np.ones(n, dtype=bool)
            whole[text[~table.good[units]]] = False
            units, text = units[whole[text]], text[whole[text]]
            edges = np.searchsorted(text, np.arange(n + 1)).tolist()
            names = list(map(table.groups.__getitem__, units.tolist()))
            sums = [np.bincount(text, table.counts[units, i], n).astype(np.int64) for i in range(4)]
            radix, pairs, place, times = _records(table, units, text, n, radixes)
            used = np.unique(radix).tolist()
            runs = {"pairs": [], "counts": [], "places": [], "times": []}
            for a, b in zip(np.searchsorted(radix, used).tolist(), np.searchsorted(radix, used, "right").tolist(),
                            strict=True):
                new, counts = _runs_of(pairs[a:b])
                runs["pairs"].append(pack_numbers(pairs[a:b][new], ascending=True))
                runs["counts"].append(pack_numbers(counts))
                runs["places"].append(pack_numbers(place[a:b]))
                runs["times"].append(pack_numbers(times[a:b]))
            blank, m = [None] * n, len(used)
            columns = {
                "batch": pa.array(np.full(n + m, first + number)),
                "radix": pa.array([*blank, *used], pa.int32()),
                **{c: pa.array([*blank, *x], pa.binary()) for c, x in runs.items()},
                "place": pa.array([*range(n), *[None] * m], pa.int32()),
                "doc_id": pa.concat_arrays([rows.column(1), pa.nulls(m, kind)]),
                **{c: pa.array([*x.tolist(), *[None] * m], pa.int64())
                   for c, x in zip(("n_a", "n_b", "n_groups", "n_links"), sums, strict=True)},
                "groups": pa.array([*(";".join(names[a:b]) for a, b in zip(edges, edges[1:], strict=False)),
                                    *[None] * m], pa.string())}
            yield pa.RecordBatch.from_pydict(columns)
    return run


def _stream(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Neighbouring rows with an equal key; each group is read as it comes."""
    from itertools import groupby
    rows = (row for batch in batches for row in batch.to_pylist())
    return groupby(rows, key=lambda r: tuple(r[k] for k in key))


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted run of (pair, count) from several, by a heap over their heads."""
    pairs: list[int] = []
    counts: list[int] = []
    last = None
    for pair, count in heapq.merge(*(zip(p.tolist(), c.tolist(), strict=True) for p, c in runs)):
        if pair == last:
            counts[-1] += count
        else:
            pairs.append(pair)
            counts.append(count)
            last = pair
    return np.array(pairs, dtype=np.int64), np.array(counts, dtype=np.int64)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (radix, part), rows in _stream(batches, ("radix", "part")):
        pairs, counts = merge_runs([(unpack_numbers(r["pairs"], True), unpack_numbers(r["counts"])) for r in rows])
        yield pa.RecordBatch.from_pydict({
            "batch": pa.array([part], pa.int64()), "radix": pa.array([radix], pa.int32()),
            "pairs": pa.array([pack_numbers(pairs, True)], pa.binary()),
            "counts": pa.array([pack_numbers(counts)], pa.binary())})


def highest(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which pairs have the highest count of their A id; pairs lie in A-major order."""
    if not len(pairs):
        return np.zeros(0, dtype=bool)
    new = np.diff(pairs >> 32, prepend=-1) != 0
    return np.maximum.reduceat(counts, np.flatnonzero(new))[np.cumsum(new) - 1] == counts


def _give_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams the runs of a radix past its merged counts, which come first."""
    for _, rows in _stream(batches, ("radix", "salt")):
        merged = next(rows)
        pairs, counts = unpack_numbers(merged["pairs"], True), unpack_numbers(merged["counts"])
        best = highest(pairs, counts)
        for run in rows:
            at = np.searchsorted(pairs, unpack_numbers(run["pairs"], True))
            at = np.repeat(at, unpack_numbers(run["counts"]))
            place, times = unpack_numbers(run["places"]), unpack_numbers(run["times"])
            places, which = np.unique(place, return_inverse=True)
            total, top = np.zeros((2, len(places)), dtype=np.int64)
            np.add.at(total, which, times * counts[at])
            np.add.at(top, which, times * best[at])
            yield pa.RecordBatch.from_pydict({
                "batch": pa.array([run["batch"]], pa.int64()), "places": pa.array([pack_numbers(places, True)]),
                "totals": pa.array([pack_numbers(total)]), "tops": pa.array([pack_numbers(top)])})


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of each document over all radixes; a batch is a bounded number of documents."""
    for (batch,), rows in _stream(batches, ("batch",)):
        parts = [[unpack_numbers(r["places"], True), unpack_numbers(r["totals"]), unpack_numbers(r["tops"])]
                 for r in rows]
        places, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        total, top = np.zeros((2, len(places)), dtype=np.int64)
        np.add.at(total, which, np.concatenate([p[1] for p in parts]))
        np.add.at(top, which, np.concatenate([p[2] for p in parts]))
        yield pa.RecordBatch.from_pydict({
            "batch": pa.array(np.full(len(places), batch)), "place": pa.array(places.astype(np.int32)),
            "count_sum": pa.array(total), "n_best": pa.array(top)})


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            pairs, counts = unpack_numbers(row["pairs"], True), unpack_numbers(row["counts"])
            for at in range(0, len(pairs), 1 << 16):
                p, c = pairs[at:at + (1 << 16)], counts[at:at + (1 << 16)]
                yield pa.RecordBatch.from_pydict({
                    "a_id": pa.array(p >> 32), "b_id": pa.array(p & 0xffffffff), "n_documents": pa.array(c),
                    "highest": pa.array(highest(pairs, counts)[at:at + (1 << 16)])})


@dataclass(frozen=True)
class Alignment:
    """What was written: documents with their groups, their runs, and the merged runs."""

    documents: DataFrame  # batch, place, doc_id, n_a, n_b, n_groups, n_links, groups
    runs: DataFrame  # batch, radix, pairs, counts, places, times
    merged: DataFrame  # radix, pairs, counts: one row per radix
    salts: int

    def pair_counts(self) -> DataFrame:
        """(a_id, b_id, n_documents, highest) of every pair of linked ids."""
        return self.merged.select("pairs", "counts").mapInArrow(
            _flat, "a_id long, b_id long, n_documents long, highest boolean")

    def sums(self) -> DataFrame:
        """(batch, place, count_sum, n_best) of every document with links."""
        none = F.lit(None).cast("binary")
        salted = self.merged.select("radix", F.explode(F.sequence(F.lit(0), F.lit(self.salts - 1))).alias("salt"),
                                    F.lit(None).cast("long").alias("batch"), "pairs", "counts",
                                    none.alias("places"), none.alias("times"))
        runs = self.runs.select("radix", F.pmod(F.xxhash64("batch"), F.lit(self.salts)).cast("int").alias("salt"),
                                "batch", "pairs", "counts", "places", "times")
        parts = salted.unionByName(runs).repartition("radix", "salt").sortWithinPartitions(
            "radix", "salt", F.col("batch").asc_nulls_first())
        given = parts.mapInArrow(_give_back, "batch long, places binary, totals binary, tops binary")
        return given.repartition("batch").sortWithinPartitions("batch").mapInArrow(
            _sum_up, "batch long, place int, count_sum long, n_best long")

    def scores(self, documents: DataFrame | None = None) -> DataFrame:
        """``documents`` with count_sum and n_best; needs batch and place."""
        rows = self.documents if documents is None else documents
        zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("count_sum", "n_best")}
        return rows.join(self.sums(), ["batch", "place"], "left").withColumns(zero).drop("batch", "place")


def align(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text",
          radixes: int = RADIXES, fan_in: int = FAN_IN, batch_documents: int = BATCH_DOCUMENTS) -> Alignment:
    """Aligns all texts, and counts in how many documents each pair of ids is linked."""
    spark = docs.sparkSession
    small_batches(spark, batch_documents)
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").alias("doc_id"))
    from pyspark.sql.pandas.types import to_arrow_type
    kind = rows.schema["doc_id"].dataType
    spilled = rows.mapInArrow(_spill(path_a, path_b, radixes, to_arrow_type(kind)),
                              RECORDS.format(kind=kind.simpleString()))
    written = materialise(spilled, "pair-runs")
    documents = written.where("radix is null").select(
        "batch", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")
    runs = written.where("radix is not null").select("batch", "radix", "pairs", "counts", "places", "times")
    small_batches(spark, 2 * fan_in)  # rows from here on are runs
    left = documents.where("place = 0").count()
    salts = max(1, -(-left // fan_in))
    merged = runs.select("batch", "radix", *RUN.replace(" binary", "").split(", "))
    while True:
        left = max(1, -(-left // fan_in))
        part = F.pmod(F.xxhash64("batch"), F.lit(left)).alias("part")
        merged = materialise(
            merged.select("radix", part, "pairs", "counts").repartition("radix", "part")
            .sortWithinPartitions("radix", "part").mapInArrow(_merge, f"batch long, radix int, {RUN}"), "merged-runs")
        if left == 1:
            return Alignment(documents, runs, merged.select("radix", "pairs", "counts"), salts)
