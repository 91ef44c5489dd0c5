"""Similarity join of texts on sets of word n-grams.

Texts with the same set are one class and take part once. MinHash signatures are cut into
bands; the number of bands and of rows per band follows from the recall wanted at the
threshold. Sets that share a band meet in that band's bucket and are compared there on their
full n-gram sets. A pair is counted in the first band that it shares only, buckets with the
same members are visited once, and n-grams travel only for sets that meet another one.

A bucket of any size is cut into chunks, and every pair of chunks is a block of bounded size
that compares its sets by matrix products. A block sends back one row per set (its number of
links and the smallest set it is connected to), never its pairs.

Words are taken unchanged. A text with fewer words than n has one n-gram, all of its words;
a text without words, null included, is alone in its class. Null ids are allowed: a class is
named by its smallest id and by null if none of its rows has one. Empty tables stay empty.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.bloom import build_filter, filter_blocks, apply_filter
from colloquy.llm.common import ROW, carry, small_batches
from colloquy.llm.components import components
from colloquy.llm.rolling import BASE, mix, rolling, text_bytes, word_edges, word_hashes
from colloquy.session import materialise

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999  # of a pair exactly at the threshold
MAX_HASHES = 128
CHUNK = 256  # sets on one side of a block
SLAB = 16_384  # n-grams in one matrix product


def choose_bands(threshold: float, recall: float, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """The most selective (bands, rows) that find a pair at the threshold with this recall.

    Where ``max_hashes`` do not reach it, bands of one row, as many as it takes.
    """
    best = None
    for rows in range(1, max_hashes + 1):
        hit = threshold ** rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if best is None or bands * rows <= max_hashes:
            best = (bands, rows)
    return best


def gram_sets(column: pa.Array | pa.ChunkedArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted different n-gram hashes of every text, end to end, and where each text's begin."""
    data, offsets = text_bytes(column)
    starts, ends, owner = word_edges(data, offsets)
    words = word_hashes(data, starts, ends)
    texts = len(offsets) - 1
    full = max(0, len(words) - n + 1)
    at = np.flatnonzero(owner[:full] == owner[n - 1:n - 1 + full])
    grams, of = mix(rolling(words, n, BASE)[at]), owner[at]
    count = np.bincount(owner, minlength=texts)
    short = np.flatnonzero((count > 0) & (count < n))
    first = np.searchsorted(owner, short)
    whole = [mix(rolling(words[a:a + count[t]], int(count[t]), BASE) + np.uint64(count[t]))[0]
             for t, a in zip(short, first, strict=True)]
    grams = np.concatenate([grams, np.array(whole, dtype=np.uint64)])
    of = np.concatenate([of, short])
    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    grams, of = grams[new], of[new]
    return grams, np.searchsorted(of, np.arange(texts + 1))


def signatures(grams: np.ndarray, at: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per text and band; texts without n-grams must be left out of ``at``."""
    seeds = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64))
    out = np.empty((len(at), bands), dtype=np.uint64)
    for band in range(bands):
        key = np.full(len(at), band, dtype=np.uint64)
        for i in range(band * rows, (band + 1) * rows):
            least = np.minimum.reduceat(grams * (seeds[2 * i] | np.uint64(1)) + seeds[2 * i + 1], at)
            key = mix(key * np.uint64(BASE) + least)
        out[:, band] = key
    return out


def _lists(values: np.ndarray, width: int, where: np.ndarray, n: int) -> pa.Array:
    offsets = np.zeros(n + 1, dtype=np.int32)
    offsets[where + 1] = width
    return pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32)),
                                    pa.array(values.reshape(-1).view(np.int64)))


def _sign(n: int, bands: int, rows: int, with_grams: bool):
    """Batches with ``text`` first to (…, set_id, grams or signature)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, at = gram_sets(batch.column(0), n)
            ids = [hashlib.blake2b(grams[a:b], digest_size=16).digest() if a < b else None
                   for a, b in zip(at[:-1], at[1:], strict=True)]
            if with_grams:
                last = pa.array([grams[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)],
                                pa.binary())
            else:
                where = np.flatnonzero(at[1:] > at[:-1])
                signed = signatures(grams, at[where], bands, rows) if len(where) else np.zeros((0, bands), np.uint64)
                last = _lists(signed, bands, where, len(ids))
            rest = [batch.column(i) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(ids, pa.binary()), last],
                names=[*batch.schema.names[1:], "set_id", "grams" if with_grams else "bands"])
    return run


def _shared(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sizes of all intersections between the sets ``a`` and the sets ``b``."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, gram, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    often = times[gram] > 1
    row, gram = row[often], number[gram[often]]
    order = np.argsort(gram, kind="stable")
    row, gram = row[order], gram[order]
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    width = int(number[-1]) + 1 if len(number) else 0
    for left in range(0, width, SLAB):
        lo, hi = np.searchsorted(gram, [left, left + SLAB])
        dense = np.zeros((len(sets), min(SLAB, width - left)), dtype=np.float32)
        dense[row[lo:hi], gram[lo:hi] - left] = 1
        out += dense[a] @ dense[b].T
    return out


def compare_block(sets: list[np.ndarray], bands: np.ndarray, copies: np.ndarray, side: np.ndarray,
                  band: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of every set (copies of partners counted) and the first set it is connected to.

    ``side`` is 0 and 1 for the two chunks of a block; all 0 compares one chunk with itself.
    """
    one = side.max() == 0
    a = np.flatnonzero(side == 0)
    b = a if one else np.flatnonzero(side == 1)
    size = np.array([len(s) for s in sets])
    both = _shared(sets, a, b).astype(np.float64)
    linked = both / (size[a][:, None] + size[b][None, :] - both) >= threshold
    for earlier in range(band):
        linked &= bands[a, earlier][:, None] != bands[b, earlier][None, :]
    if one:
        linked = np.triu(linked, 1)
    x, y = np.nonzero(linked)
    x, y = a[x], b[y]
    links = (np.bincount(x, copies[y], len(sets)) + np.bincount(y, copies[x], len(sets))).astype(np.int64)
    root = np.arange(len(sets))
    while True:
        least = root.copy()
        np.minimum.at(least, x, root[y])
        np.minimum.at(least, y, root[x])
        least = least[least]
        if (least == root).all():
            return links, root
        root = least


def _blocks(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compares the blocks of a partition one after the other; rows come sorted by block."""
    def finish(rows: list[dict]) -> pa.RecordBatch:
        key = rows[0]["block"]
        sets = [np.frombuffer(r["grams"], "<u8") for r in rows]
        ids = [r["set_id"] for r in rows]
        links, root = compare_block(
            sets, np.array([r["bands"] for r in rows]), np.array([r["copies"] for r in rows]),
            np.array([int(r["chunk"] != key["i"]) for r in rows]), key["band"], threshold)
        found = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays(
            [pa.array([ids[i] for i in found], pa.binary()), pa.array(links[found]),
             pa.array([ids[root[i]] for i in found], pa.binary())], names=["set_id", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["block"] != row["block"]:
                    yield finish(held)
                    held = []
                held.append(row)
        if held:
            yield finish(held)
    return run


def join_sets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS,
              threshold: float = THRESHOLD, recall: float = RECALL, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, class_id, n_links, is_first.

    ``n_links`` counts the other rows at or above the threshold, equal sets included; a class
    is everything connected by links. ``is_first`` marks the rows with the smallest (id, text
    hash) of their class. ``text_hash`` is Spark's xxhash64 of the text.
    """
    small_batches(docs.sparkSession)
    bands, rows_per_band = choose_bands(threshold, recall)
    text, key = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.col(f"`{id_col}`")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(text.alias("text"), key.alias("doc_id"), F.xxhash64(text).alias("text_hash"))
    signed = materialise(rows.mapInArrow(
        _sign(n, bands, rows_per_band, False),
        f"doc_id {kind}, text_hash long, set_id binary, bands array<long>"), "signatures")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    classes = materialise(signed.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(
        F.count("*").alias("copies"), F.min(place).alias("first"), F.first("bands").alias("bands")),
        "gram-sets")
    banded = classes.select("set_id", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(
        F.count("*").alias("g"), F.bit_xor(F.xxhash64("set_id")).alias("x"),
        F.bit_xor(F.xxhash64("set_id", F.lit(1))).alias("y")).where("g > 1")
    visited = materialise(buckets.groupBy("g", "x", "y").agg(F.min(F.struct("band", "key")).alias("b"))
                          .select("b.band", "b.key", "g"), "buckets")
    members = materialise(banded.join(visited, ["band", "key"]), "bucket-members")

    meeting = members.select("set_id").distinct()
    firsts = materialise(classes.join(meeting, "set_id").select("first.doc_id", "first.text_hash"), "meeting")
    # A filter of the wanted rows keeps the other texts out of the shuffle.
    pair = F.xxhash64("doc_id", "text_hash")
    blocks = filter_blocks(firsts.count())
    wanted = build_filter(firsts.select(pair.alias("h")), blocks)
    rows = apply_filter(rows.withColumn("h", pair), "h", wanted, blocks, "maybe").where("maybe").drop("h", "maybe")
    fetched = rows.join(firsts.distinct(), (rows["doc_id"].eqNullSafe(firsts["doc_id"]))
                        & (rows["text_hash"] == firsts["text_hash"]), "left_semi")
    grams = fetched.select("text").mapInArrow(_sign(n, bands, rows_per_band, True), "set_id binary, grams binary")
    full = materialise(grams.groupBy("set_id").agg(F.first("grams").alias("grams"))
                       .join(classes.select("set_id", "copies", "bands"), "set_id"), "grams")

    chunks = F.ceil(F.col("g") / chunk)
    own = F.pmod(F.xxhash64("set_id", F.lit(2)), chunks)
    placed = members.withColumn("chunk", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))).select(
        F.struct("band", "key", F.least("chunk", "other").alias("i"),
                 F.greatest("chunk", "other").alias("j")).alias("block"), "chunk", "set_id")
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = placed.join(full, "set_id").repartition(shuffles, "block").sortWithinPartitions("block")
    found = materialise(ready.mapInArrow(_blocks(threshold), "set_id binary, links long, root binary"), "links")

    links = found.groupBy("set_id").agg(F.sum("links").alias("links"))
    labels = components(found.where("set_id != root").select(F.col("set_id").alias("a"), F.col("root").alias("b")))
    labelled = classes.join(labels, F.col("set_id") == F.col("node"), "left").select(
        "set_id", "copies", "first", F.coalesce("label", "set_id").alias("label"))
    heads = labelled.groupBy("label").agg(F.min("first").alias("head"))
    verdicts = materialise(labelled.join(heads, "label").join(links, "set_id", "left").select(
        F.col("set_id").alias("of_set"), "head",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "verdicts")
    out = signed.join(verdicts, F.col("set_id") == F.col("of_set"), "left")
    alone = F.col("head").isNull()
    return out.select(
        "doc_id", "text_hash",
        F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("head.doc_id"))
                  & (F.col("text_hash") == F.col("head.text_hash")))).alias("is_first"))


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns: the first row of every class.

    Rows without links pass without a shuffle of their text where the list of linked rows is
    small; of rows that repeat the first one's id and text, one stays.
    """
    judged = materialise(join_sets(docs, id_col=id_col, text_col=text_col, **options)
                         .where("n_links > 0").select("doc_id", "text_hash", "is_first"), "linked")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = carry(docs, id=F.col(f"`{id_col}`"), h=F.xxhash64(text))

    def same(other: DataFrame):
        return rows["id"].eqNullSafe(other["doc_id"]) & (rows["h"] == other["text_hash"])

    passed = rows.join(judged, same(judged), "left_anti").select(ROW)
    first = judged.where("is_first").select("doc_id", "text_hash").distinct()
    stayed = rows.join(first, same(first), "left_semi").groupBy("id", "h").agg(
        F.first(ROW).alias(ROW)).select(ROW)
    return passed.unionByName(stayed).select(f"{ROW}.*")
