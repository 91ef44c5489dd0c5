"""Sum-of-squares packing against a plain placement rule and the tokenizer on whole texts."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colloquy.llm.best_fit import (cut_pieces, pack_best_fit, piece_lengths, place_pieces, sequences,
                                   sum_of_squares)
from colloquy.llm.queries import op11_best_fit

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, n_tokens int, ids string, part string, length string, sequence_id int"
TEXTS = [None, "", " ", "a", "a b c", "naïve 日本語", "x" * 400, "x" * 400, "word " * 3000, "one two " * 64,
         "<|endoftext|>", "\n\n", "to be " * 20]


def plain(sizes, length):
    """Tries every open sequence and adds up all squares anew."""
    fills, out = [], []

    def squares(levels):
        counts = defaultdict(int)
        for x in levels:
            counts[x] += x < length
        return sum(v * v for v in counts.values())

    for s in sizes:
        fits = [j for j, x in enumerate(fills) if x < length and x + s <= length]
        if not fits:
            out.append((0, None))
            fills.append(s)
            continue
        costs = {}
        for j in fits:
            after = squares(fills[:j] + [fills[j] + s] + fills[j + 1:])
            costs[fills[j]] = after
        best = min(costs.values())
        level = max(h for h, c in costs.items() if c == best)
        j = next(j for j in fits if fills[j] == level)
        out.append((level, best))
        fills[j] += s
    return out, fills


@settings(max_examples=150, deadline=None)
@given(sizes=st.lists(st.integers(1, 11), max_size=25))
def test_every_place_has_the_smallest_sum(sizes):
    sequence, offset = sum_of_squares(np.array(sizes, dtype=np.int64), 12)
    want, fills = plain(sizes, 12)
    assert offset.tolist() == [h for h, _ in want]
    got = defaultdict(int)
    for q, o, s in zip(sequence.tolist(), offset.tolist(), sizes, strict=True):
        assert got[q] == o and o + s <= 12
        got[q] += s
    assert sorted(got.values()) == sorted(fills)


@given(sizes=st.lists(st.integers(1, 50), max_size=20), length=st.integers(1, 9))
def test_piece_lengths(sizes, length):
    doc, nth, n = piece_lengths(np.array(sizes, dtype=np.int64), length)
    for i, size in enumerate(sizes):
        mine = n[doc == i].tolist()
        assert sum(mine) == size and mine[1:] == [length] * (len(mine) - 1) and 0 < mine[0] <= length
        assert nth[doc == i].tolist() == list(range(len(mine)))


def rows():
    return [(None if i % 5 == 4 else 3 * i % 17, t, 1, "i", "p", "l", 0) for i, t in enumerate(TEXTS * 4)]


def check(found, length, want):
    """Sequences without gaps, pieces that give back the ids of every document."""
    fills = defaultdict(list)
    for r in found:
        fills[r.sequence_id].append((r.offset, r.length))
    for places in fills.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at and n > 0
            at += n
        assert at <= length
    pieces = defaultdict(list)
    for r in found:
        pieces[r.doc_id, r.doc_tokens].append((r.piece, r.start, r.length, bytes(r.ids)))
    ids = []
    for group in pieces.values():
        starts = defaultdict(list)
        for piece, start, n, raw in group:
            starts[piece].append((start, raw))
            assert len(raw) == 4 * n
        for start, raw in starts[0]:
            assert start == 0
        ids.append(sum(len(raw) for _, _, _, raw in group))
    assert sum(ids) == sum(map(len, want))
    return len(fills)


@pytest.mark.parametrize("length,group", [(2048, 16_384), (50, 16_384), (50, 9)])
def test_packing(spark, length, group):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    found = pack_best_fit(docs, PATH, length=length, group_pieces=group).collect()
    whole = Tokenizer.from_file(PATH)
    want = [np.asarray([*whole.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
            for r in rows()]
    n = check(found, length, want)
    total = sum(len(x) // 4 for x in want)
    if group > 100:
        assert n <= -(-total // length) * 1.05 + 1
    short = [x for x in want if len(x) <= 4 * length]
    assert sorted(bytes(r.ids) for r in found if r.doc_tokens <= length) == sorted(short)
    assert all((r.piece == 0) == (r.start == 0) for r in found)
    assert all(r.length == length for r in found if r.piece > 0)


def test_sequences_hold_the_pieces(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    pieces = place_pieces(cut_pieces(docs, PATH, length=64), length=64)
    whole = {r.sequence_id: (r.n_tokens, bytes(r.ids)) for r in sequences(pieces).collect()}
    for r in pieces.collect():
        n, ids = whole[r.sequence_id]
        assert len(ids) == 4 * n <= 256
        assert ids[4 * r.offset:4 * (r.offset + r.length)] == bytes(r.ids)


def test_query(spark, sf_dir):
    found = op11_best_fit(spark, sf_dir).collect()
    whole = Tokenizer.from_file(PATH)
    docs = {r.doc_id: np.asarray([*whole.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
            for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    covered = defaultdict(int)
    for r in found:
        ids = docs[r.doc_id][r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(ids.tobytes()) and len(ids) == r.length
        covered[r.doc_id] += r.length
    assert covered == {d: len(x) for d, x in docs.items()}
    total = sum(map(len, docs.values()))
    assert len({r.sequence_id for r in found}) <= -(-total // 2048) + 2
    assert len({(r.sequence_id, r.offset) for r in found}) == len(found)


def test_a_group_of_copies_fills_whole_sequences(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(64)], "doc_id long, text string")
    found = pack_best_fit(docs, PATH, length=8).select("sequence_id").distinct().count()
    assert found == 32


def test_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 200_000)], "doc_id long, text string")
    got = pack_best_fit(docs, PATH).agg(F.sum("length").alias("n"), F.max("length").alias("m")).first()
    assert got.m == 2048 and got.n == len(Tokenizer.from_file(PATH).encode("word " * 200_000).ids) + 1


def test_empty_table(spark):
    assert pack_best_fit(spark.createDataFrame([], SCHEMA), PATH).collect() == []
