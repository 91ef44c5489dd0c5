"""Suffix arrays and byte dedup against direct definitions."""

import hashlib
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm import suffix_array as sa
from colloquy.llm.common import ROW
from colloquy.llm import suffix_dedup
from colloquy.llm.suffix_dedup import remove_repeated_bytes, repeated_windows

SCHEMA = "doc_id long, text string, tie string, batch int, spans string"


def plain_prefix(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text("ab", max_size=60), st.text("abc\n", max_size=40),
                 st.lists(st.sampled_from(["abcab", "b", "ccc", "zyx"]), max_size=20).map("".join)))
def test_suffix_array(text):
    data = text.encode()
    order = sa.suffix_array(np.frombuffer(data, np.uint8))
    want = sorted(range(len(data)), key=lambda i: data[i:])
    assert order.tolist() == want
    if data:
        before, length = sa.common_prefixes(np.frombuffer(data, np.uint8), order)
        for k, i in enumerate(want):
            assert before[i] == (want[k - 1] if k else -1)
            assert length[i] == (plain_prefix(data[i:], data[want[k - 1]:]) if k else 0)


def test_large_suffix_array():
    rng = np.random.default_rng(1)
    words = [rng.integers(97, 123, n).astype(np.uint8) for n in rng.integers(2, 9, 500)]
    data = np.concatenate([words[i] for i in rng.integers(0, 500, 20_000)] + [np.full(3000, 97, np.uint8)])
    order = sa.suffix_array(data)
    raw = data.tobytes()
    assert sorted(order.tolist()) == list(range(len(data)))
    assert all(raw[a:a + 4000] <= raw[b:b + 4000] for a, b in zip(order[:-1], order[1:], strict=True))


def test_repeated_windows():
    got = repeated_windows([b"abcabc", b"xabcx", b"zzzz"], 3)
    assert [g.tolist() for g in got] == [[True, False, False, True], [False, True, False], [True, True]]


def brute(rows, width):
    raw = [(t or "").encode() for _, t in rows]
    count = {}
    for b in raw:
        for i in range(len(b) - width + 1):
            count[b[i:i + width]] = count.get(b[i:i + width], 0) + 1
    out = []
    for (d, _), b in zip(rows, raw, strict=True):
        gone = set()
        for i in range(len(b) - width + 1):
            if count[b[i:i + width]] > 1:
                gone.update(range(i, i + width))
        flags = [i in gone for i in range(len(b))]
        spans = sum(1 for i, f in enumerate(flags) if f and (i == 0 or not flags[i - 1]))
        kept = bytes(c for c, f in zip(b, flags, strict=True) if not f)
        out.append((d, len(b), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdefgh é日\n"
    passages = ["".join(rng.choices(letters, k=n)) for n in (20, 30, 45, 200)]
    rows = []
    for d in range(60):
        parts = [rng.choice(passages)[rng.randrange(8):] if rng.random() < .5 else "".join(rng.choices(letters, k=25))
                 for _ in range(rng.randrange(5))]
        rows.append((rng.randrange(40), "".join(parts)))
    return [*rows, rows[4], (None, None), (None, passages[3]), (60, ""), (61, "a" * 300), (62, "xy" * 80),
            (63, "q" * 24), (64, "q" * 25), (65, passages[2] * 30)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("batch_bytes", [400, 1 << 20])
def test_against_rule(spark, seed, batch_bytes):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], SCHEMA).repartition(7)
    out = remove_repeated_bytes(docs, width=24, anchor=8, batch_bytes=batch_bytes, shard_bytes=2 * batch_bytes)
    got = [(r[ROW].doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest())
           for r in out.collect()]
    assert sorted(got, key=str) == brute(rows, 24)


@pytest.mark.parametrize("hot_bytes,long_segment", [(0, 10_000), (60, 10_000), (400, 60)])
def test_hot_keys_against_rule(spark, hot_bytes, long_segment):
    """All, many and few keys are hot; the result is the same."""
    rows = corpus(3)
    docs = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], SCHEMA).repartition(5)
    out = remove_repeated_bytes(docs, width=24, anchor=8, batch_bytes=400, shard_bytes=800,
                                hot_bytes=hot_bytes, long_segment=long_segment)
    got = [(r[ROW].doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest())
           for r in out.collect()]
    assert sorted(got, key=str) == brute(rows, 24)


def shared_line(n):
    """A third of the texts share a line of 220 bytes between different neighbours."""
    rng = random.Random(7)
    word = lambda k: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=k))
    line = word(220)
    return [(i, word(300) + (line if i % 3 == 0 else word(20)) + word(300)) for i in range(n)]


def test_hot_line_is_split(spark, tmp_path, monkeypatch):
    rows = shared_line(1500)
    limit = 20_000
    plain = suffix_dedup._suffixes

    def watched(folder):
        def wrapped(width):
            run = plain(width)

            def seen(table):
                size = sum(len(v) for c in ("segment", "windows") for v in table[c].drop_null().to_pylist())
                (folder / f"{table['shard'][0].as_py()}-{size}").touch()
                return run(table)
            return seen
        return wrapped

    docs = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], SCHEMA)
    sizes = {}
    for hot in (limit, 1 << 30):
        folder = tmp_path / str(hot)
        folder.mkdir()
        monkeypatch.setattr(suffix_dedup, "_suffixes", watched(folder))
        out = remove_repeated_bytes(docs, batch_bytes=50_000, shard_bytes=50_000, hot_bytes=hot)
        got = [(r[ROW].doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest())
               for r in out.collect()]
        assert sorted(got, key=str) == brute(rows, 200)
        sizes[hot] = max(int(f.name.split("-")[1]) for f in folder.iterdir())
    print(sizes)
    assert sizes[1 << 30] > 150_000 and sizes[limit] < sizes[1 << 30] / 2


def test_long_run_of_one_letter(spark):
    began = time.monotonic()
    docs = spark.createDataFrame([(1, "a" * 10_000_000, "x", 1, "y"), (2, "ab" * 1_000_000, "x", 1, "y"),
                                  (3, "a" * 199, "x", 1, "y")], SCHEMA)
    got = {r[ROW].doc_id: (r.n_removed, len(r.spans)) for r in remove_repeated_bytes(docs).collect()}
    assert got == {1: (10_000_000, 1), 2: (2_000_000, 1), 3: (0, 0)}
    assert time.monotonic() - began < 60


def test_empty(spark):
    assert remove_repeated_bytes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark, sf_dir):
    from colloquy.llm.queries import op4_suffix_dedup
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op4_suffix_dedup(spark, sf_dir).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == brute(rows, 200) and sum(r[2] for r in got) > 0
