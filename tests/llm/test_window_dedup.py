"""Substring dedup against a direct reading of its rule."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import rolling as rk
from colloquy.llm.common import ROW
from colloquy.llm.window_dedup import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, id string, batch int, spans string"


def brute(rows, width):
    ids = [-(1 << 63) if d is None else d for d, _ in rows]
    words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for i, w in zip(ids, words, strict=True):
        for j in range(len(w) - width + 1):
            key = tuple(w[j:j + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in zip(ids, words, strict=True):
        gone = set()
        for j in range(len(w) - width + 1):
            if first[tuple(w[j:j + width])] < i:
                gone.update(range(j, j + width))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((None if i == -(1 << 63) else i, len(w), len(gone), kept))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "ab", "ß", "日本", "x y", "\u0085", "z" * 40]
    passages = [[rng.choice(vocabulary) for _ in range(n)] for n in (5, 7, 9, 30)]
    rows = []
    for d in range(40):
        w = []
        for _ in range(rng.randrange(5)):
            w += rng.choice(passages) if rng.random() < .6 else [rng.choice(vocabulary) for _ in range(6)]
        rows.append((rng.randrange(30), rng.choice([" ", "\n", " \t"]).join(w)))
    return [*rows, rows[3], (None, None), (None, " ".join(passages[3])), (None, " ".join(passages[3])),
            (50, ""), (51, " \n"), (52, " ".join(passages[3] * 40))]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("batch_bytes", [300, 1 << 20])
def test_against_rule(spark, seed, batch_bytes):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], SCHEMA)
    out = remove_repeats(docs, width=5, batch_bytes=batch_bytes, bucket_bytes=batch_bytes)
    got = out.select(f"{ROW}.doc_id", "n_words", "n_removed", "kept_text", "spans", f"{ROW}.batch").collect()
    assert sorted((tuple(r[:4]) for r in got), key=str) == brute(rows, 5)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and r.batch == 1
        assert all(x.end < y.start for x, y in zip(r.spans, r.spans[1:]))


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rolling_equals_horner():
    x = np.random.default_rng(0).integers(0, 1 << 63, 300).astype(np.uint64)
    for width in (1, 2, 5, 50, 200, 300, 301):
        want = [sum(int(v) * pow(rk.BASE, width - 1 - j, 1 << 64) for j, v in enumerate(x[i:i + width])) % (1 << 64)
                for i in range(len(x) - width + 1)]
        assert rk.rolling(x, width).tolist() == want


def test_long_words_and_blocks(monkeypatch):
    monkeypatch.setattr(rk, "BLOCK", 16)
    text = (b"ab " * 9 + b"q" * 50 + b" ab\tab\n" + b"q" * 50)
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = rk.word_edges(data, np.array([0, len(data)]))
    words = [text[a:b] for a, b in zip(starts, ends, strict=True)]
    assert words == text.split()
    h = rk.word_hashes(data, starts, ends)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert (h[i] == h[j]) == (a == b)


def test_query(spark, sf_dir):
    from colloquy.llm.queries import op3_window_dedup
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = [(d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, n, g, t in brute(rows, 50)]
    got = op3_window_dedup(spark, sf_dir).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert got.agg(F.sum("n_removed")).first()[0] > 0
