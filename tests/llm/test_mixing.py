"""Targets against resharing step by step, and the mix against its budgets."""

import random
from collections import Counter

import pytest

from colloquy.llm.common import ROW
from colloquy.llm.mixing import first_words, mix_sources, source_targets
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, source string, size long, taken string"


def reshared(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    left, free = float(sum(sizes.values())), set(order)
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / total
        left = sum(max(0, target[s] - most * sizes[s]) for s in free)
        for s in order:
            target[s] = min(target[s], most * sizes[s])
        free = {s for s in free if target[s] < most * sizes[s]}
    return target


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 5, 100, 2000, 90_000]) for i in range(rng.randrange(1, 14))} | {None: 40, "é": 7}
    got = {r.source: r.target for r in source_targets(
        spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (1, 2, 3), 3).collect()}
    want = reshared(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)
    assert abs(sum(got.values()) - sum(sizes.values())) < 1e-6 * sum(sizes.values())


def rows():
    rng = random.Random(4)
    out = [(d, " ".join(["w"] * rng.randrange(1, 60)), rng.choice(["a", "a", "a", "b", "c", None]), None, "x")
           for d in range(400)]
    return [*out, out[0], out[0], (None, None, None, None, None), (None, "one two", "b", 1, None), (9, "", "a", 1, "")]


def test_mix(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = [tuple(r) for r in mix_sources(docs, rows_per_bucket=7).select(
        f"{ROW}.doc_id", f"{ROW}.source", "size", "source_size", "target", "taken").collect()]
    again = [tuple(r) for r in mix_sources(docs.repartition(5), rows_per_bucket=100).select(
        f"{ROW}.doc_id", f"{ROW}.source", "size", "source_size", "target", "taken").collect()]
    assert Counter(got) == Counter(again)
    taken, target = Counter(), {}
    for _, source, size, _, t, n in got:
        assert 0 <= n <= 3 * size
        taken[source] += n
        target[source] = t
    assert all(taken[s] == int(target[s] + 1e-6) for s in target)


def test_empty(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0


def test_first_words(spark):
    texts = ["a b c", " a\n b", "a", "日本 é\tx  y "]
    df = spark.createDataFrame([(t, n) for t in texts for n in (1, 2)], "t string, n int")
    for r in df.select("t", "n", first_words(F.col("t"), F.col("n")).alias("f")).collect():
        assert r.f.split() == r.t.split()[:r.n] and r.t.startswith(r.f)
