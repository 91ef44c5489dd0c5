import hashlib
import math
from collections import Counter

import pytest

from colloquy.operators import labels as lb
from colloquy.operators import sampling as sp
from colloquy.session import spread

SIZES = {"a": 30, "b": 5, "c": 100}


@pytest.fixture(scope="module")
def rows(spark):
    data = [(f"{c}{i}", c) for c, n in SIZES.items() for i in range(n)] + [("x1", None), ("x2", None)]
    return spark.createDataFrame(data, "id string, label string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def key(seed, i):
    return hashlib.md5(f"{seed}|{i}".encode()).hexdigest()


def test_strata(rows):
    out = sp.sample_strata(rows, "label", 22, 1, "id")
    assert Counter(r["label"] for r in out.collect()) == {"a": 22, "b": 5, "c": 22}
    assert ids(out) == ids(sp.sample_strata(rows.repartition(7), "label", 22, 1, "id"))


def test_sample_rows(rows):
    every = [r["id"] for r in rows.collect()]
    assert ids(sp.sample_rows(rows, 10, 3, "id")) == sorted(
        sorted(every, key=lambda i: key(3, i))[:10])
    assert sp.sample_rows(rows, 1000, 3, "id").count() == len(every)
    assert [r["id"] for r in sp.shuffled(rows, 3, "id").collect()] == sorted(
        every, key=lambda i: key(3, i))


def test_golden_sample(rows):
    out = sp.blank_labels(sp.golden_sample(rows, "label", "id", 5)).collect()
    assert len(out) == len({r["id"] for r in out}) == 22 + 5 + 22 + 24
    assert all(r["suggested_intent"] == (r["label"] or "other") for r in out)
    assert {r["intent"] for r in out} == {None}


@pytest.mark.parametrize("bucket_hex", [0, 1, 4])
@pytest.mark.parametrize("share", [0.2, 0.37])
def test_split_quotas(rows, bucket_hex, share):
    out = sp.stratified_split(rows, "label", "id", 9, share, bucket_hex).collect()
    assert len(out) == sum(SIZES.values())
    total = sum(SIZES.values())
    test = math.ceil(round(share * total, 9))
    exact = {c: n * test / total for c, n in SIZES.items()}
    quota = {c: math.floor(e) for c, e in exact.items()}
    for c in sorted(SIZES, key=lambda c: (-(exact[c] - quota[c]), c))[:test - sum(quota.values())]:
        quota[c] += 1
    got = Counter(r["label"] for r in out if r["split"] == "test")
    assert got == quota
    for c in SIZES:
        order = sorted((r["id"] for r in out if r["label"] == c), key=lambda i: (key(9, i), i))
        assert {r["id"] for r in out if r["label"] == c and r["split"] == "test"} == set(
            order[:quota[c]])


def test_equal_remainders_go_by_name(spark):
    counts = spark.createDataFrame([("b", 5), ("a", 5), ("c", 5)], "label string, n long")
    quotas = {r["label"]: r["quota"] for r in sp.split_quotas(counts, "label", 1 / 3).collect()}
    assert quotas == {"a": 2, "b": 2, "c": 1}


def test_labels(spark, rows):
    done = spark.createDataFrame([("a0", "new"), ("zz", "extra")], "id string, label string")
    assert "a0" not in ids(lb.unlabelled(rows, done, "id"))
    assert lb.progress(rows, done, "id").first().asDict() == {
        "total": 137, "labelled": 1, "remaining": 136, "percent": 0, "status": "need_more"}
    assert lb.append_labels(rows, done, "id").count() == 139
    latest = lb.append_labels(rows, done, "id", latest_wins=True)
    assert latest.count() == 138
    assert latest.where("id = 'a0'").first()["label"] == "new"
    assert [tuple(r) for r in lb.histogram(rows.dropna(), "label").collect()] == [
        ("c", 100), ("a", 30), ("b", 5)]
    tie = spark.createDataFrame([("1", "b"), ("2", "a")], "id string, label string")
    assert lb.majority(tie, "label").first()["label"] == "a"


def test_first_rows_and_preview(spark, rows):
    assert [r["id"] for r in sp.first_rows(rows, 2, "id").collect()] == ["a0", "a1"]
    texts = spark.createDataFrame([(2, "x" * 200), (1, "é" * 200)], "id int, t string")
    assert [tuple(r) for r in sp.preview(texts, "id", "t", n=1).collect()] == [(1, "é" * 100)]


def test_small_scans_are_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == cores
    assert spread(spark.range(0, 10, 1, cores + 3)).rdd.getNumPartitions() == cores + 3


def test_quotas_of_very_large_classes(spark):
    counts = spark.createDataFrame([("a", 7_000_000_000), ("b", 1_000_000_000)], "label string, n long")
    got = {r["label"]: r["quota"] for r in sp.split_quotas(counts, "label", 0.2).collect()}
    assert got == {"a": 1_400_000_000, "b": 200_000_000}


def test_strata_above_the_group_limit(spark):
    import hashlib
    rows = [(i, "x" if i % 5 else None) for i in range(4000)] + [(5000, "y")]
    df = spark.createDataFrame(rows, "id long, s string")
    got = {r["id"] for r in sp.sample_strata(df, "s", 1500, 3, "id").collect()}
    key = sorted((hashlib.md5(f"3|{i}".encode()).hexdigest(), i) for i, s in rows if s == "x")
    assert got == {i for _, i in key[:1500]} | {5000}
