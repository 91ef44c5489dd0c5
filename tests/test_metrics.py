import math

import pytest
from pyspark.sql import functions as F

from colloquy.operators import metrics as mt


def pairs(spark, rows):
    return spark.createDataFrame(rows, "t string, p string")


def one(df):
    return df.first().asDict()


def test_class_only_in_truth_and_only_in_prediction(spark):
    df = pairs(spark, [("a", "a"), ("a", "b"), ("b", "b"), ("c", "d")])
    got = {r["label"]: r for r in mt.class_report(df, "t", "p").collect()}
    assert (got["a"]["precision"], got["a"]["recall"], got["a"]["support"]) == (1.0, 0.5, 2)
    assert (got["c"]["f1"], got["c"]["support"], got["d"]["f1"], got["d"]["support"]) == (0, 1, 0, 0)
    assert got["accuracy"]["f1"] == 0.5
    f1 = [2 / 3, 2 / 3, 0, 0]
    assert got["macro avg"]["f1"] == pytest.approx(sum(f1) / 4)
    assert got["weighted avg"]["f1"] == pytest.approx((2 / 3 * 2 + 2 / 3) / 4)
    assert one(mt.intent_metrics(df, "t", "p")) == pytest.approx(
        {"n": 4, "accuracy": 0.5, "macro_f1": 1 / 3})
    wide = {r["truth"]: r.asDict() for r in mt.confusion_matrix(
        mt.confusion(df, "t", "p"), ["a", "b", "d"]).collect()}
    assert wide["a"] == {"truth": "a", "a": 1, "b": 1, "d": 0}


def test_perfect_and_all_wrong(spark):
    assert one(mt.intent_metrics(pairs(spark, [("a", "a"), ("b", "b")]), "t", "p"))["macro_f1"] == 1
    wrong = one(mt.intent_metrics(pairs(spark, [("a", "b"), ("b", "a")]), "t", "p"))
    assert (wrong["accuracy"], wrong["macro_f1"]) == (0, 0)


def test_binary(spark):
    rows = [("yes", "escalate"), ("yes", "auto"), ("no", "escalate"), ("no", "auto"), ("no", None),
            (None, "escalate"), ("maybe", "escalate")]
    got = one(mt.escalation_metrics(pairs(spark, rows), "t", "p"))
    assert got == {"n": 5, "accuracy": 0.6, "precision": 0.5, "recall": 0.5, "f1": 0.5}
    assert mt.escalation_metrics(pairs(spark, rows[5:]), "t", "p").count() == 0
    never = one(mt.escalation_metrics(pairs(spark, [("yes", "auto")]), "t", "p"))
    assert (never["precision"], never["recall"], never["f1"]) == (0, 0, 0)


def ratings(spark, a, b):
    return spark.createDataFrame(list(zip(a, b)), "a int, b int")


def test_kappa(spark):
    same = [1, 2, 3, 4, 5] * 2
    assert one(mt.kappa(ratings(spark, same, same), "a", "b")) == {"n": 10, "kappa": 1.0}
    assert one(mt.kappa(ratings(spark, [3] * 10, [3] * 10), "a", "b"))["kappa"] is None
    assert one(mt.kappa(ratings(spark, same[:3], same[:3]), "a", "b"))["n"] == 3
    a, b = [1, 1, 2, 2, 3, 3, 1, 2, 3, 1], [1, 2, 2, 2, 3, 1, 1, 2, 3, 3]
    po = sum(x == y for x, y in zip(a, b)) / 10
    pe = sum(a.count(v) * b.count(v) for v in (1, 2, 3)) / 100
    assert one(mt.kappa(ratings(spark, a, b), "a", "b"))["kappa"] == pytest.approx(
        (po - pe) / (1 - pe))


def test_pearson_and_offset(spark):
    a = list(range(10))
    got = one(mt.pearson(ratings(spark, a, [2 * x + 1 for x in a]), "a", "b"))
    assert got["n"] == 10 and got["pearson_r"] == pytest.approx(1)
    assert one(mt.pearson(ratings(spark, a[:2], a[:2]), "a", "b"))["n"] == 2
    assert one(mt.pearson(ratings(spark, a, [3] * 10), "a", "b"))["pearson_r"] is None
    assert one(mt.rater_offset(ratings(spark, [1, 5, 3], [2, 5, 5]), "a", "b")) == pytest.approx(
        {"n": 3, "within_one": 2 / 3, "mean_offset": -1})


def test_rates_and_interval(spark):
    df = pairs(spark, [("a", "x"), ("a", "y"), ("b", "x")])
    got = {r["t"]: (r["n"], r["rate"]) for r in mt.rate_by(df, "t", F.col("p") == "x").collect()}
    assert got == {"a": (2, 0.5), "b": (1, 1.0)}
    half = spark.range(1).select(mt.interval95(F.lit(0.7), F.lit(31))).first()[0]
    assert half == pytest.approx(1.96 * math.sqrt(0.21 / 31))


def test_error_listing(spark):
    df = spark.createDataFrame(
        [(i, "a", "b" if i else "a", f"t{i}") for i in range(6)], "id int, t string, p string, x string")
    row = mt.error_listing(df.repartition(3), "t", "p", "id", "x", examples=2).first()
    assert (row["truth"], row["pred"], row["n"], row["ids"], row["texts"]) == (
        "a", "b", 5, [1, 2], ["t1", "t2"])


def test_agreement_is_the_three_figures_at_once(spark):
    a, b = [1, 2, 3, 4, 5, 5, 4, 1, 2, None], [1, 3, 3, 5, 5, 4, 4, 2, None, 3]
    df = ratings(spark, a, b)
    got = one(mt.agreement(df, "a", "b"))
    assert got["n"] == 8
    assert got["kappa"] == pytest.approx(one(mt.kappa(df, "a", "b"))["kappa"])
    assert got["pearson_r"] == pytest.approx(one(mt.pearson(df, "a", "b"))["pearson_r"])
    offset = one(mt.rater_offset(df, "a", "b"))
    assert (got["within_one"], got["mean_offset"]) == (
        pytest.approx(offset["within_one"]), pytest.approx(offset["mean_offset"]))
    assert one(mt.agreement(df.limit(0), "a", "b")) == {
        "n": 0, "kappa": None, "pearson_r": None, "within_one": None, "mean_offset": None}


def test_compare_context(spark):
    rows = [("a", "a", "b")] * 3 + [("b", "b", "b")] * 3
    df = spark.createDataFrame(rows, "t string, w string, o string")
    got = one(mt.compare_context(df, "t", "w", "o"))
    assert got == {
        "n_with_context": 6, "accuracy_with_context": 1.0, "accuracy_no_context": 0.5,
        "accuracy_delta": 0.5, "macro_f1_with_context": 1.0, "macro_f1_no_context": 0.3333,
        "macro_f1_delta": 0.6667}
    assert one(mt.compare_context(df.limit(0), "t", "w", "o"))["n_with_context"] == 0


def test_partitioning_does_not_matter(spark):
    df = pairs(spark, [("a", "b"), ("b", "b"), ("c", "a")] * 20)
    assert one(mt.intent_metrics(df.repartition(1), "t", "p")) == one(
        mt.intent_metrics(df.repartition(8), "t", "p"))
