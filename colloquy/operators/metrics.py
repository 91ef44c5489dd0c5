"""Classification, agreement and rate metrics.

Multi-class metrics come from one confusion table, so predictions are scanned once and
all later steps work on at most (labels x labels) rows per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.session import materialise



def _ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _f1(tp: Column, predicted: Column, support: Column) -> Column:
    return _ratio(2.0 * tp, (predicted + support).cast("double"))


def confusion(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, truth, pred, n)``."""
    return df.groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))


def confusion_matrix(counts: DataFrame, labels: Sequence[str]) -> DataFrame:
    """The confusion table with one column per predicted label."""
    return counts.groupBy("truth").pivot("pred", list(labels)).sum("n").na.fill(0)


def class_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, label, tp, predicted, support)`` over every label in truth or prediction."""
    n, zero = F.col("n"), F.lit(0).cast("long")
    hit = F.when(F.col("truth") == F.col("pred"), n).otherwise(zero)
    sides = F.array(
        F.struct(F.col("truth").alias("label"), hit.alias("tp"),
                 zero.alias("predicted"), n.alias("support")),
        F.struct(F.col("pred").alias("label"), zero.alias("tp"),
                 n.alias("predicted"), zero.alias("support")),
    )
    return (
        counts.select(*by, F.inline(sides))
        .groupBy(*by, "label")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "predicted", "support")])
    )


def class_scores(per_class: DataFrame) -> DataFrame:
    tp, predicted, support = F.col("tp"), F.col("predicted"), F.col("support")
    return per_class.withColumns({
        "precision": _ratio(tp.cast("double"), predicted),
        "recall": _ratio(tp.cast("double"), support),
        "f1": _f1(tp, predicted, support),
    })


def class_report(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted rows."""
    per_class = class_scores(class_counts(confusion(df, truth, pred, by), by))
    cols = ("precision", "recall", "f1", "support")
    total = F.sum("support")

    def weighted(c: str) -> Column:
        return _ratio(F.sum(F.col(c) * F.col("support")), total)

    means = per_class.groupBy(*by).agg(
        F.array(
            F.struct(F.lit("accuracy").alias("label"),
                     *[_ratio(F.sum("tp").cast("double"), total).alias(c) for c in cols[:3]],
                     total.alias("support")),
            F.struct(F.lit("macro avg").alias("label"),
                     *[F.avg(c).alias(c) for c in cols[:3]], total.alias("support")),
            F.struct(F.lit("weighted avg").alias("label"),
                     *[weighted(c).alias(c) for c in cols[:3]], total.alias("support")),
        ).alias("rows"))
    means = means.select(*by, F.inline("rows"))
    return per_class.select(*by, "label", *cols).unionByName(means)


def intent_metrics(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, n, accuracy, macro_f1)``."""
    per_class = class_scores(class_counts(confusion(df, truth, pred, by), by))
    return per_class.groupBy(*by).agg(
        F.sum("support").alias("n"),
        _ratio(F.sum("tp").cast("double"), F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
    )


def binary_metrics(df: DataFrame, truth: Column, pred: Column, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall and F1 of two boolean columns; rows with a null drop out.

    Groups without a valid row are left out.
    """
    rows = df.select(*by, truth.alias("t"), pred.alias("p")).where("t is not null and p is not null")
    t, p = F.col("t"), F.col("p")
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(t & p).alias("tp"),
        F.count_if(p).alias("predicted"),
        F.count_if(t).alias("support"),
        F.count_if(t == p).alias("agreed"),
    ).where("n > 0")
    tp = F.col("tp").cast("double")
    return sums.select(
        *by, "n",
        _ratio(F.col("agreed").cast("double"), F.col("n")).alias("accuracy"),
        _ratio(tp, F.col("predicted")).alias("precision"),
        _ratio(tp, F.col("support")).alias("recall"),
        _f1(F.col("tp"), F.col("predicted"), F.col("support")).alias("f1"),
    )


def escalation_metrics(df: DataFrame, truth: str = "true_escalate",
                       pred: str = "pred_decision", by: Sequence[str] = ()) -> DataFrame:
    """Binary metrics of the decision to escalate, over rows labelled yes or no."""
    valid = df.where(F.col(truth).isin("yes", "no"))
    return binary_metrics(valid, F.col(truth) == "yes",
                          F.coalesce(F.col(pred) == "escalate", F.lit(False)), by)


def kappa(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, n, kappa)``: Cohen's kappa, unweighted; null where chance agreement is 1."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    marginals = class_counts(confusion(pairs, a, b, by), by)
    sums = marginals.groupBy(*by).agg(
        F.sum("support").alias("n"), F.sum("tp").alias("tp"),
        F.sum(F.col("support").cast("double") * F.col("predicted")).alias("chance"))
    n = F.col("n").cast("double")
    observed, expected = F.col("tp") / n, F.col("chance") / (n * n)
    return sums.select(
        *by, "n", F.try_divide(observed - expected, 1.0 - expected).alias("kappa"))


def pearson(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, n, pearson_r)``; null where a rater is constant."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), r.alias("pearson_r"))


def rater_offset(df: DataFrame, rater: str, human: str, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, n, within_one, mean_offset)`` of two ratings."""
    gap = F.col(rater) - F.col(human)
    return df.where(gap.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.abs(gap) <= 1).cast("double")).alias("within_one"),
        F.avg(gap.cast("double")).alias("mean_offset"),
    )


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``(n, kappa, pearson_r, within_one, mean_offset)`` of two ratings.

    Pairs are counted once per combination of ratings; all figures follow from the counts.
    """
    pairs = materialise(df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
                        .groupBy(F.col(a).alias("a"), F.col(b).alias("b"))
                        .agg(F.count(F.lit(1)).alias("w")), "ratings")
    sides = pairs.select(F.inline(F.array(
        F.struct(F.col("a").alias("v"), F.col("w").alias("wa"), F.lit(0).cast("long").alias("wb")),
        F.struct(F.col("b").alias("v"), F.lit(0).cast("long").alias("wa"), F.col("w").alias("wb")))))
    chance = sides.groupBy("v").agg(F.sum("wa").alias("wa"), F.sum("wb").alias("wb")).agg(
        F.sum(F.col("wa").cast("double") * F.col("wb")).alias("chance"))
    w, x, y = F.col("w").cast("double"), F.col("a").cast("double"), F.col("b").cast("double")
    sums = pairs.agg(
        F.coalesce(F.sum("w"), F.lit(0)).alias("n"), F.sum(F.when(x == y, w).otherwise(0.0)).alias("same"),
        F.sum(F.when(F.abs(x - y) <= 1, w).otherwise(0.0)).alias("near"), F.sum(w * x).alias("x"),
        F.sum(w * y).alias("y"), F.sum(w * x * x).alias("xx"), F.sum(w * y * y).alias("yy"),
        F.sum(w * x * y).alias("xy"))
    n = F.col("n").cast("double")
    observed, expected = F.try_divide(F.col("same"), n), F.try_divide(F.col("chance"), n * n)
    spread = F.sqrt(F.greatest(n * F.col("xx") - F.col("x") * F.col("x"), F.lit(0.0))
                    * F.greatest(n * F.col("yy") - F.col("y") * F.col("y"), F.lit(0.0)))
    return sums.crossJoin(chance).select(  # one row each
        "n", F.try_divide(observed - expected, 1.0 - expected).alias("kappa"),
        F.try_divide(n * F.col("xy") - F.col("x") * F.col("y"), spread).alias("pearson_r"),
        F.try_divide(F.col("near"), n).alias("within_one"),
        F.try_divide(F.col("x") - F.col("y"), n).alias("mean_offset"))


def rate_by(df: DataFrame, group: str, flag: Column) -> DataFrame:
    """``(group, n, rate)``: the share of rows with the flag set."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(flag.cast("double")).alias("rate"))


def interval95(share: Column, n: Column) -> Column:
    """Half width of the normal 95% interval of a share."""
    return 1.96 * F.sqrt(share * (1.0 - share) / n)


def error_listing(df: DataFrame, truth: str, pred: str, id_col: str, text: str,
                  examples: int = 3) -> DataFrame:
    """``(truth, pred, n, ids, texts)`` of wrong predictions with the first examples by id.

    The wrong rows are written out once as ids and labels. Examples are cut per map task
    before the shuffle, and only their texts are fetched.
    """
    wrong = materialise(df.where(F.col(truth) != F.col(pred)).select(
        F.col(truth).alias("truth"), F.col(pred).alias("pred"), F.col(id_col).alias("id")), "wrong")
    w = Window.partitionBy("truth", "pred").orderBy("id")
    picked = materialise(
        wrong.withColumn("place", F.row_number().over(w)).where(F.col("place") <= examples),
        "examples")
    texts = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    shown = (
        texts.join(picked, "id").groupBy("truth", "pred")
        .agg(F.array_sort(F.collect_list(F.struct("place", "id", "text"))).alias("e"))
    )
    counts = wrong.groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(shown, ["truth", "pred"]).select(
        "truth", "pred", "n", F.col("e.id").alias("ids"), F.col("e.text").alias("texts"))


def pool_sizes(df: DataFrame, has_context: Column) -> DataFrame:
    """``(has_context, n)``."""
    return df.groupBy(has_context.alias("has_context")).agg(F.count(F.lit(1)).alias("n"))


def compare_context(df: DataFrame, truth: str, with_context: str, without: str) -> DataFrame:
    """One row of accuracy and macro-F1 for two predictions of the same rows."""
    return compare_modes(df.select(
        F.col(truth).alias("truth"),
        F.inline(F.array(
            F.struct(F.lit("with").alias("mode"), F.col(with_context).alias("pred")),
            F.struct(F.lit("without").alias("mode"), F.col(without).alias("pred"))))))


def compare_modes(modes: DataFrame) -> DataFrame:
    """The same from ``(truth, mode, pred)`` rows, the modes being "with" and "without".

    ``n_with_context`` tells how many rows the figures rest on; without any they are null.
    """
    scores = intent_metrics(modes, "truth", "pred", ["mode"])

    def pick(mode: str, c: str) -> Column:
        return F.max(F.when(F.col("mode") == mode, F.col(c)))

    wide = scores.agg(
        F.coalesce(pick("with", "n"), F.lit(0)).alias("n_with_context"),
        *[pick(m, c).alias(f"{c}_{name}") for c in ("accuracy", "macro_f1")
          for m, name in (("with", "with_context"), ("without", "no_context"))])
    return wide.select(
        "n_with_context",
        *[e for c in ("accuracy", "macro_f1") for e in (
            F.round(f"{c}_with_context", 4).alias(f"{c}_with_context"),
            F.round(f"{c}_no_context", 4).alias(f"{c}_no_context"),
            F.round(F.col(f"{c}_with_context") - F.col(f"{c}_no_context"), 4)
            .alias(f"{c}_delta"))])


def long_metrics(metrics: DataFrame, key: str) -> DataFrame:
    """``(key, metric, value)`` rows from one wide row per key."""
    names = [c for c in metrics.columns if c != key]
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                      for c in names])
    return metrics.select(key, F.inline(cells))
