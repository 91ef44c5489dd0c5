"""The data side of hand labelling: what is left, progress, adding new labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Label counts below which more are needed, and above which the set is done.
ENOUGH = 150
TARGET = 200


def unlabelled(items: DataFrame, done: DataFrame, id_col: str = "thread_id") -> DataFrame:
    return items.join(done.select(id_col), id_col, "left_anti")


def append_labels(
    existing: DataFrame, new: DataFrame, id_col: str = "thread_id", latest_wins: bool = False
) -> DataFrame:
    """All labels; with ``latest_wins``, a new label replaces the one with the same id."""
    if latest_wins:
        existing = existing.join(new.select(id_col), id_col, "left_anti")
    return existing.unionByName(new)


def progress(items: DataFrame, done: DataFrame, id_col: str = "thread_id") -> DataFrame:
    """One row: ``total``, ``labelled``, ``remaining``, ``percent`` and ``status``."""
    seen = done.select(id_col).distinct().withColumn("_done", F.lit(1))
    counted = items.join(seen, id_col, "left").agg(
        F.count(F.lit(1)).alias("total"), F.count("_done").alias("labelled"))
    share = F.col("labelled") / F.nullif(F.col("total"), F.lit(0))
    return counted.select(
        "total", "labelled",
        (F.col("total") - F.col("labelled")).alias("remaining"),
        F.floor(share * 100).alias("percent"),
        F.when(F.col("labelled") < ENOUGH, "need_more")
        .when(F.col("labelled") < TARGET, "good").otherwise("complete").alias("status"),
    )


def histogram(df: DataFrame, label: str) -> DataFrame:
    """``(label, n)``, most frequent first."""
    return (df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col(label)))


def majority(df: DataFrame, label: str) -> DataFrame:
    """One row: the most frequent label; ties go to the one that sorts first."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col(label)).limit(1).select(label)
