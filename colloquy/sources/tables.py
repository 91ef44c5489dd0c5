"""Readers and writers of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.rules import labelled
from colloquy.functions.text import blank_to_null
from colloquy.schema import THREADS, TURN, TWEETS
from colloquy.sources.split_csv import read_split_csv

_TURNS = T.ArrayType(TURN)


def _strings(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema])


def read_tweets_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_split_csv(spark, path, TWEETS)


def read_tweets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TWEETS).parquet(path)


def usable_threads(threads: DataFrame) -> DataFrame:
    """Rows with a message and a reply; the empty string counts as missing."""
    texts = {c: blank_to_null(F.col(c)) for c in ("customer_text", "brand_reply")}
    return threads.withColumns(texts).dropna(subset=list(texts))


def read_threads(spark: SparkSession, path: str) -> DataFrame:
    return usable_threads(spark.read.schema(THREADS).parquet(path))


def read_threads_csv(spark: SparkSession, path: str) -> DataFrame:
    """Threads exported with ``write_threads_csv``."""
    rows = read_split_csv(spark, path, _strings(THREADS))
    return usable_threads(rows.withColumns({
        "prior_context": F.from_json("prior_context", _TURNS),
        "escalated": F.col("escalated").cast("boolean")}))


def read_contexts(spark: SparkSession, path: str) -> DataFrame:
    """Two columns only; the rest is never read from disk."""
    return spark.read.schema(THREADS).parquet(path).select("thread_id", "prior_context")


def read_labelled(rows: DataFrame, label: str = "intent") -> DataFrame:
    return rows.where(labelled(F.col(label)))


def read_strings_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Every column as text, missing values as the empty string."""
    return read_split_csv(spark, path, _strings(schema)).na.fill("")


def write_threads(threads: DataFrame, path: str, mode: str = "overwrite") -> None:
    threads.write.mode(mode).parquet(path)


def write_threads_csv(threads: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Prior turns as JSON text."""
    (threads.withColumn("prior_context", F.to_json("prior_context"))
     .write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
     .csv(path))


def write_predictions(preds: DataFrame, path: str, mode: str = "append") -> None:
    """One folder per ``system``."""
    preds.write.mode(mode).partitionBy("system").parquet(path)


def write_split(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per ``split``."""
    rows.write.mode(mode).partitionBy("split").parquet(path)


def write_golden(golden: DataFrame, path: str, mode: str = "overwrite") -> None:
    golden.write.mode(mode).parquet(path)


def write_metrics(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    metrics.write.mode(mode).json(path)


def write_vectors(vectors: DataFrame, path: str, force: bool = False) -> None:
    """``thread_id, customer_text, brand_reply, escalated, embedding``; built once unless forced."""
    cols = ("thread_id", "customer_text", "brand_reply", "escalated", "embedding")
    vectors.select(*cols).write.mode("overwrite" if force else "ignore").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
