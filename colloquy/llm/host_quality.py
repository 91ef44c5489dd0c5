"""Quality rules with a verdict per host.

A document fails the base rules when it has too few words or too much of it lies in repeated
three-word windows. Failures are summed per host, a host's rate is drawn towards the rate of
all hosts by a beta prior whose strength is estimated from the spread between hosts, and a
host whose drawn rate is above ``max_host_rate`` takes its documents with it.

Everything is DataFrame expressions. Null texts are empty; a null host is a host of its own;
an empty table stays empty. Repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import ASCII_SPACE, ROW, carry, let, words_of
from colloquy.session import materialise

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.5
WINDOW = 3
SYMBOLS = r"[#*$%&|<>]"
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more."""
    hashes = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.least(
            F.lit(WINDOW), p - F.coalesce(F.get(places, i - 1), F.lit(-WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeated(pairs: Column) -> Column:
        def same(x: Column, j: Column) -> Column:
            return F.coalesce(x["h"] == F.get(pairs, j)["h"], F.lit(False))
        flagged = F.filter(pairs, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return let(F.sort_array(F.transform(flagged, lambda x: x["i"])), covered)

    return let(hashes, lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
        let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), repeated)))


def base_metrics(text: Column) -> Column:
    """A struct of the counts in ``METRICS``."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(ASCII_SPACE)) != "")
    of_words = let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(w).cast("long").alias("n_repeat_words")))
    return of_words


def judge_hosts(rows: DataFrame, max_host_rate: float) -> DataFrame:
    """(host, base_failed) rows to (host, n_host, host_rate, host_failed).

    With m the rate over all rows, v the variance of host rates, and w the part of it that
    binomial noise explains, the prior has the weight of m(1-m)/(v-w) - 1 rows; without
    spread beyond noise every host gets the rate m.
    """
    hosts = materialise(rows.groupBy("host").agg(
        F.count("*").alias("n_host"), F.sum(F.col("base_failed").cast("long")).alias("failed")),
        "hosts")
    prior = hosts.agg(
        (F.sum("failed") / F.sum("n_host")).alias("m"),
        F.coalesce(F.var_pop(F.col("failed") / F.col("n_host")), F.lit(0.0)).alias("v"),
        F.avg(1 / F.col("n_host")).alias("inverse")).first()  # one row
    m = prior["m"] or 0.0
    between = (prior["v"] or 0.0) - m * (1 - m) * (prior["inverse"] or 0.0)
    if between > 0:
        weight = max(m * (1 - m) / between - 1, 0.0)
        rate = (F.col("failed") + m * weight) / (F.col("n_host") + weight)
    else:
        rate = F.lit(m)
    return hosts.select("host", "n_host", rate.alias("host_rate"),
                        (rate > max_host_rate).alias("host_failed"))


def host_quality(docs: DataFrame, *, text_col: str = "text", host_col: str = "source",
                 keep: Sequence[str] | None = None, min_words: int = MIN_WORDS,
                 max_repeat_percent: int = MAX_REPEAT_PERCENT,
                 max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Every row with its counts, ``base_failed``, the host's verdict and ``kept``.

    The caller's columns ``keep`` (default all) come back in the struct ``_row``. Counts are
    written once and read for both the host totals and the result.
    """
    counted = carry(docs, keep, host=F.col(f"`{host_col}`"), m=base_metrics(F.col(f"`{text_col}`")))
    failed = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    rows = materialise(counted.select(ROW, "host", "m.*").withColumn("base_failed", failed), "quality")
    hosts = judge_hosts(rows, max_host_rate).withColumnRenamed("host", "of_host")
    joined = rows.join(hosts, F.col("host").eqNullSafe(F.col("of_host")), "left").drop("of_host")
    return joined.withColumn("kept", ~(F.col("base_failed") | F.col("host_failed")))


def kept_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns."""
    return host_quality(docs, **options).where("kept").select(f"{ROW}.*")
