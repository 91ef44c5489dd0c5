"""Mixing sources to target weights.

Every row gets a hash-random key. Buckets are ranges of that key, so bucket totals summed in
key order and a running sum inside each bucket give the prefix sum of every row without
bringing a source together in one task. A source's budget is cut at its exact word; a budget
above the size of the source repeats it in whole epochs first.

Nulls: a null source is a source of its own, ranked last; a null text has size 0; a null id is
an id like any other. Equal rows are taken one after the other. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import ASCII_SPACE, ROW, WORD, WORD_BREAK, carry, count_words
from colloquy.session import materialise

ROWS_PER_BUCKET = 20_000
ROUNDING = 1e-6  # a target that is whole but for rounding counts as whole
KEY_HEX = 15  # hex digits of the key: 60 bits
MIXED = ("size", "source_size", "target", "taken")


def random_key(seed: int, *parts: Column) -> Column:
    """A 60-bit key that depends on the seed and the parts only."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, KEY_HEX), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Targets share the sum of all sizes by weight; a source stops at ``max_epochs`` times its
    size and what it leaves is shared again by weight. Sorted by the share at which a source
    stops, the stopped sources come first. If the first k were the stopped ones, the rest
    would share at some level per weight; no guess of k exceeds the level of the true one, so
    the largest level is the final one. One row per source passes through one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = (sizes.withColumn("weight", weight)
              .withColumn("cap", max_epochs * F.col("source_size"))
              .withColumn("stop", F.col("cap") / F.col("weight")))
    order = Window.orderBy("stop", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(Window.partitionBy())
              - F.coalesce(F.sum("cap").over(before), F.lit(0)))
             / F.sum("weight").over(onward))
    levels = ranked.withColumn("level", level)
    final = F.max("level").over(Window.partitionBy())
    return (levels.withColumn("final", final)
            .select("source", "source_size",
                    F.least(F.col("cap").cast("double"), F.col("weight") * F.col("final"))
                    .alias("target")))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", weights: Sequence[int] = (1, 2, 3),
                max_epochs: int = 3, seed: int = 7, keep: Sequence[str] | None = None,
                rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Every row with ``size``, ``source_size``, ``target`` and ``taken`` (words, repeats counted).

    The caller's columns ``keep`` (default all) come back in the struct ``_row``.
    """
    buckets = max(1, -(-docs.count() // rows_per_bucket))
    source, size = F.col(f"`{source_col}`"), count_words(F.col(f"`{text_col}`"))
    key = random_key(seed, F.col(f"`{id_col}`"), size)
    bucket = F.floor(key / F.lit(float(16 ** KEY_HEX)) * buckets)
    rows = carry(docs, keep, source=source, size=size, key=key, bucket=bucket)
    totals = materialise(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")),
                         "mix-buckets")
    targets = source_targets(totals.groupBy("source").agg(F.sum("words").alias("source_size")),
                             weights, max_epochs)
    earlier = (Window.partitionBy("source").orderBy("bucket")
               .rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select(
        F.col("source").alias("s"), F.col("bucket").alias("b"),
        F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    plan = materialise(starts.join(targets.withColumnRenamed("source", "t"),
                                   F.col("s").eqNullSafe(F.col("t"))).drop("t"), "mix-plan")
    inside = (Window.partitionBy("s", "b").orderBy("key", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    first = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.floor(F.col("target") + ROUNDING)
    placed = placed.withColumn("budget", budget)
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0)
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    return (placed.withColumn("first", first).withColumn("epochs", epochs)
            .withColumn("part", F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("first"))))
            .withColumn("taken", (F.col("epochs") * F.col("size") + F.col("part")).cast("long"))
            .select(ROW, "size", "source_size", "target", "taken", "epochs", "part"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    gaps = F.regexp_extract(text, f"^{WORD_BREAK}", 0)
    body = F.btrim(text, F.lit(ASCII_SPACE))
    words = F.slice(F.regexp_extract_all(body, F.lit(f"({WORD})(?:{WORD_BREAK})?"), F.lit(0)),
                    1, n.cast("int"))
    return F.rtrim(F.concat(gaps, F.array_join(words, "")), F.lit(ASCII_SPACE))


def mixed_rows(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars",
               **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each row once per whole epoch, and once
    more, cut after its last taken word, where the budget of its source ends inside the epoch.
    """
    mixed = mix_sources(docs, text_col=text_col, **options)
    whole = F.when(F.col("part") == F.col("size"), F.col("epochs") + 1).otherwise(F.col("epochs"))
    cut = (F.col("part") > 0) & (F.col("part") < F.col("size"))
    copies = mixed.withColumn("whole", whole.cast("int")).select(
        ROW, "part", F.explode(F.concat(
            F.array_repeat(F.lit(False), F.col("whole")),
            F.when(cut, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>"))))
        .alias("cut"))
    text = F.col(ROW)[text_col]
    mixed_text = F.when(F.col("cut"), first_words(text, F.col("part"))).otherwise(text)
    out = copies.select(ROW, "cut", mixed_text.alias("_text"))
    fields = []
    for name in docs.columns:
        value = F.col(ROW)[name]
        if name == text_col:
            value = F.col("_text")
        elif name == length_col:
            value = F.when(F.col("cut"), F.length("_text").cast(docs.schema[name].dataType)).otherwise(value)
        fields.append(value.alias(name))
    return out.select(*fields)
