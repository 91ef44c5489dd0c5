"""Exact, repeatable samples and splits.

Rows are ordered by ``md5(seed|id)``. The order does not depend on how the data is
partitioned, so every draw can be repeated, and ids must be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.session import materialise

BUCKET_HEX = 4

# The sizes of the golden sample.
PER_STRATUM = 22
RANDOM_SLICE = 24


def hash_key(seed: int, id_col: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in order; a top-n, never a full sort."""
    return df.orderBy(*order).limit(n)


def preview(df: DataFrame, id_col: str, *texts: str, n: int = 3, chars: int = 100) -> DataFrame:
    """The first ``n`` rows by id with texts cut to their first characters."""
    return first_rows(df, n, id_col).select(
        id_col, *[F.substring(t, 1, chars).alias(t) for t in texts])


def sample_rows(df: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """``min(n, rows)`` rows."""
    return df.orderBy(hash_key(seed, id_col), id_col).limit(n)


def shuffled(df: DataFrame, seed: int, id_col: str) -> DataFrame:
    """All rows in a repeatable random order."""
    return df.orderBy(hash_key(seed, id_col), id_col)


def sample_strata(df: DataFrame, stratum: str, n: int, seed: int, id_col: str) -> DataFrame:
    """``min(n, size)`` rows of each non-null stratum.

    Rows are counted per stratum and leading hash digits. Buckets before the one in which a
    stratum's sample ends are taken whole, and only that bucket is ranked row by row, so a
    stratum of any size and a sample of any size spread over many tasks.
    """
    rows = df.where(F.col(stratum).isNotNull()).withColumn("_key", hash_key(seed, id_col))
    rows = rows.withColumn("_bucket", F.substring("_key", 1, BUCKET_HEX))
    upto = Window.partitionBy(stratum).orderBy("_bucket")
    edge = materialise(
        rows.groupBy(stratum, "_bucket").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(upto) - F.col("n")).where(F.col("before") < n)
        .groupBy(stratum).agg(F.max(F.struct("_bucket", "before")).alias("e"))
        .select(stratum, F.col("e._bucket").alias("_edge"), (n - F.col("e.before")).alias("_take")),
        "strata-edges")
    tagged = rows.join(edge, stratum)
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("_key", id_col))
    ranked = tagged.where("_bucket = _edge").withColumn("_place", place).where("_place <= _take")
    sure = tagged.where("_bucket < _edge")
    return sure.unionByName(ranked.drop("_place")).drop("_key", "_bucket", "_edge", "_take")


def golden_sample(
    df: DataFrame,
    stratum: str,
    id_col: str,
    seed: int,
    per_stratum: int = PER_STRATUM,
    random_slice: int = RANDOM_SLICE,
    default: str = "other",
) -> DataFrame:
    """Up to ``per_stratum`` rows of each stratum and a random slice of what is left.

    Adds ``suggested_intent``: the stratum, or ``default`` where a sliced row has none.
    The draws work on ids and strata only, which are written out once because a stratum
    is often the result of costly rules; the chosen ids then fetch their rows.
    """
    keys = materialise(df.select(id_col, stratum), "strata")
    picked = sample_strata(keys, stratum, per_stratum, seed, id_col)
    left = keys.join(picked.select(id_col), id_col, "left_anti")
    chosen = picked.unionByName(sample_rows(left, random_slice, seed + 1, id_col))
    chosen = materialise(
        chosen.withColumn("suggested_intent", F.coalesce(stratum, F.lit(default))), "chosen")
    return df.drop(stratum).join(chosen, id_col)


def blank_labels(golden: DataFrame) -> DataFrame:
    """The columns a human fills in, empty."""
    empty = F.lit(None).cast("string")
    return golden.withColumns(
        {c: empty for c in ("intent", "should_escalate", "reply_quality")})


def split_quotas(counts: DataFrame, label: str, test_share: float) -> DataFrame:
    """``(label, quota)``: test rows per class, by largest remainder.

    ``counts`` has ``label`` and ``n``. The test size is ``ceil(share * rows)``; ties of
    the remainder go to the class whose name sorts first. The table has one row per class.
    """
    total = counts.agg(F.sum("n").alias("total")).withColumn(
        "test", F.ceil(F.round(F.col("total") * test_share, 9)).cast("long"))
    # Whole numbers of 38 digits: exact = n * test / total, kept as quotient and remainder.
    exact = F.col("n").cast("decimal(19,0)") * F.col("test").cast("decimal(19,0)")
    scaled = counts.join(F.broadcast(total)).withColumn("exact", exact.cast("decimal(38,0)")).select(
        label, "test", F.expr("exact div cast(total AS decimal(38,0))").cast("long").alias("base"),
        F.expr("exact % cast(total AS decimal(38,0))").alias("rest"),
    )
    given = scaled.agg(F.sum("base").alias("given"))
    order = Window.orderBy(F.col("rest").desc(), F.col(label))
    return (
        scaled.join(F.broadcast(given))
        .withColumn("place", F.row_number().over(order))
        .select(label, (F.col("base") + (F.col("place") <= F.col("test") - F.col("given"))
                        .cast("long")).alias("quota"))
    )


def stratified_split(
    df: DataFrame,
    label: str,
    id_col: str,
    seed: int,
    test_share: float = 0.2,
    bucket_hex: int = BUCKET_HEX,
) -> DataFrame:
    """``df`` with ``split`` = "test" for an exact share of each class, else "train".

    The rows with the lowest hash keys of each class are the test rows. Instead of sorting
    whole classes, rows are counted per class and leading hash digits; only the one bucket
    in which a class's quota ends is ranked row by row. With 4 digits that is 1/65536 of
    a class, so a class may hold most of the table. The written table of those buckets has
    one row per class and a known size, so the rows meet it without a shuffle. Rows without
    a label are left out.
    """
    rows = df.where(F.col(label).isNotNull()).withColumn("_key", hash_key(seed, id_col))
    rows = rows.withColumn("_bucket", F.substring("_key", 1, bucket_hex))
    buckets = rows.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("n"))
    quotas = split_quotas(buckets.groupBy(label).agg(F.sum("n").alias("n")), label, test_share)
    upto = Window.partitionBy(label).orderBy("_bucket")
    edge = materialise(
        buckets.withColumn("upto", F.sum("n").over(upto))
        .join(quotas, label)
        .where((F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("n") < F.col("quota")))
        .select(label, F.col("_bucket").alias("_edge"),
                (F.col("quota") - (F.col("upto") - F.col("n"))).alias("_take")), "edges")
    tagged = rows.join(edge, label, "left")
    at_edge = F.col("_bucket") == F.col("_edge")
    ranked = tagged.where(at_edge).withColumn(
        "_place", F.row_number().over(Window.partitionBy(label).orderBy("_key", id_col)))
    ranked = ranked.withColumn("split", F.when(F.col("_place") <= F.col("_take"), "test")
                               .otherwise("train")).drop("_place")
    sure = tagged.where(~F.coalesce(at_edge, F.lit(False))).withColumn(
        "split", F.when(F.col("_bucket") < F.col("_edge"), "test").otherwise("train"))
    return sure.unionByName(ranked).drop("_key", "_bucket", "_edge", "_take")
