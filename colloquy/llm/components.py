"""Connected components of a large graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges to (node, label), the label being the smallest node of the component.

    Each round every node takes the smallest label among its neighbours and then the label of
    that label, so labels travel twice as far each time. Minima are partly taken before the
    shuffle; nothing is gathered per node, and only a count of changes reaches the driver.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"),
                                                                       F.col("a").alias("b"))).distinct(),
                       "edges")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = (both.join(labels, F.col("b") == F.col("node")).groupBy("a")
                .agg(F.min("label").alias("near")))
        met = labels.join(near, F.col("node") == F.col("a")).select(
            "node", "label", F.least("label", "near").alias("step"))
        jump = labels.select(F.col("node").alias("n"), F.col("label").alias("jump"))
        moved = materialise(met.join(jump, F.col("step") == F.col("n"), "left").select(
            "node", F.coalesce(F.least("step", "jump"), "step").alias("label"),
            (F.least("step", "jump") < F.col("label")).alias("changed")), "labels")
        labels = moved.select("node", "label")
        if moved.where("changed").limit(1).count() == 0:
            return labels
