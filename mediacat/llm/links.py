"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.llm.shared import removed, written


def components(links: DataFrame, folder: str, name: str) -> DataFrame:
    """node, component (its smallest node) for every node of links (a, b).

    Each round a node takes the smallest label among its neighbours', then the label of its label, so
    long chains shorten by half. Rounds are written tables; all work is joins and minima, no group is
    gathered. Ends when no label changes.
    """
    spark = links.sparkSession
    both = written(
        links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), folder, f"{name}-links"
    )
    labels = written(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")), folder, f"{name}-0")
    n = 0
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("new"))
        up = labels.select(F.col("node").alias("upper"), F.col("label").alias("up"))
        step = written(
            lower.join(up, F.col("new") == F.col("upper"), "left").select(
                "node", F.least("new", "up").alias("label"), (F.least("new", "up") != F.col("label")).alias("moved")
            ),
            folder, f"{name}-{n + 1}",
        )
        moved = not step.where("moved").isEmpty()
        removed(spark, folder, f"{name}-{n}")
        labels, n = step.select("node", "label"), n + 1
        if not moved:
            return labels.withColumnRenamed("label", "component")
