"""Connected components by alternating large and small stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, root) for every linked node, root being its component's smallest node.

    Loops and rows with a null end are ignored; without links the result is empty. The number of rounds grows
    with the logarithm of the nodes.
    """
    stars = stored(edges.where("a <> b").select("a", "b").distinct(), "links")
    while True:
        stars = stored(_small_star(_large_star(stars)), "stars")
        centres = stars.select(F.col("b").alias("a")).distinct()
        if stars.join(centres, "a", "left_semi").isEmpty() and stars.groupBy("a").count().where("count > 1").isEmpty():
            break  # every node has one centre, and no centre has one itself
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select(F.col("b"), F.col("b")).distinct())
