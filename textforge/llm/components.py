"""Connected components of an edge table, by large-star and small-star steps on Spark.

Each step replaces the neighbours of a node by their smallest one: a grouped minimum joined back, so
no list of neighbours is ever built. The number of steps grows with the logarithm of the longest
path. Edges are written to the shared folder after each step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textforge.llm.common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(low.select("a", F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(id, root)`` for every node of ``edges (a, b)``; root is the smallest id of the component."""
    edges = materialise(edges.where("a != b").select("a", "b").distinct(), "edges")
    before = _state(edges)
    while before[0]:
        edges = materialise(_small_star(_large_star(edges)).distinct(), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    stars = edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return stars.unionAll(stars.select(F.col("root").alias("id"), "root").distinct()).distinct()
