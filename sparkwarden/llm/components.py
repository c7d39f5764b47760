"""Connected components of a link table by alternating star steps; every step is a join and an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.session import cut_lineage

MAX_STEPS = 60


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves over to the smallest node around it."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("n"), F.least("a", "low").alias("low"))
    return both.filter("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Of a node's smaller neighbours, and the node itself, all point to the smallest."""
    least = links.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("n"), "low")
    moved = links.join(least, F.col("a") == F.col("n"))
    return moved.filter("b > low").select(F.col("b").alias("a"), F.col("low").alias("b")).union(
        least.select(F.col("n").alias("a"), F.col("low").alias("b"))
    )


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def roots(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; the root is the smallest node reachable.

    Links may repeat, be given in either direction or join a node with itself (then left out); links with a
    null end take no part, an empty table gives an empty one. The number of steps grows with the logarithm
    of the longest chain; each step's links are stored in the shared folder, so lost executors cost one step.
    """
    now = cut_lineage(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = _mark(now)
    for _ in range(MAX_STEPS):
        now = cut_lineage(_small_star(_large_star(now).filter("a > b").distinct()).filter("a > b").distinct())
        before, mark = mark, _mark(now)
        if mark == before:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
    raise RuntimeError("components did not settle")
