"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerovox.session import store


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) to (v, l): every vertex with the smallest of its component.

    Large-star and small-star steps in turn: each vertex hands its neighbours to the smallest
    one, until the graph is a set of stars. Only minima per vertex are shuffled, no lists of
    neighbours, so a vertex may have any number of edges.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    now = store(edges.select(a.alias("a"), b.alias("b")).where("a > b").distinct(), "edges")
    seen = _digest(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = store(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        before, seen = seen, _digest(now)
        if before == seen:
            break
    return now.select(F.col("a").alias("v"), F.col("b").alias("l"))


def _digest(edges: DataFrame) -> tuple[int, int]:
    mark = F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))
    return tuple(edges.agg(F.count("*"), mark).first())
