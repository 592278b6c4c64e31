"""Connected components by alternating large and small stars, with joins and combinable aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _least(pairs: DataFrame) -> DataFrame:
    """Each pair (u, v) with the least member of u's star, u itself included."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _least(both).filter("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    starred = _least(down)
    out = starred.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.union(starred.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) other than the roots; the root is the least node reachable.

    Rounds repeat until the edges are stars and stay the same, about log(n) times. Every round is written to the
    shared folder, so a lost executor costs one round at most. A hub's edges are reduced by partial aggregates and
    joined by a plain equi-join, which adaptive execution splits. Nothing but one count and one sum is collected.
    """
    now = staged(edges.filter("a <> b").select("a", "b").distinct(), "components")
    mark = None
    while True:
        now = staged(_small_star(_large_star(now)), "components")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or seen[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(seen)
