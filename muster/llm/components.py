"""Connected components of an edge table, with bounded work a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import join_groups, kept, scratch

Keep = Callable[[DataFrame], DataFrame]


def _met(edges: DataFrame, low: DataFrame, n: int | None, keep: Keep | None) -> DataFrame:
    return edges.join(low, "a") if n is None else join_groups(edges, keep(low), ["a"], n)


def _large_star(edges: DataFrame, n: int | None = None, keep: Keep | None = None) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or itself)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("size"))
    return _met(both.where("b > a"), low, n and 2 * n, keep).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, n: int | None = None, keep: Keep | None = None) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to its smallest neighbour."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("size"))
    moved = _met(edges, low, n, keep).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, small: int = 10_000) -> DataFrame:
    """(node, component): each node that has an edge, and the smallest node of its component.

    edges: two columns of node ids, in any direction, repeats and loops allowed.  Alternating large-star
    and small-star steps (Kiveris et al., 2014) turn each component into a star around its smallest node
    in a number of rounds that grows with the logarithm of its size.  All steps are joins and minimums
    with map-side combining, and a star's centre is joined by a broadcast (``join_groups``; up to ``small`` edges
    are any task's work); each round is written to the shared folder, and only a count and a sum return to the driver.
    """
    a, b = (F.col(f"`{c}`").cast("long") for c in edges.columns[:2])
    with scratch(edges.sparkSession) as keep:
        now = keep(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct())
        mark, n = None, now.count()
        while n:
            if n <= small:
                now = keep(_small_star(_large_star(now), None, None).distinct())
            else:
                large = keep(_large_star(now, n, keep).distinct())
                now = keep(_small_star(large, large.count(), keep).distinct())
            seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if seen == mark:
                break
            mark, n = seen, seen[0]
        heads = now.select(F.col("b").alias("a")).distinct()
        return kept(now.union(heads.select("a", F.col("a").alias("b"))).toDF("node", "component"))
