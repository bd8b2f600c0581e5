"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum (with partial minima in each task) and a join of edges with the minima of their nodes. A
node with a large part of all edges doesn't bring these to one task: the minima of such nodes, of which there can be few,
are broadcast to the edges where they lie. Edges are written to the shared folder after each round;
the rounds end when the edges are stars, which one grouped sum tells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

HUBS = 4000  # a hub has at least 1/HUBS of the edges' ends, so there are no more than HUBS
LEAST = 500


def _with_least(edges: DataFrame, least: DataFrame, bound: int) -> DataFrame:
    """edges (a, b) with m, the least of a's neighbours and a itself; least: (a, m, n)."""
    hubs = F.broadcast(least.where(F.col("n") >= bound).select("a", "m"))
    few = edges.join(hubs.select("a"), "a", "left_anti")
    return few.join(least.where(F.col("n") < bound).select("a", "m"), "a").union(edges.join(hubs, "a").select("a", "b", "m"))


def _large(edges: DataFrame, bound: int) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _with_least(both.where("b > a"), least, bound).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame, bound: int) -> DataFrame:
    """edges: a > b"""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _with_least(edges, least, bound).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each node is either the least of its component or has one edge, to that least one. edges: distinct, a > b"""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    found = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return found.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(edges: DataFrame, store: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for each id in an edge, the smallest id that it is linked to, directly or not. Loops and repeated
    edges do no harm; without edges the result is empty."""
    now = store.keep(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct())
    while not _stars(now):
        bound = max(LEAST, 2 * now.count() // HUBS)
        after = store.keep(_small(_large(now, bound), bound))
        store.drop(now)
        now = after
    roots = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
