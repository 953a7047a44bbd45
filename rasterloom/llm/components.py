"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _least_of(edges: DataFrame) -> DataFrame:
    """Each node's least neighbour. It is a table of its own, so that a join with a hub's edges can be split."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return materialize(both.groupBy("a").agg(F.min("b").alias("m")), "least")


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` with b < a: what a node leads down to is tied to the least of it."""
    least = materialize(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    linked = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    out = materialize(linked.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
    discard(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component: its least node.

    Nothing but a count and a checksum comes to the driver. Each round's edges are written to
    the shared folder, the last round's deleted; rounds grow with the logarithm of the longest path.
    The result is a table of ``materialize``.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before, least = now, _least_of(edges)
        far = materialize(_large_star(edges, least).filter("a <> b").distinct(), "edges")
        discard(edges, least)
        edges = _small_star(far)
        discard(far)
    named = materialize(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), "classes")
    discard(edges)
    return named
