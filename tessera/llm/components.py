"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import materialize


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """One step. edges: (u, v) with u > v. Neighbours meet their least neighbour through a join, never in one list."""
    if large:
        near = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    near = materialize(near, "near")
    least = materialize(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    joined = near.join(least, "u")
    moved = joined.where("v > u") if large else joined.unionAll(least.select("u", F.col("u").alias("v"), "m"))
    return moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component: the least node) for all nodes of links (a, b); nodes are longs.

    The steps end when neither changes the edges, after about log(size) rounds
    on any graph. Every round is written to the shared folder.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = materialize(edges, "edges")
    state = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v") % 1_000_003)).first())
    before = state(edges)
    while before[0]:
        edges = materialize(_starred(_starred(edges, True), False), "edges")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
