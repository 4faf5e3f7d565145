"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import join_groups, materialize


def _is_settled(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and none of those has any: all are stars."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1")
    return not odd.take(1)


def _smallest(edges: DataFrame) -> DataFrame:
    """For each ``u`` its smallest neighbour or itself, and how many edges it has."""
    return materialize(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree")).select("u", F.least("u", "m").alias("m"), "degree"), "minima")


def connected_components(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)``: the smallest node reachable.

    Edges with a null end are ignored; loops make their node a component of
    its own only through other edges. An empty table gives an empty result.

    Each round joins every node with its smallest neighbour (a map-side
    combined minimum) and writes the new edges to the shared folder, so the
    lineage stays short. The minima of nodes with many edges are broadcast, so
    a hub's edges are never gathered in one task (see ``join_groups``). Rounds go on
    until all edges form stars; it raises if ``max_rounds`` are given and
    don't do.
    """
    e = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for done in itertools.count():
        if _is_settled(e):
            break
        if done == max_rounds:
            raise RuntimeError(f"components are not settled after {max_rounds} rounds")
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the larger neighbours of each node go to its smallest
        e = join_groups(both, _smallest(both), "u", "degree").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(e.filter("u <> v").distinct(), "large-star")
        # the smaller neighbours of each node, and the node itself, go to the smallest
        m = _smallest(e)
        e = join_groups(e, m, "u", "degree").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v")))
        e = materialize(e.filter("u <> v").distinct(), "stars")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
