"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, stage

MAX_ROUNDS = 60


def _distinct_edges(edges: DataFrame) -> DataFrame:
    """Each edge once, the smaller end first, without loops."""
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _ranked(node: str) -> Column:
    """Nodes in a random order that is the same in every round."""
    return F.struct(F.xxhash64(node), F.col(node).alias("to"))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges to (node, comp): comp is the same node for all that are connected, the first of them by a hash. Nodes
    without an edge to another have no row.

    The graph is contracted round by round. In a round every node hops to the first by that hash among itself and its
    neighbours; then each edge is replaced by where its ends have hopped to, and loops and repeats go. The order is
    random, so about two thirds of a chain's nodes go in a round whatever their ids; a star is gone after two. Then
    hops are followed from the last round back to the first. Tables stay distributed and are staged; only whether
    edges are left reaches the driver. Both hops of an edge come from one staged row, so a rerun tears no edge apart.
    """
    left, hops = stage(_distinct_edges(edges), "left"), []
    while not left.isEmpty():
        if len(hops) == MAX_ROUNDS:
            raise RuntimeError(f"edges are left after {MAX_ROUNDS} rounds")
        ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
        near = left.select(ways.alias("way")).select("way.a", "way.b").groupBy("a").agg(F.min(_ranked("b")).alias("near"))
        hop = stage(near.select(F.col("a").alias("node"), F.least(_ranked("a"), "near")["to"].alias("to")), "hops")
        one, two = hop.toDF("a", "to_a"), hop.toDF("b", "to_b")
        fewer = _distinct_edges(left.join(one, "a").join(two, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")))
        fewer = stage(fewer, "left")
        discard(left)
        left = fewer
        hops.append(hop)
    labels = hops.pop() if hops else left
    while hops:
        # Where a node of this round ends: where the node it hopped to ends.
        hop = hops.pop()
        ends = stage(hop.join(labels.toDF("to", "end"), "to", "left").select("node", F.coalesce("end", "to").alias("to")), "labels")
        discard(hop, labels)
        labels = ends
    if labels is not left:
        discard(left)
    named = labels.toDF("node", "comp")
    named.staged_at = labels.staged_at
    return named
