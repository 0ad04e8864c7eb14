"""Connected components by alternating large-star and small-star over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeweave.llm._store import Scratch


def _least_neighbour(arcs: DataFrame) -> DataFrame:
    """Least node of each node's neighbourhood, itself included; ``min`` combines before the shuffle."""
    return arcs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def large_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Every larger neighbour of a node moves to the least node of its neighbourhood."""
    arcs = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (arcs.join(scratch.table(_least_neighbour(arcs), "least"), "u").where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())


def small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """A node and its smaller neighbours move to the least of them."""
    arcs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = scratch.table(arcs.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = arcs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and an order-free hash of them; numbers, not edges, reach the driver."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v"))).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, component)`` for each node with an edge; the component is its least node.

    Edges are ``(u, v)`` of numbers; loops and repeats do no harm.  Rounds end when both steps
    leave the edges as they are; their number grows with the logarithm of the component's size.
    Each round's edges are a table in the shared folder, so a lost executor costs one round at most.
    """
    edges = scratch.table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        edges = scratch.table(small_star(scratch.table(large_star(edges, scratch), "large"), scratch), "edges")
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    heads = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(heads)
