"""Connected components with DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusquery.plans.joins import MAX_BROADCAST_ROWS, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of undirected edges ``(a, b)``; the component is its smallest node.

    Large-star and small-star steps alternate until the edges stop changing,
    which takes a logarithmic number of rounds.  Each round moves only edges:
    minima are combined before the shuffle, and a node that is the hub of very many
    edges gets its minimum by broadcast; there can be only few such nodes.  Every
    round is written to the shared folder, so its lineage is short and survives
    lost executors.

    Edges with a null end and loops are ignored; repeated edges count once.
    Nodes without an edge are not returned.
    """
    ends = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    current = materialize(ends.distinct(), "edges")
    state = _state(current)
    while state[0]:
        current = materialize(_small_star(_large_star(current, state[0]), state[0]), "edges")
        last, state = state, _state(current)
        if last == state:
            break
    leaves = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    """Number of edges and an order-free digest of them."""
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")
    ).first()
    return row["n"], row["x"]


# Rows of one key from which they are joined apart from the others.
HOT_ROWS = 1000


def join_counted(
    rows: DataFrame, side: DataFrame, on: list[str], count: str, total: int, how: str = "inner"
) -> DataFrame:
    """Join ``total`` rows to a side with one row per key, whose ``count`` says how many rows have it.

    Keys of very many rows are broadcast, so their rows stay where they are.  The
    number that makes a key hot grows with the total, so at most
    ``MAX_BROADCAST_ROWS`` keys can be hot.
    """
    least = max(HOT_ROWS, math.ceil(total / MAX_BROADCAST_ROWS))
    hot, rest = (side.where(c).drop(count) for c in (F.col(count) >= least, F.col(count) < least))
    near = rows.join(F.broadcast(hot), on)
    others = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on, how)
    return near.unionByName(others)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node around it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    low = low.select(F.col("u").alias("b"), F.least("u", "m").alias("m"), "n")
    moved = join_counted(edges, low, ["b"], "n", 2 * n).select("a", F.col("m").alias("b"))
    return moved.where(F.col("a") != F.col("b")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Hang the smaller neighbours of a node, and the node, on the smallest of them."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = (
        join_counted(edges, low, ["a"], "n", n)
        .where(F.col("b") != F.col("m"))
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
    )
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()
