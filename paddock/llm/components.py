"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import cut

#: A node with over 1 / HOT_SHARE of all edge ends is hot, so there are at most HOT_SHARE of them.
HOT_SHARE = 500


def _to_least(edges: DataFrame, key: str, least: DataFrame, ends: int) -> DataFrame:
    """``edges`` with ``least`` (key, least, degree) of their ``key``.

    The edges of a hot node stay where they are and get its one row by a broadcast of at most
    ``HOT_SHARE`` rows; only the others are shuffled by their key."""
    hot = F.broadcast(least.where(F.col("degree") * HOT_SHARE > ends).select(key, "least"))
    cold = least.where(F.col("degree") * HOT_SHARE <= ends).select(key, "least")
    return edges.join(hot, key).unionByName(edges.join(hot, key, "left_anti").join(cold, key))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node it knows."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"), F.count("*").alias("degree"))
    return _to_least(both, "a", least, 2 * n).where("b > a").select(F.col("least").alias("a"), "b")


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Every node hands its smaller neighbours and itself to the smallest of them; edges run from small to large."""
    least = edges.groupBy("b").agg(F.min("a").alias("least"), F.count("*").alias("degree"))
    joined = _to_least(edges, "b", least, n)
    return (joined.select(F.col("least").alias("a"), F.col("a").alias("c"))
            .unionByName(least.select(F.col("least").alias("a"), F.col("b").alias("c")))
            .where("a <> c").select("a", F.col("c").alias("b")).distinct())


def _state(edges: DataFrame) -> tuple[int, bool]:
    """Number of edges, and whether they are stars: no node has two centres or is both centre and leaf."""
    sides = edges.select(F.col("b").alias("v"), F.lit(1).alias("n")).unionByName(edges.select(F.col("a").alias("v"), F.lit(0).alias("n")))
    busy = F.col("n").isNotNull() & ((F.col("n") > 1) | ((F.col("n") > 0) & (F.col("centre") == 0)))
    row = sides.groupBy("v").agg(F.sum("n").alias("n"), F.min("n").alias("centre")).agg(
        F.sum("n").alias("edges"), F.max(busy).alias("busy")).first()
    return row["edges"] or 0, not row["busy"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected ``edges`` (a, b); the component is its
    smallest node. Self-loops and edges with nulls are ignored, repeated edges count once.

    Each round is two aggregates and two joins over the edges; the rounds grow with the
    logarithm of the longest path. The number of edges, and whether another round is needed, are all that
    reach the driver."""
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    n, settled = edges.count(), False
    while not settled:  # until a forest of stars is left, each around its smallest node
        large = cut(_large_star(edges, n), "stars")  # one edge for each of the n
        edges = cut(_small_star(large, n), "stars")
        n, settled = _state(edges)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
