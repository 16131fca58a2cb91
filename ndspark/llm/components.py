"""Connected components by alternating large-star and small-star steps.

Every step is a partial aggregate for the minimum, then a join of edges with one row per
node; both sides are plain hash exchanges, so adaptive execution splits a hub's partition.
No adjacency list is ever gathered, and the number of edges never grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def _signature(edges: DataFrame) -> tuple:
    """The number of edges, which are distinct, and the exclusive or of their hashes."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.join(least, "u")
        .where("v > u")
        .select(F.col("v").alias("a"), F.col("m").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = (
        edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    )
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """links: two columns of one orderable type, any order, repeats allowed, nulls dropped.

    Returns (node, root) for every node with at least one link to another node; root is the
    smallest node reachable, itself included. Nodes without a link have no row. An empty
    input gives an empty result. Rounds grow with the logarithm of the longest chain.
    """
    x, y = links.columns[:2]
    edges = stage(
        links.where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(x) != F.col(y)))
        .select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
        .distinct(),
        name,
    )
    seen = _signature(edges)
    for _ in range(rounds):
        if not seen[0]:
            break
        after = stage(_small_star(_large_star(edges)), name)
        unstage(edges)
        edges, before, seen = after, seen, _signature(after)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
