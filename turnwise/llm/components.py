"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _joined(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Each edge (u, v) with the least neighbour of u.

    Adding 0 hides from the planner how ``least`` is dealt out, so that both sides of the join
    are shuffled for it and Spark may split the partition of a node that has very many edges.
    """
    return edges.select("u", "v").join(least.select((F.col("u") + 0).alias("u"), "m"), "u")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node that occurs in ``links`` (a, b: longs); root is its class's least node.

    Each round shuffles the links twice; the number of rounds grows with the logarithm of the
    longest chain. Only one count a round comes to the driver. Raises if ``rounds`` don't suffice.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(rounds):
        before = edges
        # Large star: every larger neighbour of u is tied to u's least neighbour (or u itself).
        both = before.unionByName(before.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        star = _joined(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        star = cut(star)
        # Small star: u and its smaller neighbours are tied to the least of them.
        least = star.groupBy("u").agg(F.min("v").alias("m"))
        kept = _joined(star, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(kept.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        if edges.count() == before.count() and edges.exceptAll(before).isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
    raise RuntimeError(f"the components are not done after {rounds} rounds")
