"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.session import written

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours to the least of them. Edges come with u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge to another one; component is its least reachable node.

    Alternating large and small stars, written to the shared folder after each round, until nothing changes: rounds grow with the logarithm of the
    longest path. Minima are taken before rows meet, and joins on a node with many edges are left to Spark to split. Null ends,
    loops and repeated edges count for nothing; no edges give no rows.
    """
    edges = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = written(edges, "edges")
    for _ in range(MAX_ROUNDS):
        many = edges.groupBy("u").count().where("count > 1").limit(1).count()
        if not many and not edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():  # every edge leads to a least node
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        edges = written(_small_star(_large_star(edges)), "edges")
    raise RuntimeError("components did not settle")
