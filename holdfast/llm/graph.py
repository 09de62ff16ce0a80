"""Connected components by alternating stars, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.session import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node, are tied to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node``, ``component``: the smallest node that each node reaches, for nodes that have a link.

    Links have no direction; loops, repeated links and links with NULL count for nothing.  Every round writes its
    edges to the shared scratch folder, and the number of rounds grows with the logarithm of the longest chain.
    """
    edges = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where(
        F.col(left).isNotNull() & F.col(right).isNotNull()
    ).where("u <> v").distinct()
    edges = materialize(edges, "edges")
    state = _state(edges)
    while state[0]:
        edges = materialize(_small_star(_large_star(edges)), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
