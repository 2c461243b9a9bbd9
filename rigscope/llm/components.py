"""Connected components of a link table by star contraction: one small table a round, nothing on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigscope.llm.tables import materialize


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _smallest(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest node next to u. Written out, so that the join below reads two plain exchanges and
    Spark can split a hub's rows over many tasks."""
    return materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "component-minima")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links``; root is the smallest node that links reach.

    Each round makes every larger neighbour of a node point at the smallest neighbour (large star), then every smaller
    one (small star), until the edges no longer change; rounds grow with the logarithm of the longest chain. Links in
    either direction, repeated links and self links are allowed; links with a null end are ignored.
    An empty table gives an empty table.
    """
    ends = links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ends = materialize(ends.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "component-links")
    alone = ends.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("root"))
    edges = ends.where("u > v")
    before = _fingerprint(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _smallest(both)
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        large = materialize(large, "component-large")
        low = _smallest(large)
        small = (large.join(low, "u")
                 .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                           F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").where("u > v").distinct())
        edges = materialize(small, "component-edges")
        after = _fingerprint(edges)
        if after == before:
            break
        before = after
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    centres = edges.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return (stars.unionByName(centres).unionByName(alone)
            .groupBy("node").agg(F.min("root").alias("root")))
