"""Connected components of links, by alternating stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def _lowest(edges: DataFrame) -> DataFrame:
    """For each end ``u`` of the edges, the least of itself and its neighbours ``v``."""
    return edges.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))


def _large(edges: DataFrame) -> DataFrame:
    """Ties the larger neighbours of each node to the least node around it."""
    both = edges.union(edges.select("v", "u"))
    return both.join(_lowest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Ties each node and its smaller neighbours to the least of them."""
    low = _lowest(edges)
    return edges.join(low, "u").where("v > low").select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.where("u > low"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component``, the least node that it reaches, of every node with a link to another.

    Hot nodes are aggregated before they are shuffled, and no group is collected; the number of rounds grows with the
    logarithm of the longest chain.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = stored(edges, "edges")
    before = None
    while True:
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            break
        before = seen
        edges = stored(_small(_large(edges).distinct()).distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v")).distinct()
