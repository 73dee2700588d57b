"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachlens.session import materialize


def _lowest(edges: DataFrame) -> DataFrame:
    """Every edge with the smallest neighbour of its first end."""
    lowest = edges.groupBy("u").agg(F.min("v").alias("low"))
    return edges.join(lowest, "u")


def _state(edges: DataFrame) -> tuple:
    """Count and hash of the edges: one row to the driver."""
    mixed = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), mixed).first())


def components(links: DataFrame) -> DataFrame:
    """``u, v``: every linked vertex but the smallest of its component, with that smallest one.

    ``links`` has two columns of equal, ordered type; null ends and loops are left out. Rounds grow with the logarithm
    of the longest path. A vertex with many links costs one row per link and round: the smallest neighbour is combined
    before the shuffle, and the join that follows may be split by adaptive execution.
    """
    one, other = (F.col(c) for c in links.columns)
    edges = links.select(F.greatest(one, other).alias("u"), F.least(one, other).alias("v"))
    edges = materialize(edges.where(one.isNotNull() & other.isNotNull() & (F.col("u") != F.col("v"))).distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowest(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("low", "u").alias("v"))
        small = _lowest(large.distinct())
        ends = small.select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("low").alias("v"))
        edges = materialize(ends.where(F.col("u") != F.col("v")).distinct(), "stars")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges
