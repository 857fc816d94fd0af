"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def stars(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(u, v) for every node that isn't the least one of its component, with that one; a table of materialise().

    Each round replaces the links of a node by links to its least neighbour, first for the larger
    neighbours and then for the smaller ones. The number of links never grows and the rounds are about
    the logarithm of the longest chain. Minima are pre-aggregated before the shuffle and joined back by
    a join whose large partitions Spark can split, so a hub doesn't land in one task. Every round is a
    table in the shared folder. Links of a node with itself or with null are ignored.
    """
    edges = materialise(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), ).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.union(both.join(least, "u").where("m < u").select("u", F.col("m").alias("v"))).distinct()
        smaller = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smaller, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last = edges
        edges = materialise(small.union(smaller.select("u", F.col("m").alias("v"))).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        discard(last)
    return edges


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link to another; root is the least node of its component, as of stars()."""
    edges = stars(links, a, b)
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
