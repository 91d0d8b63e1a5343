"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HEAVY, materialize, remove, spread_join


def meet(edges: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """Edges joined to (u, m, c) of their first nodes; ``n`` edges in all, ``c`` of the node."""
    return spread_join(edges, nodes, "u", "c") if n > HEAVY else edges.join(nodes.drop("c"), "u")


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node that each node of ``edges`` (u, v) reaches.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each is
    a minimum by node, combined before the shuffle, joined back to the edges;
    the edges of a hub are salted for the join, so they never meet in one task.
    The edges are written to the shared folder after each round; the rounds end
    when they no longer change.
    """
    spark = edges.sparkSession
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, at = materialize(e, "cc")
    paths = [at]
    seen = None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select("u", F.least("u", "m").alias("m"), "c")
        large = meet(both.where("v > u"), least, mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        if mark[0] > HEAVY:
            large, at = materialize(large, "cc-large")
            paths.append(at)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        met = meet(large, low, mark[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, at = materialize(met.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc", 2 * mark[0])
        remove(spark, *paths)
        paths = [at]
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
