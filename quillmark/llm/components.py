"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def components(links: DataFrame) -> DataFrame:
    """links: (a, b). Returns (node, root) for every node but the roots; root is the least node of its component.

    Each step is grouped minima and joins on a node, so a node of very many links is pre-aggregated or split, never held.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")  # so that the join may split a root's many links
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        release(before, low)
        # Done when every node hangs on one root and no root on anything.
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("low")), F.struct(F.col("v").alias("x"), F.lit(0).alias("low")))).alias("e"))
        if ends.groupBy("e.x").agg(F.sum("e.low").alias("hangs"), F.min("e.low").alias("low")).where("hangs > 1 or (hangs = 1 and low = 0)").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
