"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with a link; the component is its smallest node.

    ``edges`` has columns a and b. Alternates two steps until all links form stars: every
    node shows its larger neighbours the smallest node it knows, then its smaller ones.
    Minima are grouped before they are joined back, so a node with many links is
    one row on one side of each join. No links give no rows.
    """
    pairs = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    pairs = materialise(pairs.distinct(), "links")
    while True:
        if not _no_star(pairs).take(1):
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = least.select("u", F.col("m").alias("v"))
        pairs = materialise(own.unionByName(small).distinct(), "links")


def _no_star(pairs: DataFrame) -> DataFrame:
    """Nodes with two smaller neighbours, or with a smaller and a larger one."""
    ends = pairs.select(F.col("u").alias("x"), "v").unionByName(
        pairs.select(F.col("v").alias("x"), F.lit(None).cast("long").alias("v"))
    )
    seen = ends.groupBy("x").agg(
        F.min("v").alias("low"), F.max("v").alias("high"), F.max(F.col("v").isNull()).alias("head")
    )
    return seen.where("low <> high or (low is not null and head)")
