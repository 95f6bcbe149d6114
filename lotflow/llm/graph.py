"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotflow.llm.common import discard, stored


def _is_star_forest(edges: DataFrame) -> bool:
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("high")).unionAll(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("low"), F.lit(1).alias("high")))
    sums = ends.groupBy("node").agg(F.sum("low").alias("low"), F.max("high").alias("high"))
    return sums.filter((F.col("low") > 1) | ((F.col("low") > 0) & (F.col("high") > 0))).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links(a, b)``; a component's name is its smallest node.

    Large-star and small-star steps alternate until each node hangs on its component's smallest node.  A step takes
    a minimum per node (combined before the shuffle) and joins it back, so a node with very many links is split like
    any other hot join key.  Rows with a null end are ignored; no links give no rows.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _is_star_forest(edges):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, "large-star")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            lowest.select("a", F.col("m").alias("b"))).distinct()
        before, edges = edges, stored(small, "small-star")
        discard(before, large)
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    out.stored_at = edges.stored_at
    return out
