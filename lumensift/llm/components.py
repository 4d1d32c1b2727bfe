"""Connected components of a table of links, by alternating large-star and small-star steps.

Links and labels stay distributed, as Parquet whose size lets Spark choose its joins; what a step read is deleted after it. A step is one grouping and one join on the node, so a node with very many links is
pre-aggregated and then split by the skew join; the number of links never grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumensift.llm.common import new_path, removed, written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (a, b), a > b. Large: neighbours above a node link to its least neighbour; small: those below, and itself."""
    if large:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        below = links.join(least, "a")
        moved = below.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a long, b long): the least node that is reachable. Self-links and null ends are ignored."""
    ordered = links.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    spark, path, before = links.sparkSession, new_path(links.sparkSession), None
    current = written(ordered, path)
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, last, path = state, path, new_path(spark)
        current = written(_star(_star(current, large=True), large=False), path)
        removed(spark, last)
    spark._jvm.System.gc()  # Spark deletes the shuffle files of the steps once their plans are collected
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
