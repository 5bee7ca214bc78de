"""Connected components of links between numbers, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard import storage


def roots(links: DataFrame) -> DataFrame:
    """node, root (the smallest node it reaches) for every node of links (columns a and b, longs). Each pass costs two shuffles of
    the links left; their number of passes follows the logarithm of the longest path. Nothing but counts reaches the driver."""
    edges = storage.cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        done, edges = edges, storage.cut(small, "links")
        storage.discard(done)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before = now
    node = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return node.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
