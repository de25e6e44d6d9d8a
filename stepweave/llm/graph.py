"""Connected components of link tables, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node it is linked with) of every node in links (a, b).

    Each round hangs every node's greater neighbours on its least one, then every node and its smaller neighbours
    on the least of them; a component of n nodes is a star after O(log n) rounds. Hubs are joined as a table, not
    collected; a round's links are a table in the shared folder. Loops and repeated links are allowed; nulls are dropped.
    """
    spark = links.sparkSession
    current, path = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new, new_path = materialize(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(spark, path)
        path, current = new_path, new
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
