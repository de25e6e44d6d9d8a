"""Joins of intervals (key, start, end; both ends included), by bins: an equi-join on (key, bin) and the exact test.

Bins are as wide as the intervals are on average, unless a width is given: then these lie in two bins each on average, however long some are, and what
meets in a bin but does not overlap is a small share.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mean_length(*tables: DataFrame) -> int:
    """The mean length of all intervals, one at least."""
    span = reduce(DataFrame.unionByName, [t.select((F.col("end") - F.col("start") + 1).cast("double").alias("n")) for t in tables])
    return max(1, math.ceil(span.agg(F.avg("n")).first()[0] or 1))


def _binned(df: DataFrame, width: int) -> DataFrame:
    return df.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))


def _in_order(df: DataFrame, width: int) -> DataFrame:
    """Binned rows in the order of their intervals within each bin. Spark leaves out a sort before a join, unless rows are numbered after it."""
    rows = _binned(df, width).repartition("key", "bin").sortWithinPartitions("key", "bin", "start", "end", "id")
    return rows.withColumn("nth", F.monotonically_increasing_id()).filter("nth >= 0").drop("nth")


def overlaps(left: DataFrame, right: DataFrame, width: int | None = None) -> DataFrame:
    """key, l_id, r_id of pairs that share a point. A pair is made in the first bin of both only, so that none repeats.

    Pairs of equal intervals come one after another, with the same ids of the other side in the same order: written, these compress.
    """
    width = width or mean_length(left, right)
    a = _in_order(left.select("key", "id", "start", "end"), width).withColumnsRenamed({"id": "l_id", "start": "ls", "end": "le"})
    b = _in_order(right.select("key", "id", "start", "end"), width).withColumnsRenamed({"id": "r_id", "start": "rs", "end": "re"})
    return a.join(b, ["key", "bin"]).filter((F.col("ls") <= F.col("re")) & (F.col("rs") <= F.col("le")) & (F.col("bin") == F.floor(F.greatest("ls", "rs") / width))).select("key", "l_id", "r_id", "ls", "le", "rs", "re")


def count_overlaps(left: DataFrame, right: DataFrame, width: int | None = None) -> DataFrame:
    n = overlaps(left, right, width).groupBy("key", "l_id").agg(F.count(F.lit(1)).alias("n"))
    return left.select("key", F.col("id").alias("l_id")).join(n, ["key", "l_id"], "left").select("key", "l_id", F.coalesce("n", F.lit(0)).alias("n"))


def within(left: DataFrame, right: DataFrame, width: int | None = None) -> DataFrame:
    """Pairs of different ids where the left one lies inside the right one."""
    return overlaps(left, right, width).filter("ls >= rs and le <= re and l_id <> r_id").select("key", "l_id", "r_id")


def semi(left: DataFrame, right: DataFrame, width: int | None = None, keep: bool = True) -> DataFrame:
    """Left intervals that overlap some right one; with keep=False those that overlap none."""
    hit = overlaps(left, right, width).select("key", F.col("l_id").alias("id")).distinct()
    return left.join(hit, ["key", "id"], "left_semi" if keep else "left_anti")


def band_pairs(left: DataFrame, right: DataFrame, reach: int) -> DataFrame:
    """key and n: pairs of positions (key, at) at most `reach` apart."""
    w = max(1, reach)
    a = left.select("key", F.col("at").alias("p"), F.explode(F.array(*(F.floor(F.col("at") / w) + i for i in (-1, 0, 1)))).alias("bin"))
    b = right.select("key", F.col("at").alias("q"), F.floor(F.col("at") / w).alias("bin"))
    return a.join(b, ["key", "bin"]).filter(F.abs(F.col("p") - F.col("q")) <= reach).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def band_anti(left: DataFrame, right: DataFrame, reach: int) -> DataFrame:
    """Left positions with no right position of their key at most `reach` away."""
    w = max(1, reach)
    near = right.select(F.col("key").alias("k"), F.col("at").alias("q"), F.explode(F.array(*(F.floor(F.col("at") / w) + i for i in (-1, 0, 1)))).alias("near_bin"))
    own = left.withColumn("bin", F.floor(F.col("at") / w))
    return own.join(near, F.expr(f"key = k and bin = near_bin and abs(at - q) <= {int(reach)}"), "left_anti").drop("bin")


def flagged(left: DataFrame, right: DataFrame, width: int | None = None) -> DataFrame:
    """Left intervals with any: whether some right one overlaps them."""
    hit = overlaps(left, right, width).select("key", F.col("l_id").alias("id"), F.lit(True).alias("any")).distinct()
    return left.join(hit, ["key", "id"], "left").withColumn("any", F.coalesce("any", F.lit(False)))


def band_anti_tally(left: DataFrame, right: DataFrame, reach: int) -> DataFrame:
    """key, kept, removed: how many left positions band_anti keeps and removes."""
    kept = band_anti(left, right, reach).groupBy("key").agg(F.count(F.lit(1)).alias("kept"))
    n = left.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(kept, "key", "left")
    return n.select("key", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("n") - F.coalesce("kept", F.lit(0))).alias("removed"))
