"""Places and running sums over a whole table, without a window that gathers all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.operators.graph import _settled


def running(rows: DataFrame, order: list[str | Column], value: str | Column | None = None) -> DataFrame:
    """Adds run: the sum of value (1 if None) over the rows up to this one in `order`, which must tell all rows apart.

    Rows are dealt by range; each partition sums its own, and the partitions' totals, a row each, are broadcast.
    """
    value = F.lit(1).cast("long") if value is None else F.col(value) if isinstance(value, str) else value
    dealt = rows.withColumn("_v", value).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = _settled(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id()))
    before = F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    totals = dealt.groupBy("_part").agg(F.sum("_v").alias("_total")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.sum("_v").over(Window.partitionBy("_part").orderBy("_nth").rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(F.broadcast(totals), "_part").withColumn("run", F.col("_before") + own).drop("_v", "_part", "_nth", "_before")


def longest(rows: DataFrame, n: int, order: list[str | Column]) -> DataFrame:
    """The first n rows in `order`; n may grow with the table."""
    return running(rows, order).filter(F.col("run") <= n).drop("run")


def kept_in_order(rows: DataFrame, order: list[str | Column], kept: DataFrame, on: str) -> DataFrame:
    """Rows of which `on` is among kept's, with place: from 1, in the order that they have among all rows."""
    return running(rows.join(kept.select(on).distinct(), on, "left_semi"), order).withColumnRenamed("run", "place")
