"""Views of the star-schema tables as paths, nodes, alignments and intervals, in Spark and as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STEPS_SQL = """steps as (
  select user_id as path_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as pos,
    concat(event_type, '_', cast(event_id % 7 as varchar)) as node,
    case event_type when 'signup' then 'cyc_l' when 'error' then 'cyc_r' when 'click' then 'c1' when 'purchase' then 'c2'
      else case when event_id % 7 = 0 then 'ref' else 'none' end end as class,
    cast(1 + (event_id % 7) * 20 as bigint) as size, value
  from events)"""

READS_SQL = """reads as (select l_orderkey as path_id, l_partkey as node, cast(p_size * 10 as bigint) as size,
    cast(l_quantity as bigint) % (p_size * 10) as start, least(p_size * 10, cast(l_quantity as bigint) % (p_size * 10) + cast(l_quantity as bigint) * 3) as stop
  from lineitem join part on l_partkey = p_partkey)"""

INTERVALS_SQL = """spans as (select o_custkey % 50 as key, o_orderkey as id, datediff('day', date '1990-01-01', cast(o_orderdate as date)) as s,
    datediff('day', date '1990-01-01', cast(o_orderdate as date)) + o_orderkey % 9 as e from orders)"""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_steps(read(spark, sf_dir, "events"))


def event_steps(e: DataFrame) -> DataFrame:
    """Events of a user in order of time as the steps of a path."""
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    inner = F.when(F.col("event_id") % 7 == 0, "ref").otherwise("none")
    kind = F.when(F.col("event_type") == "signup", "cyc_l").when(F.col("event_type") == "error", "cyc_r").when(F.col("event_type") == "click", "c1").when(F.col("event_type") == "purchase", "c2").otherwise(inner)
    return e.select(F.col("user_id").alias("path_id"), pos.cast("long").alias("pos"), F.concat_ws("_", "event_type", F.col("event_id") % 7).alias("node"), kind.alias("class"), (1 + (F.col("event_id") % 7) * 20).cast("long").alias("size"), "value")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, p = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")  # noqa: E741
    q, size = F.col("l_quantity").cast("long"), F.col("p_size") * 10
    return l.join(p, l["l_partkey"] == p["p_partkey"]).select(F.col("l_orderkey").alias("path_id"), F.col("l_partkey").alias("node"), size.cast("long").alias("size"), (q % size).alias("start"), F.least(size.cast("long"), q % size + q * 3).alias("end"))


def spans(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    return read(spark, sf_dir, "orders").filter(where).select((F.col("o_custkey") % 50).alias("key"), F.col("o_orderkey").alias("id"), day.alias("start"), (day + F.col("o_orderkey") % 9).alias("end"))
