"""Which module each piece of each read comes from: the table a genotyping run starts with.

Reads events as paths of steps, cuts them at module ends, counts the markers of both modules in each piece and calls the
piece c1, c2 or mixed. Writes `calls` (partitioned by call) and `reads` (one row for each read, partitioned by its number
of modules). A batch job: a rerun replaces both tables with the same rows.

    python -m jobs.module_report --events events.parquet --out report --config jobs/module_report.json
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import config, log, main, write
from stepweave.operators import paths
from stepweave.plans.adapter import event_steps

SETTINGS = {"least_markers": 5, "least_share": 0.8}


def calls(steps: DataFrame, least_markers: int, least_share: float) -> DataFrame:
    """path_id, sub, part, first_pos, n_steps, bp, c1, c2, call: one row for each piece of a read, pieces of lone flanks left out.

    A module piece is called c1 or c2 where it has at least least_markers markers and least_share of them are of one
    module, mixed where it has enough of them and neither share, and unsure where it has fewer; other pieces are flank or none.
    """
    pieces = paths.drop_lone_flanks(paths.split_subreads(steps))
    kind = F.col("class")
    pieces = pieces.groupBy("path_id", "sub", F.col("group").alias("part")).agg(
        F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n_steps"), F.sum("size").alias("bp"), F.count_if(kind == "c1").alias("c1"), F.count_if(kind == "c2").alias("c2")
    )
    markers = F.col("c1") + F.col("c2")
    which = F.when(F.col("c1") >= least_share * markers, "c1").when(F.col("c2") >= least_share * markers, "c2").otherwise("mixed")
    return pieces.withColumn("call", F.when(F.col("part") != "module", F.col("part")).when(markers < least_markers, "unsure").otherwise(which))


def per_read(pieces: DataFrame) -> DataFrame:
    """path_id, modules, c1_pieces, c2_pieces, mixed_pieces, bp of each read."""
    is_call = lambda c: F.count_if(F.col("call") == c)
    return pieces.groupBy("path_id").agg(F.count_if(F.col("part") == "module").alias("modules"), is_call("c1").alias("c1_pieces"), is_call("c2").alias("c2_pieces"), is_call("mixed").alias("mixed_pieces"), F.sum("bp").alias("bp"))


def run(spark: SparkSession, events: str, out: str, least_markers: int = 5, least_share: float = 0.8) -> DataFrame:
    """Reads the events at a path, writes calls and reads under out, and returns the calls as they then stand.

    Events without user, time or id have no place in a path and are left out; repeated ones are steps of their own.
    No events give empty tables.
    """
    rows = spark.read.parquet(events)
    log.info("events: %d rows at %s", rows.count(), events)
    steps = event_steps(rows.filter("user_id is not null and ts is not null and event_id is not null"))
    table = write(calls(steps, least_markers, least_share), f"{out}/calls", "call", "calls")
    write(per_read(table), f"{out}/reads", "modules", "reads")
    return table


if __name__ == "__main__":
    main(lambda spark, args: run(spark, args.events, args.out, **config(spark, args.config, SETTINGS)), "module_report", "events", doc=__doc__)
