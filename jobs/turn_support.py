"""How often one node follows another, kept up to date as files of paths arrive: edge support without reading old files again.

A file stream takes the files that are new since the last run (availableNow, checkpoint). A path may grow from file to
file: each step waits in the state of a stream-stream join for the step after it, so an edge is counted once, in the run
that brings its second end. Each batch leaves its counts in a folder of its own, which a repeated batch replaces; their
sum is the table `support` (src, dst, n, share, best), partitioned by the kind of src, the part of its name before `_`.
Conversations are the paths here: a turn is a step, its node the role and the length class of the text.

    python -m jobs.turn_support --paths conversations.parquet --out support --config jobs/turn_support.json
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import config, log, main, settings, write
from stepweave.operators import paths as operators

WORDS = r"size(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 0))"
NODE = f"concat(coalesce(role, 'none'), '_', case when {WORDS} < 8 then 'short' when {WORDS} < 64 then 'middle' else 'long' end)"
SETTINGS = {"path": "conv_id", "pos": "turn", "node": NODE, "max_files": 64}
EDGES = "src string, dst string, n long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def steps_of(rows: DataFrame, path: str, pos: str, node: str) -> DataFrame:
    """path_id, pos, node of rows, by SQL expressions; a null node is named none."""
    return rows.select(F.expr(path).alias("path_id"), F.expr(pos).cast("long").alias("pos"), F.coalesce(F.expr(node).cast("string"), F.lit("none")).alias("node"))


def run(spark: SparkSession, paths: str, out: str, path: str = "conv_id", pos: str = "turn", node: str = NODE, max_files: int = 64) -> DataFrame:
    """Takes the files at `paths` that out's checkpoint has not seen, and returns the support table as it then stands."""

    def keep(batch: DataFrame, number: int) -> None:
        made = batch.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
        place = f"{out}/increments/batch={number}"
        made.write.mode("overwrite").parquet(place)
        log.info("batch %d: wrote %d kinds of edges to %s", number, made.sparkSession.read.schema(EDGES).parquet(place).count(), place)

    with settings(spark, spark_sql_streaming_stateStore_providerClass=ROCKS):
        place = paths.rstrip("/")
        pattern = f"{place[:-1]}[{place[-1]}]"  # a file stream takes a folder or a pattern; as a pattern, one file will do too
        stream = spark.readStream.schema(spark.read.parquet(paths).schema).option("maxFilesPerTrigger", max_files).parquet(pattern)
        edges = operators.neighbour_edges(steps_of(stream, path, pos, node))
        query = edges.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    for progress in query.recentProgress:
        log.info("batch %d: read %d rows from %s", progress.batchId, progress.sources[0].numInputRows, paths)
    if not query.recentProgress:
        log.info("nothing new at %s", paths)
    # an empty table beside the batches, so that there is one to read whatever has arrived
    spark.createDataFrame([], EDGES).write.mode("overwrite").parquet(f"{out}/increments/batch=-1")
    table = operators.ranked_successors(spark.read.schema(EDGES).parquet(f"{out}/increments"))
    return write(table.withColumn("kind", F.substring_index("src", "_", 1)), f"{out}/support", "kind", "support")


if __name__ == "__main__":
    main(lambda spark, args: run(spark, args.paths, args.out, **config(spark, args.config, SETTINGS)), "turn_support", "paths", doc=__doc__)
