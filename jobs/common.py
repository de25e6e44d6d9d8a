"""What the jobs share: config files and folders read through Spark, logged counts, command lines."""

from __future__ import annotations

import argparse
import json
import logging
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def config(spark: SparkSession, path: str, known: dict) -> dict:
    """The settings of a JSON file, over the job's own; the path may be remote. A setting the job does not know is an error."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    given = json.loads(text)
    if unknown := set(given) - set(known):
        raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
    return {**known, **given}


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one that spark.checkpoint.dir names; a temporary one where that is unset and Spark runs in one process."""
    shared = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="jobs-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, **wanted: str) -> Iterator[None]:
    """Session settings for the length of a block; what stood before is put back. Names have underscores for dots."""
    names = {k.replace("_", "."): v for k, v in wanted.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write(df: DataFrame, path: str, by: str, name: str) -> DataFrame:
    """Parquet in place of what the folder held, in partitions of a column, with files of even size. Logs the rows and returns the table."""
    df.hint("rebalance", by).write.mode("overwrite").partitionBy(by).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    log.info("%s: wrote %d rows to %s", name, table.count(), path)  # the count is in the files' footers
    return table


def main(run: Callable[[SparkSession, argparse.Namespace], DataFrame], name: str, *inputs: str, doc: str | None = None) -> None:
    """Command line: one path for each input, --out and --config; starts a session and stops it."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=doc)
    for i in inputs:
        parser.add_argument(f"--{i}", required=True, help=f"folder or file of the {i}, Parquet")
    parser.add_argument("--out", required=True, help="folder that the job writes to")
    parser.add_argument("--config", required=True, help="JSON file of settings")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, args)
    finally:
        spark.stop()
