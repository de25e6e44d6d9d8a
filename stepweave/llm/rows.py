"""Row numbers where doc_id does not tell rows apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import materialize, shuffles


def numbered(rows: DataFrame) -> DataFrame:
    """Adds row: a number of each row of (doc_id, text, ...), ascending with doc_id (nulls first), then with a hash of the text.

    Where no doc_id is null or repeats, that is doc_id itself. Else the rows are dealt by range, sorted and written once, so that
    every later plan sees the same numbers.
    """
    odd = rows.select("doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null")
    if odd.isEmpty():
        return rows.withColumn("row", F.col("doc_id"))
    text = F.xxhash64("text")
    dealt = rows.repartitionByRange(shuffles(rows.sparkSession), F.col("doc_id"), text).sortWithinPartitions(F.col("doc_id"), text, "text")
    return materialize(dealt.withColumn("row", F.monotonically_increasing_id()), "numbered")[0]
