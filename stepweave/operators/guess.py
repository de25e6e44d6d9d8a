"""Which module a path is of, guessed from the nodes it passes: principal components of presence vectors."""

from __future__ import annotations

from pyspark.ml.feature import PCA, CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = 65_535  # the widest vectors that the principal components are made of: the nodes of one locus


def components(steps: DataFrame, k: int = 2) -> DataFrame:
    """path_id, pc1 to pck: principal components, centred, of which nodes each path (path_id, node) passes.

    Presence vectors are sparse, and the covariance is summed over partitions. A component's sign is that which makes its value at the least path_id
    that has one other than 0 greater than 0.
    """
    sets = steps.groupBy("path_id").agg(F.collect_set(F.col("node").cast("string")).alias("nodes"))
    if steps.select("node").distinct().limit(NODES + 1).count() > NODES:
        raise ValueError(f"a locus has at most {NODES} nodes here")
    present = CountVectorizer(inputCol="nodes", outputCol="present", vocabSize=NODES, binary=True).fit(sets).transform(sets)
    scored = PCA(k=k, inputCol="present", outputCol="pcs").fit(present).transform(present).select("path_id", "pcs")
    mean = scored.select(Summarizer.mean(F.col("pcs")).alias("m")).first()["m"]
    value = lambda i: F.round(F.get(vector_to_array("pcs"), F.lit(i)) - F.lit(float(mean[i])), 9)
    flat = scored.select("path_id", *(value(i).alias(f"pc{i + 1}") for i in range(k)))
    signs = flat.agg(*(F.signum(F.min_by(f"pc{i + 1}", F.when(F.abs(f"pc{i + 1}") > 1e-6, F.col("path_id")))).alias(f"s{i + 1}") for i in range(k)))  # one row
    return flat.crossJoin(F.broadcast(signs)).select("path_id", *((F.col(f"pc{i + 1}") * F.coalesce(f"s{i + 1}", F.lit(1.0))).alias(f"pc{i + 1}") for i in range(k)))


def modules(steps: DataFrame) -> DataFrame:
    """path_id, pc1, pc2, module: one for paths with a first component over 0, two for the others."""
    return components(steps, 2).withColumn("module", F.when(F.col("pc1") > 0, "one").otherwise("two"))
