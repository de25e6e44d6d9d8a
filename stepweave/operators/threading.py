"""Diplotypes from clusters: which clusters stand in which order on the two haplotypes, and the haplotypes' node paths.

Orders are found by joins over a frontier of partial haplotypes, for many samples and settings at once. No list of all orders is made: of partial
haplotypes that hold the same clusters and end alike, only the best one can become part of a best diplotype.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepweave.operators.graph import _settled, follow, small


def _gain(seq, known: int, runs):
    """Sum of the n of runs that end in seq after its first `known` tokens."""
    ends = lambda r: F.exists(F.sequence(known + 1, F.size(seq)), lambda j: (j >= F.size(r["run"])) & (F.slice(seq, F.greatest(j - F.size(r["run"]) + 1, F.lit(1)), F.size(r["run"])) == r["run"]))
    return F.aggregate(runs, F.lit(0).cast("long"), lambda acc, r: acc + F.when(ends(r), r["n"]).otherwise(F.lit(0)))


def best_pairs(runs: DataFrame, clusters: DataFrame, by: list[str] | None = None, buffer: bool = True) -> DataFrame:
    """by, hap1, hap2, score: the pair of haplotypes, from flankl to flankr, that use each cluster once between them and hold most runs.

    runs: by, run, n, as of haplotypes.adjacency; a pair's score is the sum of n over the runs that stand in one of its haplotypes as neighbours.
    clusters: by, cluster. Buffers stand between two clusters of a haplotype. Ties go to the pair whose first haplotype, the one with the first
    cluster, has the least set of clusters, then to the least orders. A group with fewer than two clusters has no pair.

    Partial haplotypes grow by one cluster in a round; a row is a set of clusters (bits of mask), the last tokens that a run may need, and the best
    order that ends so. k clusters give up to 2^k sets, joined to their complements at the end.
    """
    keys = by or ["_all"]
    if not by:
        runs, clusters = (t.withColumn("_all", F.lit(0)) for t in (runs, clusters))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("cluster")) - 1
    clusters = clusters.select(*keys, F.col("cluster").cast("string").alias("cluster")).distinct().withColumn("place", place)
    clusters = _settled(clusters.withColumn("bit", F.expr("shiftleft(1L, place)")).drop("place"))
    # clusters and flanks stand once in a haplotype, so a run that repeats one stands in none; without these, runs are few, however many reads there are
    once = F.filter(F.col("run").cast("array<string>"), lambda x: x != "buffer")
    runs = runs.filter(F.size(once) == F.size(F.array_distinct(once)))
    told = runs.select(*keys, F.col("run").cast("array<string>").alias("run"), F.col("n").cast("long").alias("n"))
    told = _settled(told.groupBy(*keys).agg(F.collect_list(F.struct("run", "n")).alias("runs"), F.max(F.size("run")).alias("longest")))
    sizes = clusters.groupBy(*keys).agg(F.sum("bit").alias("full"), F.count(F.lit(1)).alias("k"))
    empty = F.expr("cast(array() as array<struct<run: array<string>, n: bigint>>)")
    groups = _settled(sizes.join(told, keys, "left").select(*keys, "full", "k", F.coalesce("runs", empty).alias("runs"), F.greatest(F.coalesce("longest", F.lit(2)) - 1, F.lit(1)).alias("tail")))
    start = F.array(F.lit("flankl"))
    states = groups.select(*keys, F.lit(0).cast("long").alias("mask"), start.alias("last"), start.alias("hap"), F.lit(0).cast("long").alias("score"))
    best, most = None, groups.agg(F.max("k")).first()[0] or 0
    for n in range(most):
        tokens = F.array(*([F.lit("buffer")] if buffer and n else []), F.col("cluster"))
        grown = states.join(clusters, keys).filter(F.col("mask").bitwiseAND(F.col("bit")) == 0).join(groups.select(*keys, "runs", "tail"), keys)
        grown = grown.withColumn("seq", F.concat("last", tokens)).withColumn("score", F.col("score") + _gain(F.col("seq"), F.size("last"), F.col("runs")))
        tail = F.slice("seq", F.greatest(F.size("seq") - F.col("tail") + 1, F.lit(1)), F.col("tail"))
        grown = grown.select(*keys, F.col("mask").bitwiseOR(F.col("bit")).alias("mask"), tail.alias("last"), F.struct((-F.col("score")).alias("s"), F.concat("hap", tokens).alias("hap")).alias("best"))
        states = grown.groupBy(*keys, "mask", "last").agg(F.min("best").alias("best")).select(*keys, "mask", "last", "best.hap", (-F.col("best.s")).alias("score"))
        states = _settled(states)
        closed = states.join(groups.select(*keys, "runs"), keys).withColumn("score", F.col("score") + _gain(F.concat("last", F.array(F.lit("flankr"))), F.size("last"), F.col("runs")))
        closed = closed.groupBy(*keys, "mask").agg(F.min(F.struct((-F.col("score")).alias("s"), F.concat("hap", F.array(F.lit("flankr"))).alias("hap"))).alias("best"))
        best = closed if best is None else best.unionByName(closed)
    if best is None:
        best = states.select(*keys, "mask", F.struct((-F.col("score")).alias("s"), "hap").alias("best"))
    best = _settled(best)
    one = best.filter(F.col("mask").bitwiseAND(F.lit(1)) == 1).join(groups.select(*keys, "full"), keys).withColumn("rest", F.col("full") - F.col("mask"))
    two = best.select(*keys, F.col("mask").alias("rest"), F.col("best").alias("other"))
    pairs = one.join(two, [*keys, "rest"]).select(*keys, F.struct((F.col("best.s") + F.col("other.s")).alias("s"), "mask", F.col("best.hap").alias("hap1"), F.col("other.hap").alias("hap2")).alias("p"))
    return pairs.groupBy(*keys).agg(F.min("p").alias("p")).select(*(by or []), "p.hap1", "p.hap2", (-F.col("p.s")).alias("score"))


def consensus(steps: DataFrame, clusters: DataFrame, start, end, default: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, cluster, path: from node `start` by each cluster's best-supported successor up to node `end`.

    steps: by, id, pos, node; clusters: by, id, cluster. A node that a cluster does not cover is left by its default successor (default: src, dst);
    the walk ends where there is none, or where it would run in a circle. Ties go to the least node. All clusters' walks are followed by doubling.
    """
    by = by or []
    after = F.lead("node").over(Window.partitionBy(*by, "id").orderBy("pos"))
    pairs = steps.withColumn("dst", after).filter("dst is not null").join(clusters.select(*by, "id", "cluster"), [*by, "id"])
    counts = pairs.groupBy(*by, "cluster", F.col("node").alias("src"), "dst").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*by, "cluster", "src").agg(F.min(F.struct((-F.col("n")).alias("m"), "dst")).alias("t")).select(*by, "cluster", "src", F.col("t.dst").alias("dst"))
    names = _settled(clusters.select(*by, "cluster").distinct())
    spare = names.crossJoin(small(default.select("src", F.col("dst").alias("spare"))))  # each cluster needs each default
    table = best.join(spare, [*by, "cluster", "src"], "full").select(*by, "cluster", "src", F.coalesce("dst", "spare").alias("dst")).filter(F.col("src") != F.lit(end))
    state = lambda node: F.struct(*(F.col(c).alias(c) for c in by), F.col("cluster").alias("cluster"), node.alias("node"))
    kind = steps.schema["node"].dataType
    walked = follow(table.select(state(F.col("src")).alias("at"), state(F.col("dst")).alias("to")), names.select(state(F.lit(start).cast(kind)).alias("at")))
    path = F.array_sort(F.collect_list(F.struct("hops", F.col("at.node").alias("node"))))
    rows = walked.groupBy(*(F.col(f"at.{c}").alias(c) for c in by), F.col("at.cluster").alias("cluster")).agg(path.alias("path"))
    return _settled(rows.select(*by, "cluster", F.transform("path", lambda x: x["node"]).alias("path")))


def thread(pairs: DataFrame, walks: DataFrame, flanks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, hap, path of both haplotypes of each pair: the nodes of its tokens one after another. flanks: group, pos, node, as of locus.flank_paths.

    hap names the tokens: l, r and b for the flanks and the buffer, clusters by their own names.
    """
    by = by or []
    short = lambda x: F.when(x == "flankl", "l").when(x == "flankr", "r").when(x == "buffer", "b").otherwise(x)
    haps = pairs.select(*by, F.explode(F.array("hap1", "hap2")).alias("tokens"))
    haps = haps.select(*by, F.array_join(F.transform("tokens", short), "_").alias("hap"), F.posexplode("tokens").alias("place", "token"))
    whole = flanks.groupBy(F.col("group").alias("token")).agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("f")).select("token", F.transform("f", lambda x: x["node"]).alias("flank"))
    own = walks.select(*by, F.col("cluster").cast("string").alias("token"), "path")
    rows = haps.join(own, [*by, "token"], "left").join(small(whole), "token", "left").withColumn("path", F.coalesce("path", "flank", F.array().cast(walks.schema["path"].dataType)))
    parts = F.array_sort(F.collect_list(F.struct("place", "path")))
    return rows.groupBy(*by, "hap").agg(parts.alias("parts")).select(*by, "hap", F.flatten(F.transform("parts", lambda x: x["path"])).alias("path"))
