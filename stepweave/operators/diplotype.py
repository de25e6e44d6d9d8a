"""Scores of haplotype pairs and similarities of subreads."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepweave.operators import pairs as blocks
from stepweave.operators.graph import _settled
from stepweave.operators.order import running


def pair_copies(hap_cov: DataFrame) -> DataFrame:
    """hap1 <= hap2, node, copies: how often each pair of haplotypes (hap, node, n) passes a node. Haplotypes are candidates, few by design."""
    haps = hap_cov.select("hap").distinct()
    pairs = haps.select(F.col("hap").alias("hap1")).join(haps.select(F.col("hap").alias("hap2")), F.expr("hap1 <= hap2"))
    parts = pairs.select("hap1", "hap2", F.explode(F.array("hap1", "hap2")).alias("hap")).join(hap_cov, "hap")
    return parts.groupBy("hap1", "hap2", "node").agg(F.sum("n").alias("copies"))


def pair_metrics(read_cov: DataFrame, hap_cov: DataFrame) -> DataFrame:
    """hap1, hap2, cov_cor, cov_cosine, cov_dev over all nodes that reads (node, n) or the pair cover.

    Correlation is 1 if both variances are 0 and 0.5 if one is. Deviation is minus the mean distance of reads from copies
    times the median of reads per copy. Nodes that a pair lacks enter as totals of one row, so that no pair meets every node.
    """
    total = read_cov.agg(F.sum("n").cast("double").alias("tr"), F.sum(F.col("n").cast("double") * F.col("n")).alias("trr"), F.count(F.lit(1)).alias("tn"))
    rows = pair_copies(hap_cov).join(read_cov.select("node", F.col("n").alias("reads")), "node", "left").withColumn("r", F.coalesce("reads", F.lit(0)).cast("double")).withColumn("c", F.col("copies").cast("double"))
    ratio = rows.groupBy("hap1", "hap2").agg(F.percentile(F.col("r") / F.col("c"), F.lit(0.5)).alias("m"))
    n = rows.join(ratio, ["hap1", "hap2"]).groupBy("hap1", "hap2").agg(
        F.sum("c").alias("sc"), F.sum(F.col("c") * F.col("c")).alias("scc"), F.sum(F.col("r") * F.col("c")).alias("src"),
        F.sum("r").alias("sr"), F.sum(F.abs(F.col("r") - F.col("c") * F.col("m"))).alias("d"), F.count_if(F.col("reads").isNull()).alias("extra"),
    ).crossJoin(F.broadcast(total))
    k = F.col("tn") + F.col("extra")
    cov, vr, vc = F.col("src") * k - F.col("tr") * F.col("sc"), F.col("trr") * k - F.col("tr") * F.col("tr"), F.col("scc") * k - F.col("sc") * F.col("sc")
    cor = F.when((vr == 0) & (vc == 0), 1.0).when((vr == 0) | (vc == 0), 0.5).otherwise(F.try_divide(cov, F.sqrt(vr) * F.sqrt(vc)))
    return n.select("hap1", "hap2", cor.alias("cov_cor"), F.try_divide("src", F.sqrt("trr") * F.sqrt("scc")).alias("cov_cosine"), (-(F.col("d") + F.col("tr") - F.col("sr")) / k).alias("cov_dev"))


def _log_factorial(n):
    """ln n!: a list of the first twelve, Stirling's series from there on (exact to ten places)."""
    x = F.greatest(n, F.lit(12)).cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    few = F.array(*(F.lit(math.lgamma(k + 1)) for k in range(12)))
    return F.when(n < 12, F.get(few, n.cast("int"))).otherwise(series)


def _binomial(reads, p):
    k = F.floor(reads / 2)
    return _log_factorial(reads) - _log_factorial(k) - _log_factorial(reads - k) + k * F.log(p) + (reads - k) * F.log(1 - p)


def pair_likelihood(read_cov: DataFrame, hap_cov: DataFrame, error: float = 0.01) -> DataFrame:
    """hap_ll: over nodes with reads, the binomial log-likelihood of half the visits, with p from the pair's copies: error, 1/2, 1 - error for 0, 1, more."""
    p = F.when(F.col("copies") == 1, 0.5).otherwise(1 - error)
    per_node = read_cov.select("node", F.col("n").alias("reads"), _binomial(F.col("n"), F.lit(error)).alias("none"))
    total = per_node.agg(F.sum("none").alias("all"))
    rows = pair_copies(hap_cov).join(per_node, "node")
    own = rows.groupBy("hap1", "hap2").agg(F.sum(_binomial(F.col("reads"), p) - F.col("none")).alias("own"))
    return own.crossJoin(F.broadcast(total)).select("hap1", "hap2", (F.col("all") + F.col("own")).alias("hap_ll"))


def composite_rank(scores: DataFrame, ratio: list[str], spread: list[str]) -> DataFrame:
    """rank: mean of 1 - adjusted metrics; `ratio` ones over their maximum, `spread` ones between minimum and maximum."""
    totals = scores.agg(*(F.max(c).alias(f"_max_{c}") for c in [*ratio, *spread]), *(F.min(c).alias(f"_min_{c}") for c in spread))
    adjusted = [F.try_divide(F.col(c), F.col(f"_max_{c}")) for c in ratio]
    adjusted += [F.try_divide(F.col(c) - F.col(f"_min_{c}"), F.col(f"_max_{c}") - F.col(f"_min_{c}")) for c in spread]
    total = sum((1 - F.coalesce(a, F.lit(0.0)) for a in adjusted), F.lit(0.0))
    return scores.crossJoin(F.broadcast(totals)).withColumn("rank", total / len(adjusted)).drop(*totals.columns)  # one row


def rank_last(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Descending rank within key; ties get the last rank of them."""
    return rows.withColumn("rk", F.count(F.lit(1)).over(Window.partitionBy(key).orderBy(F.desc(value)).rangeBetween(Window.unboundedPreceding, 0)))


def similarity(observed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """a < b, common, same, sim: subreads (id, marker, allele) compared on the markers that both have, within each value of the columns in `by`.

    A marker stands once for each subread. Where most pairs have markers in common they are compared in blocks (pairs.py), else by a join on the marker.
    """
    by, observed = by or [], _settled(observed)
    if blocks.dense(observed, by):
        n = blocks.counted(blocks.members(observed, by), by)
        return n.withColumn("sim", F.col("same") / F.col("common"))
    two = observed.select(*by, F.col("id").alias("b"), "marker", F.col("allele").alias("other"))
    pairs = observed.select(*by, F.col("id").alias("a"), "marker", "allele").join(two, [*by, "marker"]).filter("a < b")
    n = pairs.groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("common"), F.count_if(F.col("allele") == F.col("other")).alias("same"))
    return n.withColumn("sim", F.col("same") / F.col("common"))


def adjusted_similarity(pairs: DataFrame, least: int, clusters: int, n: int) -> DataFrame:
    """Directed weights a -> b: 1 - rank / threshold among neighbours with at least `least` common markers, 0 from the threshold on."""
    near = pairs.filter(F.col("common") >= least)
    both = near.select("a", "b", "sim").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    limit = n / clusters
    return rank_last(both, "a", "sim").select("a", "b", F.when(F.col("rk") < limit, 1 - F.col("rk") / F.lit(limit)).otherwise(0.0).alias("weight"))


def neighbour_weights(observed: DataFrame, least: int, clusters: int, n: int, by: list[str] | None = None) -> DataFrame:
    """adjusted_similarity of the similarities of subreads (by, id, marker, allele), found in blocks, so that no pairs are shuffled or sorted where most have markers in common."""
    by, observed = by or [], _settled(observed)
    if blocks.dense(observed, by):
        return blocks.weighted(blocks.members(observed, by), by, least, n / clusters)
    near = similarity(observed, by).filter(F.col("common") >= least)
    both = near.select(*by, "a", "b", "sim").unionByName(near.select(*by, F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    rk = F.count(F.lit(1)).over(Window.partitionBy(*by, "a").orderBy(F.desc("sim")).rangeBetween(Window.unboundedPreceding, 0))
    limit = n / clusters
    return both.withColumn("rk", rk).select(*by, "a", "b", F.when(F.col("rk") < limit, 1 - F.col("rk") / F.lit(limit)).otherwise(0.0).alias("weight"))


def quantile_at(rows: DataFrame, value: str, q: float) -> DataFrame:
    """The value at place floor(n q) in ascending order, without interpolation; found in counts of distinct values."""
    counts = rows.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("k"))
    total = counts.agg(F.sum("k").alias("all"))
    return running(counts, ["value"], "k").crossJoin(F.broadcast(total)).filter(F.col("run") > F.floor(F.col("all") * q)).agg(F.min("value").alias("value"))
