"""Copy number from cycle edges and from binned coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepweave.operators.order import running
from stepweave.operators.paths import by_path


def flank_copy_number(steps: DataFrame, reach: int = 20) -> DataFrame:
    """fl, cyc, cn: module ends near a flank node count for fl, others for cyc, a half each; cn = 2 (fl + cyc) / fl, null without fl."""
    near = F.max((F.col("class") == "ref").cast("int")).over(by_path().rowsBetween(-reach, reach - 1))
    ends = steps.withColumn("near", near).filter(F.col("class").isin("cyc_l", "cyc_r"))
    n = ends.agg((F.count_if(F.col("near") == 1) / 2).alias("fl"), (F.count_if(F.col("near") == 0) / 2).alias("cyc"))
    return n.select("fl", "cyc", F.try_divide(2 * (F.col("fl") + F.col("cyc")), F.col("fl")).alias("cn"))


def one_sided_flanks(steps: DataFrame, reach: int = 20) -> DataFrame:
    """Per class of module end: how many have a flank node upstream (cyc_l) or downstream (cyc_r), and how many lack one."""
    up = F.max((F.col("class") == "ref").cast("int")).over(by_path().rowsBetween(-reach, -1))
    down = F.max((F.col("class") == "ref").cast("int")).over(by_path().rowsBetween(1, reach))
    ends = steps.withColumn("near", F.coalesce(F.when(F.col("class") == "cyc_l", up).otherwise(down), F.lit(0))).filter(F.col("class").isin("cyc_l", "cyc_r"))
    return ends.groupBy("class").agg(F.count_if(F.col("near") == 1).alias("fl"), F.count_if(F.col("near") == 0).alias("cyc"))


def binned_coverage(aligned: DataFrame, width: int = 50) -> DataFrame:
    """node, bin, coverage: covered bases over the bin's width; aligned has node, size, start, end (half open).

    Each alignment is dealt to the bins that it touches by arithmetic, so that nothing is joined; bins without reads are absent.
    """
    touched = aligned.filter("`end` > start").withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    low = F.col("bin") * width
    high = F.least(low + width, F.col("size"))
    part = F.greatest(F.lit(0), F.least("end", high) - F.greatest("start", low))
    return touched.groupBy("node", "bin").agg(F.try_divide(F.sum(part).cast("double"), F.max(high - low)).alias("coverage"))


def edge_sides(steps: DataFrame) -> DataFrame:
    """node, enode, side, n: neighbours of ref and none nodes."""
    rows = steps.withColumn("before", F.lag("node").over(by_path())).withColumn("after", F.lead("node").over(by_path())).filter(F.col("class").isin("ref", "none"))
    both = rows.select("node", F.inline(F.array(F.struct(F.col("before").alias("enode"), F.lit("in").alias("side")), F.struct(F.col("after").alias("enode"), F.lit("out").alias("side")))))
    return both.filter("enode is not null").groupBy("node", "enode", "side").agg(F.count(F.lit(1)).alias("n"))


def mode_estimate(values: DataFrame, least: float = 0.0, share: float = 0.1) -> DataFrame:
    """The densest run of values less than a tenth of the mean apart; its median, and its size. values has x; the mean is over all x.

    Runs begin at values of at least `least`; ties go to the least start. How many values lie before each value and before the end of its run
    comes from one running sum over distinct values and run ends, dealt by range: nothing is joined by inequality.
    """
    width = values.agg((F.avg("x") * share).alias("w"))
    counts = values.groupBy("x").agg(F.count(F.lit(1)).alias("k")).crossJoin(F.broadcast(width))  # one row
    none = F.lit(0).cast("long")
    points = counts.select(F.col("x").alias("at"), F.lit(1).alias("kind"), F.col("x").alias("of"), F.col("k"))
    # a difference below the width, taken as the strict test takes it: the end is the first value that is not inside
    points = points.unionByName(counts.select((F.col("x") + F.col("w")).alias("at"), F.lit(0).alias("kind"), F.col("x").alias("of"), none.alias("k")))
    run = running(points, ["at", "kind", "of"], "k")
    begins = run.filter("kind = 1").select("of", (F.col("run") - F.col("k")).alias("before"))
    ends = run.filter("kind = 0").select("of", F.col("run").alias("until"))
    best = begins.join(ends, "of").filter(F.col("of") >= least).select(F.col("of").alias("x"), (F.col("until") - F.col("before")).alias("n")).orderBy(F.desc("n"), "x").limit(1)
    best = best.crossJoin(width)  # one row each
    inside = values.crossJoin(F.broadcast(best.select(F.col("x").alias("low"), "w"))).filter((F.col("x") >= F.col("low")) & (F.col("x") < F.col("low") + F.col("w")))
    return inside.agg(F.percentile("x", F.lit(0.5)).alias("mode"), F.count(F.lit(1)).alias("n"))


def whole_bins(aligned: DataFrame, width: int = 50) -> DataFrame:
    """node, class, bin, coverage of all bins of the nodes that reads touch, 0 where none does. aligned: node, class, size, start, end."""
    bins = aligned.select("node", "class", "size").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / width))))
    return bins.join(binned_coverage(aligned, width), ["node", "bin"], "left").select("node", "class", "bin", F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def coverage_copy_number(aligned: DataFrame, width: int = 50, least: float = 3.0) -> DataFrame:
    """flank, module, cn: the modes of the bins' coverage on ref and on none nodes, and twice the second over the first."""
    bins = whole_bins(aligned.filter(F.col("class").isin("ref", "none")), width)
    one, two = (mode_estimate(bins.filter(F.col("class") == c).select(F.col("coverage").alias("x")), least).select(F.col("mode").alias(n)) for c, n in (("ref", "flank"), ("none", "module")))
    return one.crossJoin(F.broadcast(two)).select("flank", "module", F.try_divide(2 * F.col("module"), F.col("flank")).alias("cn"))


def normalised_coverage(steps: DataFrame) -> DataFrame:
    """Twice each node's visits over the median visits of flank nodes."""
    n = steps.groupBy("node", "class").agg(F.count(F.lit(1)).alias("n"))
    flank = n.filter("class = 'ref'").agg(F.percentile("n", F.lit(0.5)).alias("median"))
    return n.crossJoin(F.broadcast(flank)).select("node", "class", F.try_divide(2.0 * F.col("n"), F.col("median")).alias("cn"))


def allele_balance(steps: DataFrame, region: DataFrame) -> DataFrame:
    """rnode, c2_prop, depth where both modules' alleles are seen."""
    rows = steps.join(region, "node").filter(F.col("class").isin("c1", "c2"))
    is2 = (F.col("class") == "c2").cast("int")
    return rows.groupBy("rnode").agg(F.avg(is2.cast("double")).alias("c2_prop"), F.count(F.lit(1)).alias("depth"), F.max(is2).alias("two"), F.min(is2).alias("one")).filter("two = 1 and one = 0").select("rnode", "c2_prop", "depth")


def n50(lengths: DataFrame) -> DataFrame:
    """median, longest and n50 of lengths (column length): the first one, ascending, at which the running sum passes half."""
    counts = lengths.groupBy("length").agg((F.sum("length")).alias("part"))
    total = counts.agg(F.sum("part").alias("all"))
    half = running(counts, ["length"], "part").crossJoin(F.broadcast(total)).filter("run > all / 2").agg(F.min("length").alias("n50"))
    return lengths.agg(F.percentile("length", F.lit(0.5)).alias("median"), F.max("length").alias("longest")).crossJoin(half)
