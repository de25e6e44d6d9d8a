"""Fusions between the two modules: candidates, their support, neighbours, and the choice among neighbouring candidates.

steps: path_id, pos, node, class of subreads. A candidate is (copy, node, dst): the last marker of the module that it begins with, and the next one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepweave.operators.graph import _settled
from stepweave.operators.paths import by_path, marker_windows, markers


def _signal(steps: DataFrame, k: int, purity: int) -> DataFrame:
    rows = marker_windows(steps, k, purity)
    return rows.withColumn("signal", F.coalesce((F.col("up") != F.col("down")), F.lit(False)))


def candidates(steps: DataFrame, k: int = 10, purity: int = 4) -> DataFrame:
    """variant, copy, alt (the two markers): windows that favour different modules, at a marker of the first one that one of the other follows."""
    after = markers(steps).select("path_id", "marker_pos", F.lead("class").over(by_path()).alias("after"), F.lead("node").over(by_path()).alias("dst"))
    own = _signal(steps, k, purity).filter("signal and class = up").join(after, ["path_id", "marker_pos"]).filter("after <> class")
    first = own.groupBy("up", "node").agg(F.min_by("dst", F.struct("path_id", "pos")).alias("dst"))
    return first.select(F.concat_ws("_", F.lit("fus"), "up", "node").alias("variant"), F.col("up").alias("copy"), F.array("node", "dst").alias("alt"))


def support(steps: DataFrame, found: DataFrame, k: int = 10, purity: int = 4, haplotypes: bool = False) -> DataFrame:
    """variant, reads_alt, reads_ref (or haps_): at every window of a candidate's node, alt with a signal from its copy on; ref without a signal, from either copy."""
    rows = _signal(steps, k, purity)
    other = F.when(F.col("up") == "c2", "c1").otherwise("c2")
    own = rows.select("path_id", F.concat_ws("_", F.lit("fus"), F.coalesce("up", F.lit("None")), "node").alias("variant"), F.when(F.col("signal"), "alt").otherwise("ref").alias("kind"))
    across = rows.filter("not signal").select("path_id", F.concat_ws("_", F.lit("fus"), other, "node").alias("variant"), F.lit("ref").alias("kind"))
    seen = own.unionByName(across).join(found.select("variant"), "variant", "left_semi")
    who = "haps" if haplotypes else "reads"
    lists = seen.groupBy("variant").agg(*(F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("path_id")))).alias(f"{who}_{kind}") for kind in ("alt", "ref")))
    return found.join(lists, "variant", "left")


def neighbours(steps: DataFrame, k: int = 10, purity: int = 4) -> DataFrame:
    """node, near: for nodes with a signal the other nodes among the k markers before and the k - 1 after them, over all subreads."""
    around = markers(steps).select("path_id", "marker_pos", F.collect_list("node").over(by_path().rowsBetween(-k, -1)).alias("b"), F.collect_list("node").over(by_path().rowsBetween(1, k - 1)).alias("a"))
    rows = _signal(steps, k, purity).filter("signal").join(around, ["path_id", "marker_pos"]).select("node", F.explode(F.concat("b", "a")).alias("n"))
    return rows.groupBy("node").agg(F.array_sort(F.collect_set("n")).alias("near"))


def order_by_support(calls: DataFrame, least: int = 3) -> DataFrame:
    """Most support first: reads plus `least` for each haplotype; ties by name."""
    return calls.orderBy(F.desc(_weight(least)), "variant")


def _weight(least: int):
    number = lambda c: F.greatest(F.size(c), F.lit(0))
    return number("reads_alt") + least * number("haps_alt")


def choose(calls: DataFrame, near: DataFrame, least: int = 3, by: list[str] | None = None) -> DataFrame:
    """Candidates in order of support; reads and haplotypes that a chosen neighbour has used count no more, and enough have to be left.

    calls: by, variant, alt, reads_alt, haps_alt; near: by, node, near. `by` tells loci and samples apart. A candidate waits only for those before it
    whose node is among its neighbours: in a round all that wait for none are decided, in as many rounds as the longest chain of neighbours has candidates.
    """
    by = by or []
    listed = lambda c: F.coalesce(F.col(c).cast("array<string>"), F.array().cast("array<string>"))
    kinds = {c: calls.schema[c].dataType for c in ("reads_alt", "haps_alt")}
    rows = calls.select(*by, "variant", F.element_at("alt", 1).cast("string").alias("node"), listed("reads_alt").alias("reads"), listed("haps_alt").alias("haps"))
    rows = _settled(rows.withColumn("first", F.struct((-F.size("reads") - least * F.size("haps")).alias("w"), "variant")))
    pairs = near.select(*by, F.col("node").cast("string").alias("node"), F.explode(F.col("near").cast("array<string>")).alias("other"))
    pairs = _settled(rows.select(*by, "variant", "node", "first").join(pairs, [*by, "node"]).select(*by, "variant", "first", "other").distinct())
    others = rows.select(*by, F.col("node").alias("other"), F.col("variant").alias("before"), F.col("first").alias("first2"))
    waits = _settled(pairs.join(others, [*by, "other"]).filter("first2 < first").select(*by, "variant", "before").distinct())
    names = _settled(rows.select(*by, "variant", F.explode(F.concat(F.transform("reads", lambda x: F.struct(F.lit("reads").alias("kind"), x.alias("name"))), F.transform("haps", lambda x: F.struct(F.lit("haps").alias("kind"), x.alias("name"))))).alias("n")).select(*by, "variant", "n.kind", "n.name"))
    open_, used, chosen = _settled(rows.select(*by, "variant")), None, []
    while not open_.isEmpty():
        held = waits.join(open_.withColumnRenamed("variant", "before"), [*by, "before"], "left_semi").select(*by, "variant").distinct()
        ready = _settled(open_.join(held, [*by, "variant"], "left_anti"))
        left = names.join(ready, [*by, "variant"], "left_semi")
        if used is not None:
            taken = waits.join(used, [*by, "before"]).select(*by, "variant", "kind", "name").distinct()  # by those before it, not by all that are decided
            left = left.join(taken, [*by, "variant", "kind", "name"], "left_anti")
        left = _settled(left)
        weight = F.count_if(F.col("kind") == "reads") + least * F.count_if(F.col("kind") == "haps")
        enough = left.groupBy(*by, "variant").agg(weight.alias("w")).filter(F.col("w") >= least).select(*by, "variant")
        kept = _settled(left.join(enough, [*by, "variant"], "left_semi"))
        chosen.append(kept)
        new = kept.select(*by, F.col("variant").alias("before"), "kind", "name")
        used = _settled(new if used is None else used.unionByName(new))
        open_ = _settled(open_.join(ready, [*by, "variant"], "left_anti"))
    if not chosen:
        return calls.limit(0)
    of = lambda kind, c: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("name")))).cast(kinds[c]).alias(c)
    lists = reduce(DataFrame.unionByName, chosen).groupBy(*by, "variant").agg(of("reads", "reads_alt"), of("haps", "haps_alt"))
    return calls.drop("reads_alt", "haps_alt").join(lists, [*by, "variant"])
