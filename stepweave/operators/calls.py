"""Variant calls: support, annotation, filters, and tables for plots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def filter_calls(calls: DataFrame, module: str | None = None, start: int | None = None, end: int | None = None, annotated: bool = False, fusion: bool = False) -> DataFrame:
    """By copy, overlap with [start, end], and annotation or fusion (either one if both are asked for); ascending by pos, then variant."""
    out = calls
    if module is not None:
        out = out.filter(F.col("copy") == f"c{module}")
    if start is not None and end is not None:
        out = out.filter((F.col("pos") <= end) & (F.col("end") >= start))
    tests = [t for want, t in ((annotated, F.col("clinsig").isNotNull()), (fusion, F.col("variant").startswith("fus_"))) if want]
    if tests:
        out = out.filter(tests[0] if len(tests) == 1 else tests[0] | tests[1])
    return out.orderBy("pos", "variant")


def match_annotation(variants: DataFrame, notes: DataFrame) -> DataFrame:
    """Adds clinsig of the last note (by ord) with the variant's pos and alt; the ref allele is not compared."""
    last = notes.groupBy("pos", "alt").agg(F.max_by("clinsig", "ord").alias("clinsig"))
    return variants.join(last, ["pos", "alt"], "left")


def allele_support(steps: DataFrame) -> DataFrame:
    """For two-step alleles src>dst after each node: distinct paths with it, and distinct paths with another."""
    w = Window.partitionBy("path_id").orderBy("pos")
    pairs = steps.select("path_id", F.col("node").alias("src"), F.lead("node").over(w).alias("dst")).filter("dst is not null").distinct()
    alt = pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_alt"))
    all_ = pairs.select("src", "path_id").distinct().groupBy("src").agg(F.count(F.lit(1)).alias("n_all"))
    return alt.join(all_, "src").select("src", "dst", "n_alt", (F.col("n_all") - F.col("n_alt")).alias("n_other"))


def supported(calls: DataFrame, least: int = 3) -> DataFrame:
    """At least `least` reads with the allele, or any haplotype."""
    return calls.filter((F.coalesce(F.size("reads_alt"), F.lit(0)) >= least) | (F.coalesce(F.size("haps_alt"), F.lit(0)) > 0))


def explode_calls(calls: DataFrame) -> DataFrame:
    """One row for each read of a call: read (without its _sr number), variant (its significance where known), allele."""
    label = F.coalesce("clinsig", "variant")
    read = F.regexp_replace(F.col("r"), "_sr[0-9]+$", "")
    part = lambda c, allele: calls.select(F.explode(c).alias("r"), label.alias("label")).select(read.alias("read"), "label", F.lit(allele).alias("allele"))
    return part("reads_alt", "alt").unionByName(part("reads_ref", "ref"))


def pivot_calls(long: DataFrame, labels: list[str]) -> DataFrame:
    """read by label, 1 for alt, 0 for the rest."""
    return long.groupBy("read").pivot("label", labels).agg(F.max(F.when(F.col("allele") == "alt", 1).otherwise(0))).fillna(0)


def top_reads(lengths: DataFrame, n: int) -> DataFrame:
    """The n longest reads of each variant; ties go to the read's name. Rows: variant, read, length."""
    w = Window.partitionBy("variant").orderBy(F.desc("length"), "read")
    return lengths.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
