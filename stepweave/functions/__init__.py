"""Column functions on alignments, paths and sequences; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_cigar(cigar: Column) -> Column:
    """array<struct<n: int, op: string>> of a CIGAR string."""
    n = F.regexp_extract_all(cigar, F.lit(r"([0-9]+)([A-Z=])"), F.lit(1))
    op = F.regexp_extract_all(cigar, F.lit(r"([0-9]+)([A-Z=])"), F.lit(2))
    return F.zip_with(n, op, lambda a, b: F.struct(a.cast("int").alias("n"), b.alias("op")))


def parse_difference(cs: Column) -> Column:
    """Operations of a short difference string: :n and *xy as M, +seq as I, -seq as D; neighbours of one kind are added up."""
    token = F.regexp_extract_all(cs, F.lit(r"(:[0-9]+|\*[a-z]{2}|\+[A-Za-z]+|-[A-Za-z]+)"), F.lit(1))
    one = F.transform(token, lambda t: F.struct(F.when(t.startswith(":"), F.substring(t, 2, 1 << 20).cast("int")).when(t.startswith("*"), 1).otherwise(F.length(t) - 1).alias("n"), F.when(t.startswith("+"), "I").when(t.startswith("-"), "D").otherwise("M").alias("op")))
    empty = F.expr("cast(array() as array<struct<n:int,op:string>>)")
    return F.aggregate(one, empty, lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["op"] == x["op"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct((F.try_element_at(acc, F.lit(-1))["n"] + x["n"]).alias("n"), x["op"].alias("op"))))).otherwise(F.concat(acc, F.array(x))))


def parse_path(path: Column) -> Column:
    """array<struct<strand, node>> of an oriented path such as >1<2."""
    step = F.regexp_extract_all(path, F.lit(r"[<>][^<>]+"), F.lit(0))
    return F.transform(step, lambda s: F.struct(F.left(s, F.lit(1)).alias("strand"), s.substr(F.lit(2), F.length(s)).alias("node")))


def mostly_reverse(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("<"), F.lit(""))) > F.length(path) - F.length(F.replace(path, F.lit(">"), F.lit("")))


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTN", "TGCAN")


def preview(seq: Column, n: int = 10) -> Column:
    """The sequence if shorter than n, else its first n bases and a plus sign."""
    return F.when(F.length(seq) < n, seq).otherwise(F.concat(F.substring(seq, 1, n), F.lit("+")))


def tag(fields: Column, name: str) -> Column:
    """Value of an XX:T:value tag among the fields, or null."""
    return F.try_element_at(F.transform(F.filter(fields, lambda f: f.startswith(f"{name}:")), lambda f: F.regexp_replace(f, r"^[^:]+:[^:]:", "")), F.lit(1))


def contains_slice(whole: Column, part: Column) -> Column:
    """Whether part occurs in whole as neighbours."""
    return F.exists(F.sequence(F.lit(1), F.greatest(F.size(whole) - F.size(part) + 1, F.lit(1))), lambda i: F.slice(whole, i, F.size(part)) == part)


def same_start(a: Column, b: Column) -> Column:
    """Whether the arrays agree up to the shorter one's length."""
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, 1, n) == F.slice(b, 1, n)


def wrap(seq: Column, width: int = 80) -> Column:
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def parse_region(region: Column) -> Column:
    """struct<chrom, start, end> of chr:start-end, commas allowed."""
    clean = F.replace(region, F.lit(","), F.lit(""))
    part = lambda k, kind: F.regexp_extract(clean, r"^([^:]+):([0-9]+)-([0-9]+)$", k).try_cast(kind)
    return F.struct(part(1, "string").alias("chrom"), part(2, "long").alias("start"), part(3, "long").alias("end"))


def assigned_copy(classes: Column) -> Column:
    """c2 if an allele has more c1 than c2 nodes (a c1 allele matters in the c2 copy), else c1."""
    balance = F.aggregate(classes, F.lit(0), lambda a, c: a + F.when(c == "c1", 1).when(c == "c2", -1).otherwise(0))
    return F.when(balance > 0, "c2").otherwise("c1")
