"""Readers of annotations, indexes, reference sequences and configurations; each names its columns, so that only those are read."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepweave.operators.order import running


def _table(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=header, comment=None if header else "#")


def notes(spark: SparkSession, path: str) -> DataFrame:
    """Known variants: chr, start, end, ref, alt, id, nuc.change, prot.change, clnsig, ord (place in the file)."""
    raw = _table(spark, path)
    kinds = {"start": "long", "end": "long"}
    known = [c for c in ("chr", "start", "end", "ref", "alt", "id", "nuc.change", "prot.change", "clnsig") if c in raw.columns]
    return raw.select(*(F.col(f"`{c}`").cast(kinds.get(c, "string")).alias(c) for c in known), F.monotonically_increasing_id().alias("ord"))


def genes(spark: SparkSession, path: str, names: Iterable[str] = ()) -> DataFrame:
    """id, chr, start, end, type, strand, gene_name, gene_type of exons and genes; of `names` only, if there are any."""
    rows = _table(spark, path).filter(F.col("type").isin("exon", "gene"))
    names = list(names)
    rows = rows.filter(F.col("gene_name").isin(names)) if names else rows
    return rows.select(F.monotonically_increasing_id().alias("id"), "chr", F.col("start").cast("long"), F.col("end").cast("long"), "type", "strand", "gene_name", "gene_type")


def path_info(spark: SparkSession, path: str) -> DataFrame:
    """hap, node, ppos, class, rpos_min, rpos_max."""
    return _table(spark, path).select("hap", "node", *(F.col(c).cast("long") if c != "class" else F.col(c) for c in ("ppos", "class", "rpos_min", "rpos_max")))


def path_stats(spark: SparkSession, path: str) -> DataFrame:
    raw = _table(spark, path)
    return raw.select(*(F.col(c) if c in ("hap1", "hap2") else F.col(c).cast("double").alias(c) for c in raw.columns))


def viz_reads(spark: SparkSession, path: str) -> DataFrame:
    """read, node, startpos, endpos, readpos."""
    return _table(spark, path).select("read", "node", *(F.col(c).cast("long") for c in ("startpos", "endpos", "readpos")))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """name (up to the first space), seq of each record; lines are gathered per record in file order."""
    text = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    heads = running(text.select("ord", "value").filter("value <> ''"), ["ord"], F.col("value").startswith(">").cast("long"))
    rows = heads.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("r")).filter("run > 0")
    lines = F.transform("r", lambda x: x["value"])
    return rows.select(F.regexp_extract(F.element_at(lines, 1), r"^>(\S*)", 1).alias("name"), F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), "").alias("seq"))


def region(sequences: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """name, seq of the bases from start (0-based) up to before end."""
    return sequences.filter(F.col("name") == chrom).select("name", F.substring("seq", start + 1, max(end - start, 0)).alias("seq"))


def sequence_headers(spark: SparkSession, fai: str) -> DataFrame:
    """@SQ lines (value), in the index's order."""
    rows = _table(spark, fai, header=False).withColumn("ord", F.monotonically_increasing_id())
    return rows.orderBy("ord").select(F.concat(F.lit("@SQ\tSN:"), F.col("_c0"), F.lit("\tLN:"), F.col("_c1")).alias("value"))


def config(path: str) -> dict:
    """A locus' or a simulation's configuration. With c1 and c2, adds reg_s, reg_e and offset: the region from the first module less flank_size to the second's end plus it."""
    conf = json.loads(Path(path).read_text())
    if "c1" in conf and "c2" in conf:
        spans = []
        for c in ("c1", "c2"):
            chrom, _, span = conf[c].replace(",", "").partition(":")
            spans.append((chrom, *map(int, span.split("-"))))
        flank = int(conf.get("flank_size", 0))
        conf |= {"chrom": spans[0][0], "reg_s": spans[0][1] - flank, "reg_e": spans[1][2] + flank, "offset": spans[0][1] - flank + 1}
    return conf


def file_name(kind: str, given: str | None, conf: dict, prefix: str | None = None) -> str:
    """The path of a locus' file (gfa, nodes, clinvar, genes): what is given, else what the configuration names, else one built from prefix or label and method."""
    if given:
        return given
    known = {"clinvar": "clinvar", "genes": "gene_annot", "gfa": "gfa", "nodes": "nodes"}
    if conf.get(known[kind]):
        return conf[known[kind]]
    base = prefix or f"{conf['label']}.{conf['method']}"
    return {"gfa": f"{base}.pg.gfa", "nodes": f"{base}.node_info.tsv", "clinvar": f"{base}.clinvar.tsv", "genes": f"{base}.genes.tsv"}[kind]


def _attribute(column: Column, name: str) -> Column:
    """An attribute's value, in GFF3 (name=value;) or GTF (name "value";) form; null where it is missing."""
    found = F.regexp_extract(column, rf'(?:^|[;\s]){name}[=\s]"?([^";]+)', 1)
    return F.when(found != "", found)


def gff3(spark: SparkSession, path: str, attributes: Iterable[str] = ("Name",)) -> DataFrame:
    """chr, source, type, start, end, strand and the attributes."""
    raw = _table(spark, path, header=False)
    return raw.select(F.col("_c0").alias("chr"), F.col("_c1").alias("source"), F.col("_c2").alias("type"), F.col("_c3").cast("long").alias("start"), F.col("_c4").cast("long").alias("end"), F.col("_c6").alias("strand"), *(_attribute(F.col("_c8"), a).alias(a) for a in attributes))


def gtf_genes(spark: SparkSession, path: str, kinds: Iterable[str] = ("gene", "exon", "CDS")) -> DataFrame:
    """chr, start, end, type, strand, gene_name, gene_type."""
    rows = gff3(spark, path, ("gene_name", "gene_type")).filter(F.col("type").isin(list(kinds)))
    return rows.select("chr", "start", "end", "type", "strand", "gene_name", "gene_type")


def bedpe(spark: SparkSession, path: str) -> DataFrame:
    """pair, side, chr, start, end: the two intervals of each row."""
    raw = _table(spark, path, header=False).withColumn("pair", F.monotonically_increasing_id())
    side = lambda k, c: F.struct(F.lit(k).alias("side"), F.col(f"_c{c}").alias("chr"), F.col(f"_c{c + 1}").cast("long").alias("start"), F.col(f"_c{c + 2}").cast("long").alias("end"))
    return raw.select("pair", F.inline(F.array(side(1, 0), side(2, 3))))


def clinical_dump(spark: SparkSession, path: str, gene: str, assembly: str = "GRCh38") -> DataFrame:
    """chr, start, end, ref, alt, id, nuc.change, prot.change, clnsig of a gene's pathogenic or conflicting variants; other columns are not read."""
    raw = _table(spark, path)
    raw = raw.withColumnsRenamed({c: c.lstrip("#") for c in raw.columns if c.startswith("#")})
    ok = F.array_contains(F.split("GeneSymbol", ";"), gene) & F.col("ClinicalSignificance").rlike("Conflicting|Pathogenic") & (F.col("Assembly") == assembly)
    name = F.col("Name")
    return raw.filter(ok).select(
        F.concat(F.lit("chr"), F.col("Chromosome")).alias("chr"), F.col("Start").cast("long").alias("start"), F.col("Stop").cast("long").alias("end"),
        F.col("ReferenceAlleleVCF").alias("ref"), F.col("AlternateAlleleVCF").alias("alt"), F.col("VariationID").alias("id"),
        F.regexp_extract(name, r":(c\.[^ ]+)", 1).alias("nuc.change"), F.regexp_extract(name, r"\((p\.[^)]+)\)", 1).alias("prot.change"), F.col("ClinicalSignificance").alias("clnsig"),
    )


def assembly_index(spark: SparkSession, path: str) -> DataFrame:
    """sample, haplotype (1 for paternal, else 2), url: rows of another reference than chm13 and without a haplotype go; s3 addresses become https ones."""
    raw = spark.read.csv(path, header=True)
    rows = raw.filter((F.col("reference") != "chm13") & (F.col("haplotype") != "-")) if "reference" in raw.columns else raw.filter("haplotype <> '-'")
    return rows.select("sample", F.when(F.col("haplotype").isin("paternal", "1"), 1).otherwise(2).alias("haplotype"), F.regexp_replace("location", r"^s3://([^/]+)/", "https://$1.s3.amazonaws.com/").alias("url"))


def contig_bounds(rows: DataFrame, margin: int = 60_000) -> DataFrame:
    """contig, start, end: the least start less margin, not under 1, and the greatest end plus it."""
    return rows.groupBy("contig").agg(F.greatest(F.min("start") - margin, F.lit(1)).alias("start"), (F.max("end") + margin).alias("end"))


def first_alignments(sam: DataFrame, chosen: DataFrame) -> DataFrame:
    """SAM lines of chosen subreads (sread, read, haplotype, module), the first one of each, with the tags rn, md and hp; headers come first.

    sam: ord, value. Subreads without a choice go.
    """
    name = F.regexp_extract("value", r"^([^\t]*)", 1)
    heads = sam.filter(F.col("value").startswith("@")).select("ord", "value")
    rows = sam.filter(~F.col("value").startswith("@")).withColumn("sread", name)
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("sread").orderBy("ord"))).filter("k = 1")
    tagged = first.join(chosen, "sread").select("ord", F.concat_ws("\t", "value", F.concat(F.lit("rn:Z:"), F.col("read")), F.concat(F.lit("md:Z:"), F.col("module")), F.concat(F.lit("hp:Z:"), F.col("haplotype"))).alias("value"))
    return heads.unionByName(tagged).orderBy("ord").select("value")
