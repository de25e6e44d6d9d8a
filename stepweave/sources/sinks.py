"""Writers of the tables' text forms. Each writes a folder of parts; sorted ones are range-partitioned, not gathered in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.functions import wrap


def tsv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    (df.orderBy(*order) if order else df).write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="NA")


def bed_rows(calls: DataFrame, chrom: str) -> DataFrame:
    """chrom, start, end, name, score: annotated calls score 1000; fusions, known by their pos_error, are named by their span, others by their alleles.

    The name begins with the allele's first node (alt), or with node where there is no allele.
    """
    node = F.element_at("alt", 1) if "alt" in calls.columns else F.col("node")
    fusion = F.col("pos_error").isNotNull() if "pos_error" in calls.columns else F.col("variant").startswith("fus_")
    end = F.coalesce(F.col("end") if "end" in calls.columns else F.lit(None), F.col("pos") + F.length("ref_seq")) - 1
    start = F.col("pos") - 1
    clin = F.col("clinsig") if "clinsig" in calls.columns else F.lit(None).cast("string")
    alt_seq = F.coalesce("alt_seq", F.lit("")) if "alt_seq" in calls.columns else F.lit("")
    span, change = F.concat_ws("-", start, end), F.concat(F.coalesce("ref_seq", F.lit("")), F.lit("-"), alt_seq)
    name = F.when(clin.isNotNull(), F.concat_ws("_", node, clin)).when(fusion, F.concat_ws("_fusion_", node, span)).otherwise(F.concat_ws("_", node, change))
    return calls.select(F.lit(chrom).alias("chrom"), start.alias("start"), end.alias("end"), name.alias("name"), F.when(clin.isNotNull(), 1000).otherwise(0).alias("score"))


def fasta_lines(seqs: DataFrame) -> DataFrame:
    return seqs.select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), wrap(F.col("seq"))).alias("value"))


def fastq_lines(reads: DataFrame, parts: DataFrame) -> DataFrame:
    """Slices [start, end] of reads (name, seq, qual) by parts (part, name, start, end); parts of unknown reads are left out."""
    n = F.col("end") - F.col("start") + 1
    cut = parts.join(reads, "name").select("part", F.substring("seq", F.col("start") + 1, n).alias("s"), F.substring("qual", F.col("start") + 1, n).alias("q"))
    return cut.select(F.concat(F.lit("@"), F.col("part"), F.lit("\n"), F.col("s"), F.lit("\n+\n"), F.col("q")).alias("value"))


def text(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)


NODE_COLUMNS = ["node", "size", "seq", "ref", "c1", "c2", "rpos_min", "rpos_max", "rnode", "class"]
STAT_COLUMNS = ["hap1", "hap2", "cov_cor", "cov_dev", "cov_cosine", "hap_ll", "aln_score", "rank", "aln_long_prop"]


def node_rows(nodes: DataFrame) -> DataFrame:
    """The ten columns of a node table in their order."""
    return nodes.select(*NODE_COLUMNS)


def stat_rows(stats: DataFrame) -> DataFrame:
    return stats.orderBy("rank", "hap1", "hap2").select(*STAT_COLUMNS)


def path_rows(haps: DataFrame, nodes: DataFrame) -> DataFrame:
    """hap, node, ppos (from 0), class, rpos_min, rpos_max of haplotypes (hap, path)."""
    steps = haps.select("hap", F.posexplode("path").alias("ppos", "node"))
    return steps.join(nodes.select("node", "class", "rpos_min", "rpos_max"), "node").orderBy("hap", "ppos").select("hap", "node", "ppos", "class", "rpos_min", "rpos_max")


def similarity_rows(weights: DataFrame) -> DataFrame:
    """sread1, sread2, sim of directed weights a -> b."""
    return weights.filter("a <> b and weight is not null").orderBy("a", "b").select(F.col("a").alias("sread1"), F.col("b").alias("sread2"), F.col("weight").alias("sim"))


def viz_read_rows(steps: DataFrame, nodes: DataFrame, every: bool = False) -> DataFrame:
    """read, node, startpos, endpos, readpos of reads that touch a node of another class than none; of all reads if `every`."""
    rows = steps
    if not every:
        touched = steps.join(nodes.filter("class <> 'none'").select("node"), "node", "left_semi").select("path_id").distinct()
        rows = steps.join(touched, "path_id", "left_semi")
    return rows.orderBy("path_id", "pos").select(F.col("path_id").alias("read"), "node", F.col("start_pos").alias("startpos"), F.col("end_pos").alias("endpos"), F.col("read_pos").alias("readpos"))


def bin_rows(bins: DataFrame, width: int = 50) -> DataFrame:
    """node, start, end, coverage of all bins (node, bin, coverage, and size of the node), in their order; end is the first place after a bin."""
    start = F.col("bin") * width
    return bins.orderBy("node", "bin").select("node", start.alias("start"), F.least(start + width, F.col("size")).alias("end"), "coverage")


def edge_rows(edges: DataFrame) -> DataFrame:
    """node, enode, side, coverage of neighbours (node, enode, side, n), in before out."""
    return edges.orderBy("node", "side", "enode").select("node", "enode", "side", F.col("n").alias("coverage"))


def record_rows(records: DataFrame) -> DataFrame:
    """read, length, aligned, matches, dv, id of alignment records, in this order of columns."""
    return records.select("read", "length", "aligned", "matches", "dv", "id")


def stats_rows(records: DataFrame) -> DataFrame:
    """One row: median percentages of aligned and of matched bases over reads (read, length, aligned, matches), rounded to two places."""
    share = lambda c: F.round(100 * F.percentile(F.col(c) / F.col("length"), F.lit(0.5)), 2)
    return records.agg(share("aligned").alias("aligned"), share("matches").alias("matched"), F.count(F.lit(1)).alias("n"))


def write_calls(calls: DataFrame, folder: str, chrom: str, genome) -> None:
    """Three tables of calls by pos: folder/tsv, folder/bed and folder/vcf (header lines in folder/vcf_header)."""
    from stepweave.operators.variants import call_rows, vcf_body, vcf_header

    tsv(call_rows(calls), f"{folder}/tsv")
    bed_rows(calls, chrom).orderBy("start", "name").write.mode("overwrite").csv(f"{folder}/bed", sep="\t")
    text(vcf_body(calls, chrom, genome), f"{folder}/vcf")
    length = calls.sparkSession.range(1).select(F.length(genome).alias("n")).first()[0]
    text(calls.sparkSession.createDataFrame([(line,) for line in vcf_header(chrom, length)], "value string").coalesce(1), f"{folder}/vcf_header")
