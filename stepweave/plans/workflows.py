"""What a user runs on a locus, from tables to tables: deconstruct, call, diplotype, copy, surject.

nodes: the node table of locus.annotate_nodes with seq; edges: src, dst, ord; steps: path_id, pos, node of reads, with class and size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.operators import bisection, calls, copynumber, fusions, haplotypes, locus, paths, threading, variants
from stepweave.operators.graph import _settled, small


def subread_steps(steps: DataFrame, groups: DataFrame, least: int = 0, on_walk: bool = False) -> DataFrame:
    """Steps of subreads: path_id (read_sr<number>), pos, node, class, size, and the read, sub, group. Reads shorter than `least` bases go, if steps has span.

    groups: node, group of locus.node_groups; a subread is of the first group that a node of it has. on_walk: see paths.informative.
    """
    rows = paths.labelled(steps.filter(F.col("span") >= least) if least and "span" in steps.columns else steps, groups)
    subs = paths.drop_lone_flanks(paths.split_subreads(paths.informative(rows, on_walk)))
    name = F.concat(F.col("path_id").cast("string"), F.lit("_sr"), F.col("sub"))
    return subs.select(name.alias("path_id"), F.col("sub_pos").alias("pos"), "node", "class", "size", F.col("path_id").alias("read"), "sub", "group")


def deconstruct(nodes: DataFrame, edges: DataFrame, notes: DataFrame | None = None, offset: int = 0) -> DataFrame:
    """Variants of the graph with their copy, traversals, sequences, known significance (notes) and offset positions."""
    found = _settled(variants.described(variants.alleles(nodes, edges), nodes))
    whole = variants.with_reference(found, _settled(variants.reference_traversals(found, nodes, edges)), nodes)
    whole = variants.with_annotation(whole, notes, offset) if notes is not None else whole.withColumn("clinsig", F.lit(None).cast("string"))
    return _settled(variants.offset_positions(whole, offset))


def call(steps: DataFrame, nodes: DataFrame, edges: DataFrame, notes: DataFrame | None = None, offset: int = 0, markers: int = 10, least: int = 3, hap_steps: DataFrame | None = None) -> DataFrame:
    """Small variants with enough support and chosen fusions: variant, copy, alt, pos, end, pos_error, sequences, clinsig, and who supports them.

    hap_steps are assembled haplotypes, of which one is enough support.
    """
    groups = locus.node_groups(nodes, edges)
    reads = _settled(subread_steps(steps, groups))
    known = deconstruct(nodes, edges, notes, offset)
    small = known.join(variants.support(reads, known, -(-markers // 2)), "variant")
    found = _settled(fusions.candidates(reads, markers))
    big = fusions.support(reads, found, markers)
    near = fusions.neighbours(reads, markers)
    lists = ("haps_alt", "haps_ref")
    if hap_steps is not None:
        haps = _settled(subread_steps(hap_steps, groups))
        small = small.join(variants.support(haps, known, -(-markers // 2), haplotypes=True), "variant")
        found = _settled(found.unionByName(fusions.candidates(haps, markers).join(found, "variant", "left_anti")))
        big = fusions.support(reads, found, markers).join(fusions.support(haps, found, markers, haplotypes=True).select("variant", *lists), "variant")
        near = near.unionByName(fusions.neighbours(haps, markers)).groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    else:
        empty = F.array().cast("array<string>")
        small, big = (t.withColumns({c: empty for c in lists}) for t in (small, big))
    big = fusions.choose(big, near, least)
    big = variants.offset_positions(variants.fusion_info(big, nodes), offset)
    return _settled(variants.union_calls(calls.supported(small, least), big))


def copy(steps: DataFrame, aligned: DataFrame) -> DataFrame:
    """One row: copy number by the edges at the module's ends and by coverage. aligned: node, class, size, start, end."""
    one = copynumber.flank_copy_number(steps).select("fl", "cyc", F.col("cn").alias("cn_edges"))
    two = copynumber.coverage_copy_number(aligned).select("flank", "module", F.col("cn").alias("cn_coverage"))
    return one.crossJoin(F.broadcast(two))  # one row each


def _observed(steps: DataFrame, groups: DataFrame, settings: list[dict]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Settings (name, read_len, read_support, modules, method, marker_support), steps of subreads (with read_len) and observations (with name)."""
    spark = steps.sparkSession
    kinds = {"name": "string", "read_len": "int", "read_support": "int", "modules": "int", "method": "string", "marker_support": "double"}
    table = _settled(spark.createDataFrame([tuple(s[k] for k in kinds) for s in settings], ", ".join(f"{k} {t}" for k, t in kinds.items())))
    lengths = sorted({s["read_len"] for s in settings})
    subs = _settled(reduce(DataFrame.unionByName, (subread_steps(steps, groups, n).withColumn("read_len", F.lit(n)) for n in lengths)))
    module = subs.filter(F.col("group") == "module").select("read_len", F.col("path_id").alias("id"), "pos", "node", "class")
    each = module.join(small(table.select("read_len", "read_support").distinct()), "read_len")
    seen = haplotypes.observations(each, "read_support", ["read_len", "read_support"])
    return table, subs, _settled(seen.join(small(table), ["read_len", "read_support"]))


def diplotype(steps: DataFrame, nodes: DataFrame, edges: DataFrame, settings: list[dict]) -> tuple[DataFrame, DataFrame]:
    """Stats of the candidate pairs, best first, and the candidates' paths (hap, path); settings are those of haplotypes.sweep().

    Each setting clusters the module subreads, threads the clusters into a pair, and all pairs are scored against all reads. The settings are
    rows: every operator works on all of them at once. A setting whose subreads fall into fewer than two clusters gives no pair.
    """
    ends = {r["class"]: r["node"] for r in nodes.filter("class in ('cyc_l', 'cyc_r')").select("class", "node").collect()}  # two rows
    groups, flanks = locus.node_groups(nodes, edges), locus.flank_paths(nodes, edges)
    default = edges.groupBy("src").agg(F.max_by("dst", "ord").alias("dst"))
    table, subs, seen = _observed(steps, groups, settings)
    by = ["name"]
    one = haplotypes.cluster_by_em(seen.filter("method = 'em'"), "modules", by)
    two = haplotypes.cluster_by_network(seen.filter("method <> 'em'"), "modules", "marker_support", by=by)
    of = _settled(one.unionByName(two).withColumn("cluster", F.col("cluster").cast("string")))

    rows = subs.join(small(table.select("name", "read_len")), "read_len").select("name", "read", "sub", F.col("path_id").alias("id"), "pos", "node", "group")
    walks = threading.consensus(rows.filter("group = 'module'").select("name", "id", "pos", "node"), of, ends["cyc_l"], ends["cyc_r"], default, by)
    threads = rows.groupBy("name", F.col("read").alias("path_id"), "sub", "id").agg(F.first("group").alias("group")).join(of, ["name", "id"], "left")
    flank = F.col("group") != "module"
    own = F.coalesce("cluster", F.when(flank, F.col("group")))
    sure = F.when(F.col("cluster").isNull() & flank, 1.0).otherwise(F.col("confidence"))
    runs = haplotypes.adjacency(threads.select("name", "path_id", "sub", own.alias("cluster"), sure.alias("confidence")), by)
    buffer = not flanks.filter("group = 'buffer'").isEmpty()
    best = _settled(threading.best_pairs(runs, of, by, buffer))
    haps = threading.thread(best, walks, flanks, by)
    haps = _settled(haps.select("name", F.concat_ws("_", "name", "hap").alias("hap"), "path"))
    pairs = haps.groupBy("name").agg(F.min("hap").alias("hap1"), F.max("hap").alias("hap2"))

    sized = haps.select("hap", F.explode("path").alias("node")).join(small(nodes.select("node", "size")), "node")
    heavy = {r["node"] for r in nodes.filter("class <> 'none'").select("node").collect()}  # nodes of one locus
    found = {r["hap"]: list(r["path"]) for r in haps.collect()}  # two for each setting
    scores = haplotypes.alignment_scores(steps, found, heavy)
    return _settled(haplotypes.evaluate_pairs(steps.select("node", "size"), sized, _settled(scores), pairs=pairs)), haps.select("hap", "path")


def original(steps: DataFrame, nodes: DataFrame, edges: DataFrame, least: int = 3, most_parts: int = 50, most_clusters: int = 3, per: int = 50) -> tuple[DataFrame, DataFrame]:
    """Stats of pairs of candidate haplotypes, best first, and the candidates' paths (hap, path), by bisection of the subreads.

    Parts of the module subreads are candidate modules; each subread belongs to those whose consensus it aligns with almost best (over 0.98 of
    the best score). Paths through the graph of parts, from flank to flank, are the candidates, and all their pairs are scored.
    """
    ends = {r["class"]: r["node"] for r in nodes.filter("class in ('cyc_l', 'cyc_r')").select("class", "node").collect()}  # two rows
    default, flanks = _settled(bisection.default_successors(nodes, edges)), bisection.outer_flanks(nodes, edges)
    subs = _settled(subread_steps(steps, locus.node_groups(nodes, edges)))
    module = subs.filter(F.col("group") == "module").select(F.col("path_id").alias("id"), "pos", "node")
    _, parts, _ = bisection.candidates(module, default, ends["cyc_l"], ends["cyc_r"], least, most_parts)
    parts = parts.withColumn("part", F.concat(F.lit("p"), "part"))
    found = {r["part"]: list(r["path"]) for r in parts.collect()}  # most_parts rows at most
    scores = _settled(haplotypes.alignment_scores(module.withColumnRenamed("id", "path_id"), found, set()))
    best = scores.groupBy("read").agg(F.max("score").alias("best"))
    of = scores.join(best, "read").filter(F.col("score") > 0.98 * F.col("best")).select(F.col("read").alias("id"), F.col("hap").alias("cluster"))
    lines = subs.groupBy("read", "sub", F.col("path_id").alias("id")).agg(F.first("group").alias("group"))
    links = bisection.cluster_edges(lines, of)
    chosen = bisection.top_by_support(bisection.cluster_paths(links, least, most_clusters), per)
    tokens = chosen.select(F.array_join("path", "_").alias("hap"), F.posexplode("path").alias("place", "token"))
    flank = flanks.groupBy(F.col("group").alias("token")).agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("f")).select("token", F.transform("f", lambda x: x["node"]).alias("nodes"))
    pieces = parts.select(F.col("part").alias("token"), F.col("path").alias("nodes")).unionByName(flank)
    rows = tokens.join(small(pieces), "token", "left").groupBy("hap").agg(F.array_sort(F.collect_list(F.struct("place", "nodes"))).alias("w"))
    haps = _settled(rows.select("hap", F.flatten(F.transform(F.filter("w", lambda x: x["nodes"].isNotNull()), lambda x: x["nodes"])).alias("path")))
    sized = haps.select("hap", F.explode("path").alias("node")).join(small(nodes.select("node", "size")), "node")
    whole = {r["hap"]: list(r["path"]) for r in haps.collect()}  # `per` for each number of clusters
    heavy = {r["node"] for r in nodes.filter("class <> 'none'").select("node").collect()}  # nodes of one locus
    aligned = _settled(haplotypes.alignment_scores(steps, whole, heavy))
    return _settled(haplotypes.evaluate_pairs(steps.select("node", "size"), sized, aligned)), haps


def surject(steps: DataFrame, nodes: DataFrame, edges: DataFrame, haps: dict[str, list]) -> DataFrame:
    """sread, read, start, end, haplotype, module of module subreads of reads aligned to a diplotype; steps has read_pos."""
    found = locus.node_groups(nodes, edges)
    groups = {r["node"]: r["group"] for r in found.collect()}  # the reference nodes of one locus
    right = nodes.filter("class = 'cyc_r'").select("node").first()["node"]
    subs = paths.split_subreads(paths.labelled(steps, found))
    return haplotypes.assign_subreads(steps, subs, haps, groups, right)
