"""Queries of the locus, variant, haplotype and plot operators on the star-schema tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepweave.operators import bisection, copynumber, fusions, haplotypes, locus, order, paths, variants, views
from stepweave.operators.graph import _settled
from stepweave.plans.adapter import INTERVALS_SQL, READS_SQL, STEPS_SQL, read, reads, spans, steps
from stepweave.sources import expand_alignments
from stepweave.sources.loci import contig_bounds

REF = 1  # the path that stands for the reference


def _nodes(s: SparkSession, d: str) -> DataFrame:
    return steps(s, d).select("node", "size").distinct()


def _viz(s: SparkSession, d: str) -> DataFrame:
    e = steps(s, d)
    return e.select(F.col("path_id").alias("read"), F.col("pos").alias("readpos"), (F.ascii("node") * 10 + F.substring("node", -1, 1).cast("long")).alias("node"), (F.col("pos") % 3 * 7).alias("startpos"), F.least(F.col("size"), F.col("pos") % 3 * 7 + F.col("size") / 2 + 1).cast("long").alias("endpos"), "class", F.col("size"))


VIZ = STEPS_SQL + ", viz as (select path_id as read, pos as readpos, ascii(node) * 10 + cast(right(node, 1) as bigint) as node, pos % 3 * 7 as startpos, cast(floor(least(size, pos % 3 * 7 + size / 2.0 + 1)) as bigint) as endpos, class, size from steps)"

WALK = STEPS_SQL + f""", w0 as (select pos, node, size, coalesce(sum(size) over (order by pos rows between unbounded preceding and 1 preceding), 0) as refpos, row_number() over (partition by node order by pos) as nth from steps where path_id = {REF}),
  walk as (select *, nth = 1 and pos < coalesce((select min(pos) from w0 where nth > 1), 1000000000) as first from w0),
  each0 as (select node, count(*) as ref, min(refpos) filter (first) as lo, max(refpos) filter (not first) as hi, min(pos) as p, max(pos) as q from walk group by 1),
  sides as (select min(p) filter (hi is not null or lo = 1) as l, max(q) filter (lo is not null or hi = 1) as r from each0),
  each1 as (select node, ref, case when lo is null and (r is null or q > r) then hi else lo end as low, case when hi is null and (l is null or p < l) then lo else hi end as high from each0, sides),
  known as (select n.node, n.size, ref, low, high from (select distinct node, size from steps) n left join each1 using (node)),
  filled as (select s.node, case when low is null then coalesce(last_value(low + k.size ignore nulls) over win, 0) end as l, case when high is null then last_value(high + k.size ignore nulls) over win end as h
    from steps s join known k using (node) window win as (partition by path_id order by pos rows between unbounded preceding and current row)),
  near as (select node, trunc(median(l)) as l, trunc(median(h)) as h from filled group by 1),
  coords as (select k.node, k.size, coalesce(ref, 0) as ref, coalesce(low, l, -1) as rpos_min, coalesce(high, h, -1) as rpos_max from known k left join near using (node))"""

# Windows of three markers, of which most say what a side favours: with a share of four fifths the first marker of the downstream side, which
# is of the upstream module, would need five others against it.
MARK = STEPS_SQL + """, m as (select *, row_number() over p - 1 as marker_pos, count(*) over (partition by path_id) as total, lead(class) over p as after, lead(node) over p as dst from steps where class in ('c1','c2') window p as (partition by path_id order by pos)),
  c as (select *, sum((class='c1')::int) over up as u1, sum((class='c2')::int) over up as u2, sum((class='c1')::int) over down as d1, sum((class='c2')::int) over down as d2, list(node) over up as before_, list(node) over next_ as after_ from m
    window up as (partition by path_id order by pos rows between 3 preceding and 1 preceding), down as (partition by path_id order by pos rows between current row and 2 following), next_ as (partition by path_id order by pos rows between 1 following and 2 following)),
  v as (select *, case when u1 > u2 then 'c1' when u2 > u1 then 'c2' end as up, case when d1 > d2 then 'c1' when d2 > d1 then 'c2' end as down from c where marker_pos >= 3 and marker_pos < total - 3 and total > 6),
  sig as (select *, coalesce(up <> down, false) as signal from v),
  cand as (select concat('fus_', up, '_', node) as variant, up as copy, node, arg_min(dst, path_id * 1000000 + pos) as dst from sig where signal and class = up and after <> class group by 2, 3)"""


def _joined(c: str):
    return F.array_join(F.col(c).cast("array<string>"), ",")


def _fusion_support(s: SparkSession, d: str) -> DataFrame:
    rows = steps(s, d)
    found = fusions.support(rows, fusions.candidates(rows, 3, 1), 3, 1)
    size = lambda c: F.greatest(F.size(c), F.lit(0))
    return found.select("variant", "copy", F.element_at("alt", 1).alias("node"), F.element_at("alt", 2).alias("dst"), size("reads_alt").alias("n_alt"), size("reads_ref").alias("n_ref"))


def _neighbours(s: SparkSession, d: str) -> DataFrame:
    return fusions.neighbours(steps(s, d), 3, 1).select("node", _joined("near").alias("near"))


def _observations(s: SparkSession, d: str) -> DataFrame:
    return haplotypes.observations(steps(s, d).withColumnRenamed("path_id", "id"))


def _adjacency(s: SparkSession, d: str) -> DataFrame:
    subs = paths.split_subreads(steps(s, d)).groupBy("path_id", "sub").agg(F.first("group").alias("cluster"), F.count(F.lit(1)).alias("n"))
    runs = haplotypes.adjacency(subs.withColumn("confidence", (F.col("n") > 2).cast("double")))
    return runs.select(F.array_join("run", ">").alias("run"), "n")


def _copy_from_coverage(s: SparkSession, d: str) -> DataFrame:
    kinds = read(s, d, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") % 5 == 0, "ref").when(F.col("p_partkey") % 5 < 3, "none").otherwise("c1").alias("class"))
    return copynumber.coverage_copy_number(reads(s, d).join(kinds, "node"))


def _gene_points(s: SparkSession, d: str) -> DataFrame:
    points = read(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 37 % 30000).alias("at"))
    nodes = read(s, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("node"), (F.col("p_partkey") * 7 % 20000).cast("long").alias("rpos_min"), (F.col("p_partkey") * 7 % 20000 + 10000).cast("long").alias("rpos_max"), F.col("p_size").alias("size"))
    return views.gene_point_nodes(points, nodes)


def _variant_rows(s: SparkSession, d: str) -> DataFrame:
    """A fusion for each part of even size, between nodes whose positions come from its keys."""
    p = read(s, d, "part")
    nodes = p.select(F.col("p_partkey").cast("string").alias("node"), (F.col("p_partkey") * 3).alias("rpos_min"), (F.col("p_partkey") * 3 + F.col("p_size")).alias("rpos_max"), F.substring("p_name", 1, 3).alias("seq"))
    calls = p.filter("p_size % 2 = 0").select(F.concat(F.lit("fus_c1_"), "p_partkey").alias("variant"), F.when(F.col("p_size") % 4 == 0, "c1").otherwise("c2").alias("copy"), F.array(F.col("p_partkey").cast("string"), (F.col("p_size")).cast("string")).alias("alt"))
    return variants.fusion_info(calls, nodes).select("variant", "copy", "pos", "end", "pos_error", "ref_seq")


def _alignments(s: SparkSession, d: str) -> DataFrame:
    """All paths aligned to the chosen candidate haplotypes, the best of them for each path."""
    rows = steps(s, d)
    haps = haplotypes.top_haplotypes(rows, 1).select("hap").distinct()
    lists = haplotypes._read_lists(rows.join(haps.withColumnRenamed("hap", "path_id"), "path_id", "left_semi")).collect()  # one path for each number of modules
    scores = haplotypes.alignment_scores(rows, {str(r["read"]): list(r["nodes"]) for r in lists}, {f"{k}_{i}" for k in ("click", "purchase") for i in range(7)})
    return scores.groupBy("read").agg(F.max("score").alias("score"), F.max("length").alias("length"))


def _cigar_nodes(s: SparkSession, d: str) -> DataFrame:
    """Orders as alignments along their parts: each line is a step of the path and two operations."""
    line = F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q"), "l_returnflag")
    lines = read(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("name"), line.alias("line")).repartition("name")  # lists of few lines each are not worth making before
    rows = lines.groupBy("name").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    step = lambda x: F.concat(F.when(x["l_returnflag"] == "R", "<").otherwise(">"), x["l_partkey"].cast("string"))
    kind = lambda x, *of: F.element_at(F.array(*map(F.lit, of)), (x["l_linenumber"] % len(of) + 1).cast("int"))
    two = lambda x: F.array(F.struct(x["q"].alias("n"), kind(x, "=", "M", "X").alias("op")), F.struct(x["l_linenumber"].cast("int").alias("n"), kind(x, "I", "D").alias("op")))
    records = rows.select("name", F.array_join(F.transform("lines", step), "").alias("path"), F.lit(0).alias("path_start"), F.lit(0).alias("start"), F.flatten(F.transform("lines", two)).alias("ops"))
    nodes = read(s, d, "part").select(F.col("p_partkey").cast("string").alias("node"), F.col("p_size").alias("size"))
    return expand_alignments(records, nodes)


CIGAR = """l as (select l_orderkey::varchar as name, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity::int, l_returnflag) as k, l_partkey::varchar as node, case when l_returnflag = 'R' then '<' else '>' end as strand, p_size as size, l_quantity::int as q, l_linenumber as i from lineitem join part on p_partkey = l_partkey),
  n as (select *, coalesce(sum(size) over (partition by name order by k rows between unbounded preceding and 1 preceding), 0) as a from l),
  o0 as (select name, 2 * k as j, q as n, ['=', 'M', 'X'][i % 3 + 1] as op from l union all select name, 2 * k + 1, i, ['I', 'D'][i % 2 + 1] from l),
  o as (select *, coalesce(sum(case when op <> 'I' then n end) over w, 0) as a, coalesce(sum(case when op <> 'D' then n end) over w, 0) as read from o0 window w as (partition by name order by j rows between unbounded preceding and 1 preceding)),
  r as (select n.name, k, node, strand, size, op, greatest(n.a, o.a) - n.a as x, least(n.a + size, o.a + o.n) - 1 - n.a as y, read + greatest(n.a, o.a) - o.a as read from n join o on n.name = o.name and n.a < o.a + o.n and o.a < n.a + size where op in ('=', 'M')),
  e as (select name, k, node, strand, size, min(x) as x, max(y) filter (op = '=') as y, arg_min(read, x) as read from r group by all),
  v0 as (select *, case when lag(node) over (partition by name order by k) = node then 0 else 1 end as new from e),
  v as (select *, sum(new) over (partition by name order by k) as visit from v0),
  m as (select name, min(k) as k, arg_min(node, k) as node, arg_min(strand, k) as strand, arg_min(size, k) as size, arg_min(x, k) as x, arg_max(y, k) filter (y is not null) as y, arg_min(read, k) as read from v group by name, visit),
  f as (select name, count(*) filter (strand = '<') > count(*) filter (strand = '>') as flip from l group by 1),
  p as (select name, k, node, flip, read, case when strand = '>' then x else size - x end as a, case when strand = '>' then coalesce(y, x) else size - coalesce(y, x) end as b from m join f using (name))"""


def _brand_loci(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A locus for each brand: its parts by key are the nodes, a module from the second quarter on, the buffer in the third. Edges skip one node, too."""
    w = Window.partitionBy("p_brand")
    p = read(s, d, "part").select(F.col("p_brand").alias("locus"), F.col("p_partkey").alias("node"), "p_size", (F.row_number().over(w.orderBy("p_partkey")) - 1).alias("r"), F.count(F.lit(1)).over(w).alias("k"))
    kind = F.when(F.col("r") == F.expr("k div 4"), "cyc_l").when(F.col("r") == F.expr("k div 2"), "cyc_r")
    kind = kind.when((F.col("r") < F.expr("k div 4")) | (F.col("r") > F.expr("k div 2")), "ref").otherwise(F.element_at(F.array(*map(F.lit, ("c1", "c2", "none"))), (F.col("p_size") % 3 + 1).cast("int")))
    p = _settled(p.withColumn("class", kind))
    nodes = p.select("locus", "node", "class", (F.col("r") * 100).alias("rpos_min"), F.lit(1).alias("ref"))
    to = F.array(F.col("r") + 1, F.when((F.col("r") >= F.expr("k div 4")) & (F.col("r") + 2 <= F.expr("k div 2")), F.col("r") + 2), F.when(F.col("r") == F.expr("k div 2"), F.expr("k * 3 div 4")), F.when(F.col("r") == F.expr("k * 3 div 4 - 1"), F.expr("k div 4")))
    out = p.select("locus", F.col("node").alias("src"), F.posexplode(to).alias("ord", "to")).filter("to is not null")
    return nodes, out.join(p.select("locus", F.col("r").alias("to"), F.col("node").alias("dst")), ["locus", "to"]).select("locus", "src", "dst", "ord")


def _brand_defaults(s: SparkSession, d: str) -> DataFrame:
    """The default successor of each part within its brand's locus; what haplotypes and the reference make of a part comes from its key and size."""
    _, edges = _brand_loci(s, d)
    nodes = read(s, d, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size") % 3).alias("ref"), (F.col("p_partkey") % 5).alias("c1"), (F.col("p_size") % 4).alias("c2"))
    return bisection.default_successors(nodes, edges)


def _event_paths(s: SparkSession, d: str) -> DataFrame:
    """Paths from a sign-up to an error over kinds of events that follow each other often."""
    kinds = steps(s, d).withColumn("node", F.substring_index("node", "_", 1))
    found = bisection.cluster_paths(paths.edge_support(kinds), 20, 3, start="signup", end="error")
    return found.select(F.array_join("path", ">").alias("path"), "support")


def _groups(s: SparkSession, d: str) -> DataFrame:
    nodes, edges = _brand_loci(s, d)
    return locus.node_groups(nodes, edges, ["locus"])


def _grouped_subreads(s: SparkSession, d: str) -> DataFrame:
    """Orders as reads over the parts, labelled along the walks, cut at module ends, those with a marker on a walk's module kept."""
    nodes, edges = _brand_loci(s, d)
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")) - 1
    rows = read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_partkey").alias("node")).join(nodes.select("node", "class"), "node")
    rows = paths.labelled(rows, locus.node_groups(nodes, edges, ["locus"])).select(F.col("l_orderkey").alias("path_id"), pos.alias("pos"), "node", "class", "label")
    subs = paths.split_subreads(paths.informative(rows, on_walk=True))
    return subs.groupBy("path_id", "sub").agg(F.first("group").alias("group"), F.count(F.lit(1)).alias("n"))


LOCI = """own as (select p_brand as locus, p_partkey as node, p_size, row_number() over w - 1 as r, count(*) over (partition by p_brand) as k from part window w as (partition by p_brand order by p_partkey)),
  nodes_ as (select locus, node, r, k, case when r = k // 4 then 'cyc_l' when r = k // 2 then 'cyc_r' when r < k // 4 or r > k // 2 then 'ref' else ['c1', 'c2', 'none'][p_size % 3 + 1] end as class from own),
  tos as (select locus, node, r, r + 1 as t, 0 as ord from nodes_ union all select locus, node, r, r + 2, 1 from nodes_ where r >= k // 4 and r + 2 <= k // 2 union all select locus, node, r, k * 3 // 4, 2 from nodes_ where r = k // 2 union all select locus, node, r, k // 4, 3 from nodes_ where r = k * 3 // 4 - 1),
  modes(grp, lap) as (values ('flankl', 1), ('module', 1), ('buffer', 1), ('module', 2), ('flankr', 2)),
  ways as (select tos.node as src, grp, lap, b.node as dst, b.class from tos join nodes_ b on b.locus = tos.locus and b.r = tos.t, modes where b.r > tos.r or (grp = 'buffer' and b.class = 'cyc_l')
    qualify row_number() over (partition by tos.node, grp, lap order by case when lap = 1 then b.r else -b.r end, ord) = 1),
  on_ as (select src, grp, lap, dst, case when class = 'cyc_l' then 'module' when class = 'cyc_r' then case when lap = 2 then 'flankr' else 'buffer' end else grp end as grp2, case when class = 'cyc_l' and grp = 'buffer' then 2 else lap end as lap2 from ways),
  went as (select locus, arg_min(node, r) as node, 'flankl' as grp, 1 as lap, 0 as hops from nodes_ where class = 'ref' group by 1 union all select locus, dst, grp2, lap2, hops + 1 from went join on_ on src = node and on_.grp = went.grp and on_.lap = went.lap),
  labels as (select locus, node, arg_max(grp, hops) as label from went group by 1, 2)"""


def add(register, s_sql: str = STEPS_SQL) -> None:
    register("reference_coordinates", lambda s, d: locus.reference_coordinates(steps(s, d), _nodes(s, d), REF), WALK + "==== select * from coords", "node size:i ref:i rpos_min:i rpos_max:i")
    register("module_ends", lambda s, d: locus.module_ends(locus.reference_coordinates(steps(s, d), _nodes(s, d), REF), locus.reference_walk(steps(s, d), _nodes(s, d), REF)), WALK + ", j as (select w.node, pos, rpos_max - rpos_min as jump from walk w join coords using (node)), far as (select * from j where jump > 0.9 * (select max(jump) from j)) ==== select arg_min(node, pos) as cyc_l, arg_max(node, pos) as cyc_r from far", "cyc_l cyc_r")
    register("reference_jumps", lambda s, d: views.jumps(locus.reference_walk(steps(s, d), _nodes(s, d), REF)), WALK + """, n as (select pos, node, lead(node) over (order by pos) as "next", lead(refpos) over (order by pos) - refpos as jump from walk) ==== select * from n where "next" is not null""", "pos:i node next jump:i")
    register("fusion_candidates", lambda s, d: paths.fusions(steps(s, d), 3, 1), MARK + "==== select path_id, pos, node, up, down from sig where signal and class = up and after <> class", "path_id:i pos:i node up down")
    register("fusion_support", _fusion_support, MARK + """, seen as (select concat('fus_', coalesce(up, 'None'), '_', node) as variant, path_id, case when signal then 'alt' else 'ref' end as kind from sig union all select concat('fus_', case when up = 'c2' then 'c1' else 'c2' end, '_', node), path_id, 'ref' from sig where not signal)
==== select cand.variant, copy, cand.node, cand.dst, count(distinct path_id) filter (kind = 'alt') as n_alt, count(distinct path_id) filter (kind = 'ref') as n_ref from cand left join seen using (variant) group by all""", "variant copy node dst n_alt:i n_ref:i")
    register("fusion_neighbours", _neighbours, MARK + ", near as (select distinct node, unnest(list_concat(before_, coalesce(after_, []))) as n from sig where signal) ==== select node, string_agg(n, ',' order by n) as near from near group by 1", "node near")
    register("marker_observations", _observations, s_sql + ", al as (select path_id, pos, node as marker, lead(node) over (partition by path_id order by pos) as allele, class from steps), own as (select * from al where class = 'none' and allele is not null), kept as (select marker from (select marker, allele from own group by 1, 2 having count(*) >= 3) group by 1 having count(*) >= 2) ==== select path_id as id, marker, arg_max(allele, pos) as allele from own where marker in (select marker from kept) group by 1, 2", "id:i marker allele")
    subs = s_sql + """, cuts as (select *, case when pos > 0 and (class = 'cyc_l' or coalesce(lag(class) over (partition by path_id order by pos), '') = 'cyc_r') then 1 else 0 end as cut from steps),
  numbered as (select *, sum(cut) over (partition by path_id order by pos) as sub from cuts),
  parts as (select path_id, sub, coalesce(arg_min(case when class = 'ref' then 'flank' when class in ('c1','c2','cyc_l','cyc_r') then 'module' end, pos) filter (class <> 'none'), 'none') as grp, count(*) > 2 as sure from numbered group by 1, 2),
  runs0 as (select *, sum((not sure)::int) over (partition by path_id order by sub) as r from parts),
  runs as (select path_id, r, string_agg(grp, '>' order by sub) as run, count(*) as k from runs0 where sure group by 1, 2)"""
    register("cigar_nodes", _cigar_nodes, CIGAR + "==== select name as path_id, row_number() over (partition by name order by case when flip then -k else k end) - 1 as pos, node, case when flip then b else a end as start_pos, case when flip then a else b end as end_pos, read as read_pos from p", "path_id pos:i node start_pos:i end_pos:i read_pos:i")
    register("node_groups", _groups, "recursive! " + LOCI + """==== select locus, node, label as "group" from labels""", "locus node:i group")
    register("subread_groups", _grouped_subreads, "recursive! " + LOCI + """, rows_ as (select l_orderkey as path_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) - 1 as pos, l_partkey as node, class, label from lineitem join nodes_ on node = l_partkey left join labels using (node)),
  kept as (select * from rows_ where path_id in (select path_id from rows_ where class in ('c1', 'c2') and label = 'module')),
  cuts as (select *, case when pos > 0 and (class = 'cyc_l' or coalesce(lag(class) over (partition by path_id order by pos), '') = 'cyc_r') then 1 else 0 end as cut from kept),
  numbered as (select *, sum(cut) over (partition by path_id order by pos) as sub from cuts)
==== select path_id, sub, coalesce(arg_min(label, pos) filter (label is not null), 'none') as "group", count(*) as n from numbered group by 1, 2""", "path_id:i sub:i group n:i")
    register("default_successors", _brand_defaults, LOCI.partition("modes(")[0].rstrip().rstrip(",") + """, kinds as (select p_partkey as node, p_size % 3 as ref, p_partkey % 5 + p_size % 4 as c from part),
  links as (select tos.node as src, b.node as dst, ord, ref, c from tos join nodes_ b on b.locus = tos.locus and b.r = tos.t join kinds k on k.node = b.node),
  kept as (select src, list_reduce(list({'dst': dst, 'ref': ref, 'c': c} order by ord), lambda x, y: case when (y.ref > 0 and y.c > x.c) or y.ref > x.ref then y else x end) as best from links group by 1)
==== select src, best.dst as dst from kept""", "src:i dst:i")
    register("cluster_paths", _event_paths, "recursive! " + s_sql + """, e as (select split_part(node, '_', 1) as src, split_part(lead(node) over (partition by path_id order by pos), '_', 1) as dst from steps),
  n as (select src, dst, count(*)::bigint as n from e where dst is not null and dst <> 'signup' and src <> 'error' group by 1, 2 having count(*) >= 20),
  w as (select concat('signup>', dst) as path, dst, n as support, 1 as k from n where src = 'signup' and dst <> 'error' union all select concat(path, '>', n.dst), n.dst, support + n, k + 1 from w join n on n.src = w.dst where k <= 3 and w.dst <> 'error')
==== select path, support from w where dst = 'error'""", "path support:i")
    register("module_adjacency", _adjacency, subs + "==== select run, count(*) as n from runs where k > 1 group by 1", "run n:i")
    register("copy_number_coverage", _copy_from_coverage, READS_SQL + """, kinds as (select p_partkey as node, case when p_partkey % 5 = 0 then 'ref' when p_partkey % 5 < 3 then 'none' else 'c1' end as class from part),
  t as (select *, unnest(range(start // 50, (stop - 1) // 50 + 1)) as b from reads where stop > start),
  hit as (select node, b, sum(greatest(0, least(stop, least(b*50+50, size)) - greatest(start, b*50)))::double / max(least(b*50+50, size) - b*50) as x from t group by 1, 2),
  allb as (select node, class, unnest(range(0, (size - 1) // 50 + 1)) as b from (select distinct node, size from reads) join kinds using (node) where class in ('ref','none')),
  bins as (select class, coalesce(x, 0) as x from allb left join hit using (node, b)),
  w as (select class, avg(x) * 0.1 as w from bins group by 1),
  r as (select a.class, a.x, count(*) as n from (select distinct class, x from bins) a join w using (class) join bins v on v.class = a.class and v.x >= a.x and v.x - a.x < w.w where a.x >= 3 group by 1, 2),
  best as (select class, x from r qualify row_number() over (partition by class order by n desc, x) = 1),
  modes as (select b.class, median(v.x) as mode from best b join w using (class) join bins v on v.class = b.class and v.x >= b.x and v.x - b.x < w.w group by 1)
==== select (select mode from modes where class = 'ref') as flank, (select mode from modes where class = 'none') as module, 2 * (select mode from modes where class = 'none') / (select mode from modes where class = 'ref') as cn""", "flank:f module:f cn:f")
    register("gene_point_nodes", _gene_points, "pts as (select s_suppkey as id, s_suppkey * 37 % 30000 as spot from supplier), nd as (select p_partkey as node, p_partkey * 7 % 20000 as lo, p_partkey * 7 % 20000 + 10000 as hi, p_size as size from part), h as (select id, node, case when spot >= lo and spot < lo + size then 'c1' else 'c2' end as module from pts join nd on (spot >= lo and spot < lo + size) or (spot >= hi and spot < hi + size)) ==== select id, node, module from h qualify row_number() over (partition by id order by node desc) = 1", "id:i node:i module")
    register("fusion_positions", _variant_rows, """nd as (select p_partkey as k, p_partkey * 3 as lo, p_partkey * 3 + p_size as hi, left(p_name, 3) as seq from part),
  f as (select concat('fus_c1_', p_partkey) as variant, case when p_size % 4 = 0 then 'c1' else 'c2' end as copy, a.lo as l1, a.hi as h1, b.lo as l2, b.hi as h2, a.seq as ref_seq from part join nd a on a.k = p_partkey join nd b on b.k = p_size where p_size % 2 = 0),
  g as (select *, round_even((l1 + l2) / 2.0, 0) as lo, round_even((h1 + h2) / 2.0, 0) as hi, round_even((abs(l1 - l2) + abs(h1 - h2)) / 4.0, 0) as pos_error from f)
==== select variant, copy, case when copy = 'c1' then lo else hi end as pos, case when copy = 'c1' then hi else lo end as "end", pos_error, ref_seq from g""", "variant copy pos:i end:i pos_error:i ref_seq")
    register("candidate_haplotypes", lambda s, d: haplotypes.top_haplotypes(steps(s, d)), s_sql + ", n as (select path_id, count(*) filter (class = 'cyc_r') + 1 as modules, count(*) filter (class in ('c1','c2')) as own from steps group by 1), top as (select path_id from n qualify row_number() over (partition by modules order by own desc, path_id) <= 3) ==== select path_id as hap, node, count(*) as n from steps where path_id in (select path_id from top) group by 1, 2", "hap:i node n:i")
    register("longest_tenth", lambda s, d: _longest_tenth(s, d), s_sql + ", l as (select path_id, count(*) as n from steps group by 1) ==== select path_id, n from l qualify row_number() over (order by n desc, path_id) <= ceil((select count(*) from l) / 10.0)", "path_id:i n:i")
    register("competition_rank", lambda s, d: haplotypes.competition_rank(steps(s, d).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path_id").alias("k"), F.max("size").alias("z")), [["n", "k"], ["z"]]).select("node", "rank"), s_sql + ", g as (select node, count(*) as n, count(distinct path_id) as k, max(size) as z from steps group by 1) ==== select node, (rank() over (order by n desc) - 1) / 2.0 + (rank() over (order by k desc) - 1) / 2.0 + rank() over (order by z desc) - 1 as rank from g", "node rank:f")
    register("split_paths", lambda s, d: views.split_paths(_viz(s, d).select("read", "readpos", "node", "class")), VIZ + """, b as (select *, node < lag(node) over (partition by read order by readpos) as back from viz), t as (select read, coalesce(avg(back::int) > 0.5, false) as turn, count(*) as n from b group by 1),
  o as (select v.*, n, row_number() over (partition by v.read order by case when turn then -readpos else readpos end) as place from viz v join t using (read)),
  c as (select *, class = 'cyc_r' and place / n::double > 0.1 and place / n::double < 0.9 as cut from o),
  p as (select *, 1 + coalesce(sum(cut::int) over (partition by read order by place rows between unbounded preceding and 1 preceding), 0) as part from c)
==== select read, readpos, node, class, part as path_part from p union all select read, readpos, node, class, part + 1 from p where cut""", "read:i readpos:i node:i class path_part:i")
    register("allele_sites", lambda s, d: _allele_sites(s, d), s_sql + ", f as (select *, last_value(case when class in ('ref','none') then node end ignore nulls) over (partition by path_id order by pos rows between unbounded preceding and current row) as rnode from steps) ==== select rnode, avg((class='c2')::int) as c2_prop, avg((class='c2')::int) as c2_prop_adj, count(*) as depth, min(node) as node from f where class in ('c1','c2') and rnode is not null group by rnode having count(distinct class) = 2", "rnode c2_prop:f c2_prop_adj:f depth:i node")
    register("coverage_tiles", lambda s, d: views.tiles(_viz(s, d)).select("node", "tile", "start", "end", "cov"), VIZ + """, o as (select node, least(startpos, endpos) as s, greatest(startpos, endpos) as e, class from viz where class in ('ref','none')), g as (select node, class, min(s) as lo, max(e) as hi, max(e) - min(s) + 1 as len from o group by 1, 2), c as (select *, greatest(ceil(len / 10.0), 1)::bigint as n from g), t as (select *, unnest(range(0, n)) as tile from c),
  u as (select node, class, tile, lo + floor(tile * len / n::double)::bigint as "start", lo + floor((tile + 1) * len / n::double)::bigint - 1 as "end" from t) ==== select u.node, tile, "start", "end", (select count(*) from o where o.node = u.node and o.s <= u."end" and o.e >= u."start") as cov from u""", "node:i tile:i start:i end:i cov:i")
    register("read_lengths", lambda s, d: views.read_lengths(_viz(s, d)), VIZ + "==== select read, count(*) as nodes, sum(endpos - startpos) / 1000.0 as kbp from viz group by 1", "read:i nodes:i kbp:f")
    register("shared_nodes", lambda s, d: views.shared_nodes(_counts(s, d)).select("node", "c1", "c2"), s_sql + ", k as (select node, count(*) filter (path_id % 2 = 0) as c1, count(*) filter (path_id % 2 = 1) as c2, min(class) as class from steps group by 1) ==== select node, c1, c2 from k where c1 > 0.8 * c2 and c2 > 0.8 * c1 and class <> 'ref'", "node c1:i c2:i")
    register("contig_bounds", lambda s, d: _bounds(s, d), INTERVALS_SQL + '==== select key, greatest(min(s) - 60000, 1) as start, max(e) + 60000 as "end" from spans group by 1', "key:i start:i end:i")
    register("joined_names", lambda s, d: views.joined_names(read(s, d, "nation"), "n_regionkey", "n_name", "n_nationkey"), "====select n_regionkey, string_agg(n_name, '_' order by n_nationkey) as names, count(distinct n_name) as n from nation group by 1", "n_regionkey:i names n:i")
    register("count_of_counts", lambda s, d: views.count_of_counts(read(s, d, "orders").select("o_custkey", F.col("o_orderstatus").alias("gene")), "o_custkey", ["F", "O"]), "k as (select o_custkey, count(*) filter (o_orderstatus = 'F') as a, count(*) filter (o_orderstatus = 'O') as b from orders group by 1) ==== select a as \"n_F\", b as \"n_O\", count(*) as keys from k group by 1, 2", "n_F:i n_O:i keys:i")
    register("first_per_key", lambda s, d: views.first_per_key(read(s, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"]), "====select o_custkey, min(o_orderkey) as o_orderkey from orders group by 1", "o_custkey:i o_orderkey:i")
    register("flipped_spans", lambda s, d: views.flipped(_stranded(s, d), "g1"), INTERVALS_SQL + """, g as (select key as sample, id, s, e, concat('g', id % 3) as gene, case when id % 2 = 0 then '+' else '-' end as strand from spans), w as (select *, min(s) over p as lo, max(e) over p as hi, max((gene = 'g1' and strand = '-')::int) over p = 1 as turn from g window p as (partition by sample))
==== select sample, id, gene, case when turn then lo + hi - e else s end as "start", case when turn then lo + hi - s else e end as "end", case when turn then translate(strand, '+-', '-+') else strand end as strand from w""", "sample:i id:i gene start:i end:i strand")
    register("shifted_spans", lambda s, d: views.shifted(_stranded(s, d), "g1").select("sample", "id", "rel_start", "rel_end"), INTERVALS_SQL + ", w as (select key as sample, id, s, e, max(case when id % 3 = 1 then s end) over (partition by key) as base from spans) ==== select sample, id, s - base as rel_start, e - base as rel_end from w", "sample:i id:i rel_start:i rel_end:i")
    register("haplotype_alignment", _alignments)


def _longest_tenth(s: SparkSession, d: str) -> DataFrame:
    n = steps(s, d).groupBy("path_id").agg(F.count(F.lit(1)).alias("n"))
    return order.longest(n, -(-n.count() // 10), [F.desc("n"), "path_id"])


def _allele_sites(s: SparkSession, d: str) -> DataFrame:
    rows = steps(s, d)
    rows = rows.withColumn("rnode", paths.forward_fill(rows, F.col("class").isin("ref", "none"), F.col("node"))).filter("rnode is not null")
    return views.allele_sites(rows).drop("pos")  # of several steps of that node any


def _counts(s: SparkSession, d: str) -> DataFrame:
    return steps(s, d).groupBy("node").agg(F.count_if(F.col("path_id") % 2 == 0).alias("c1"), F.count_if(F.col("path_id") % 2 == 1).alias("c2"), F.min("class").alias("class"))


def _bounds(s: SparkSession, d: str) -> DataFrame:
    return contig_bounds(spans(s, d).withColumnRenamed("key", "contig")).withColumnRenamed("contig", "key")


def _stranded(s: SparkSession, d: str) -> DataFrame:
    return spans(s, d).select(F.col("key").alias("sample"), "id", F.concat(F.lit("g"), F.col("id") % 3).alias("gene"), "start", "end", F.when(F.col("id") % 2 == 0, "+").otherwise("-").alias("strand"))
