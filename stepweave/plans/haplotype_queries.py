"""Queries of pairs of haplotypes, consensus walks, alignments, annotations and gene tracks on the star-schema tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepweave.operators import bisection, diplotype, guess, haplotypes, order, paths, threading, variants, views
from stepweave.plans.adapter import STEPS_SQL, read, steps

BASES = ("A", "C", "G", "T")


def _base(k):
    return F.element_at(F.array(*map(F.lit, BASES)), (k % 4 + 1).cast("int"))


def _orders_as_subreads(s: SparkSession, d: str) -> DataFrame:
    """A customer's orders in time are the subreads of a read, their priority is the cluster; pending ones are unsure. Nations are the samples."""
    sub = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = read(s, d, "orders").select("o_custkey", F.col("o_custkey").alias("path_id"), sub.alias("sub"), F.substring("o_orderpriority", 1, 1).alias("cluster"), (F.col("o_orderstatus") != "P").cast("double").alias("confidence"))
    return rows.join(read(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation")), "o_custkey")


def _best_pairs(s: SparkSession, d: str) -> DataFrame:
    rows = _orders_as_subreads(s, d)
    clusters = rows.filter("confidence > 0").select("nation", "cluster").distinct()
    return threading.best_pairs(haplotypes.adjacency(rows, ["nation"]), clusters, ["nation"], buffer=False).select("nation", "score")


PAIRS = """subs as (select c_nationkey as nation, o_custkey, substr(o_orderpriority, 1, 1) as cluster, o_orderstatus <> 'P' as sure, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as sub from orders join customer on c_custkey = o_custkey),
  cut as (select *, sum((not sure)::int) over (partition by o_custkey order by sub) as c from subs),
  each_run as (select nation, '>' || string_agg(cluster, '>' order by sub) || '>' as run, count(*) as k from cut where sure group by nation, o_custkey, c),
  runs as (select nation, run, count(*) as n from each_run where k > 1 group by 1, 2),
  names as (select distinct nation, cluster from subs where sure),
  haps as (select nation, '>' || cluster || '>' as hap, [cluster] as used from names union all select h.nation, hap || cluster || '>', list_append(used, cluster) from haps h join names n on n.nation = h.nation and not list_contains(used, cluster)),
  sets as (select nation, hap, list_sort(used) as used from haps),
  every as (select nation, list_sort(list(cluster)) as all_ from names group by 1),
  pairs as (select a.nation, a.hap as h1, b.hap as h2 from sets a join every e using (nation) join sets b on b.nation = a.nation and a.used[1] = all_[1] and b.used = [x for x in all_ if not list_contains(a.used, x)]),
  scored as (select p.nation, h1, h2, coalesce(sum(n) filter (contains(h1, run) or contains(h2, run)), 0) as score from pairs p left join runs r on r.nation = p.nation group by 1, 2, 3)"""


def _consensus(s: SparkSession, d: str) -> DataFrame:
    """Users in five clusters, each walked from a sign-up by what its users do next most often."""
    rows = steps(s, d).withColumnRenamed("path_id", "id")
    of = rows.select("id", (F.col("id") % 5).alias("cluster")).distinct()
    default = paths.best_successor(steps(s, d)).select("src", "dst")
    found = threading.consensus(rows.select("id", "pos", "node"), of, "signup_1", "error_1", default)
    return found.select("cluster", F.array_join("path", ">").alias("path"))


WALKS = STEPS_SQL + """, e as (select path_id % 5 as cluster, node as src, lead(node) over (partition by path_id order by pos) as dst from steps),
  n as (select cluster, src, dst, count(*) as n from e where dst is not null group by 1, 2, 3),
  best as (select cluster, src, dst from n qualify row_number() over (partition by cluster, src order by n desc, dst) = 1),
  spare as (select src, dst from (select src, dst, sum(n) as n from n group by 1, 2) qualify row_number() over (partition by src order by n desc, dst) = 1),
  names as (select distinct cluster from e),
  next_ as (select names.cluster, spare.src, coalesce(best.dst, spare.dst) as dst from names cross join spare left join best on best.cluster = names.cluster and best.src = spare.src where spare.src <> 'error_1'),
  w as (select cluster, 'signup_1' as node, ['signup_1'] as path from names union all select w.cluster, dst, list_append(path, dst) from w join next_ on next_.cluster = w.cluster and src = node where not list_contains(path, dst))"""


def _pair_alignment(s: SparkSession, d: str) -> DataFrame:
    """Orders as reads of as many bases as pieces, the numbers of their lines as haplotypes, the discount as the score of an alignment."""
    rows = read(s, d, "lineitem")
    length = rows.groupBy(F.col("l_orderkey").alias("read")).agg(F.sum("l_quantity").cast("long").alias("length"))
    scores = rows.groupBy(F.col("l_orderkey").alias("read"), F.concat(F.lit("h"), F.col("l_linenumber").cast("string")).alias("hap")).agg(F.max("l_discount").cast("double").alias("score")).join(length, "read")
    haps = scores.select("hap").distinct()
    pairs = haps.select(F.col("hap").alias("hap1")).join(haps.select(F.col("hap").alias("hap2")), F.expr("hap1 <= hap2"))  # seven haplotypes
    return haplotypes.pair_alignment(scores, pairs)


def _annotated(s: SparkSession, d: str) -> DataFrame:
    """Parts as alleles and suppliers as notes, of which some have a base of padding."""
    k = F.col("s_suppkey")
    one, two = _base(k), _base(F.floor(k / 4))
    notes = read(s, d, "supplier").select((k % 200 + 10).alias("start"), one.alias("ref"), F.when(k % 3 == 0, F.concat(one, two)).otherwise(two).alias("alt"), F.col("s_name").alias("id"), F.lit("n").alias("nuc.change"), F.lit("p").alias("prot.change"), k.alias("ord"))
    alleles = read(s, d, "part").select(F.col("p_partkey").alias("variant"), (F.col("p_partkey") % 200).cast("long").alias("pos"), _base(F.col("p_size")).alias("alt_seq"))
    return variants.with_annotation(alleles, notes, 10)


NOTES = """n0 as (select s_suppkey as k, s_name, ['A','C','G','T'][s_suppkey % 4 + 1] as one, ['A','C','G','T'][s_suppkey // 4 % 4 + 1] as two from supplier),
  n1 as (select *, case when k % 3 = 0 then one || two else two end as alt from n0),
  notes as (select k, k % 200 + case when one = alt[1] then 1 else 0 end as pos, case when one = alt[1] then substr(alt, 2) else alt end as alt_seq, s_name || '_n_p' as clinsig from n1),
  last as (select pos, alt_seq, arg_max(clinsig, k) as clinsig from notes group by 1, 2)"""


def _tallies(s: SparkSession, d: str) -> DataFrame:
    allele = F.when(F.col("l_returnflag") == "R", "alt").when(F.col("l_returnflag") == "N", "ref").otherwise("none")
    return views.allele_tallies(read(s, d, "lineitem").select(F.col("l_orderkey").alias("read"), F.col("l_partkey").alias("variant"), allele.alias("allele")))


def _four_metrics(s: SparkSession, d: str) -> DataFrame:
    p = read(s, d, "part").select(F.col("p_partkey").alias("pair"), (F.col("p_size") / 50).alias("cov_cor"), F.col("p_retailprice").cast("double").alias("aln_score"), (F.col("p_partkey") % 13).cast("double").alias("aln_long_prop"), (-(F.col("p_partkey") % 97)).cast("double").alias("cov_dev"))
    return diplotype.composite_rank(p, ["cov_cor", "aln_score", "aln_long_prop"], ["cov_dev"]).select("pair", "rank")


def _allele_reads(s: SparkSession, d: str) -> DataFrame:
    """Two-step alleles of the paths, on the copy that the last node's number gives, against the step to view_0: who takes which, by the local copy."""
    found = paths.successors(steps(s, d)).select("src", "dst")
    copy = F.when(F.substring("dst", -1, 1).cast("int") % 2 == 0, "c1").otherwise("c2")
    alleles = found.select(F.concat_ws(">", "src", "dst").alias("variant"), copy.alias("copy"), F.array("src", "dst").alias("alt"), F.array(F.array("src", F.lit("view_0"))).alias("refs"))
    got = variants.support(steps(s, d), alleles)
    size = lambda c: F.greatest(F.size(c), F.lit(0))
    return got.select("variant", size("reads_alt").alias("n_alt"), size("reads_ref").alias("n_ref"))


SUPPORT = STEPS_SQL + """, c as (select *, lead(node) over w as after, sum((class in ('c1', 'c2'))::int) over (partition by path_id order by pos) as m, list(class) filter (class in ('c1', 'c2')) over (partition by path_id order by pos rows between unbounded preceding and unbounded following) as l from steps window w as (partition by path_id order by pos)),
  n as (select *, coalesce(lead(m) over (partition by path_id order by pos), m) as nm from c),
  u as (select *, coalesce(l[greatest(m - 5, 0)::bigint + 1 : m::bigint], []) as up, coalesce(l[nm::bigint + 1 : least(nm + 5, len(l))::bigint], []) as down from n),
  k as (select *, len(list_filter(up, lambda x: x = 'c1')) as u1, len(list_filter(up, lambda x: x = 'c2')) as u2, len(list_filter(down, lambda x: x = 'c1')) as d1, len(list_filter(down, lambda x: x = 'c2')) as d2 from u),
  here as (select path_id, node, after, case when u2 + d2 > 3 * (u1 + d1) then 'c2' when d2 > 3 * d1 then 'c2' when u2 > 3 * u1 then 'c2' when u1 + d1 > 3 * (u2 + d2) then 'c1' end as copy from k where after is not null),
  found as (select src, dst, case when right(dst, 1)::int % 2 = 0 then 'c1' else 'c2' end as copy from (select node as src, after as dst from c where after is not null group by 1, 2 having count(*) >= 3))"""


def _in_order(s: SparkSession, d: str) -> DataFrame:
    """Orders with a returned piece, in the order of all orders by price."""
    rows = read(s, d, "orders").select(F.col("o_orderkey").alias("read"), "o_totalprice")
    kept = read(s, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("read"))
    return order.kept_in_order(rows, [F.desc("o_totalprice"), "read"], kept, "read").select("read", "place")


def _shared_markers(s: SparkSession, d: str) -> DataFrame:
    """Module-specific nodes that two users both pass, users in three parts."""
    held = steps(s, d).filter("class in ('c1', 'c2')").select((F.col("path_id") % 3).alias("part"), F.col("path_id").alias("id"), "node").distinct()
    return bisection.co_occurrence(held)


def _track(s: SparkSession, d: str) -> DataFrame:
    """Suppliers as genes along two modules whose nodes are the parts."""
    k, n = F.col("s_suppkey"), F.col("p_partkey")
    genes = read(s, d, "supplier").select(k.alias("id"), (k * 37 % 30000).alias("start"), (k * 37 % 30000 + k % 500).alias("end"), F.lit("gene").alias("type"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"), F.col("s_name").alias("gene_name"))
    kind = F.when(n == 10, "cyc_l").when(n == 150, "cyc_r").otherwise("none")
    low = n * 7 % 20000
    high = low + F.when(n % 3 == 0, 0).otherwise(10000)
    nodes = read(s, d, "part").select(n.alias("node"), low.cast("long").alias("rpos_min"), high.cast("long").alias("rpos_max"), F.col("p_size").cast("long").alias("size"), kind.alias("class"), high.cast("long").alias("pos"))
    return views.gene_track(genes, nodes)


TRACK = """genes as (select s_suppkey as id, s_suppkey * 37 % 30000 as s, s_suppkey * 37 % 30000 + s_suppkey % 500 as e, case when s_suppkey % 2 = 0 then '+' else '-' end as strand, s_name as gene_name from supplier),
  nodes_ as (select p_partkey as node, p_partkey * 7 % 20000 as lo, p_partkey * 7 % 20000 + case when p_partkey % 3 = 0 then 0 else 10000 end as hi, p_size as size from part),
  hit as (select id, min(node) as a, max(node) as b from genes join nodes_ on node between 10 and 150 and ((s <= lo + size - 1 and e >= lo) or (s <= hi + size - 1 and e >= hi)) group by 1),
  totals as (select quantile_cont(case when lo <> hi then hi - lo end, 0.5) as jump, min(hi) as first, max(case when node = 10 then hi end) as border from nodes_),
  track as (select id, gene_name, strand, a as nstart, case when a = b then b + 1 else b end as nend, case when (s + e) / 2.0 < border then 'c1' else 'c2' end as module,
    case when (s + e) / 2.0 < first then s + jump else s end as pstart, case when (s + e) / 2.0 < first then e + jump else e end as pend from genes left join hit using (id), totals)"""


def add(register) -> None:
    register("best_pair_scores", _best_pairs, "recursive!" + PAIRS + "==== select nation, max(score) as score from scored group by 1", "nation:i score:i")
    register("consensus_paths", _consensus, "recursive!" + WALKS + "==== select cluster, array_to_string(arg_max(path, len(path)), '>') as path from w group by 1", "cluster:i path")
    register("pair_alignment", _pair_alignment, """r as (select l_orderkey as read, sum(l_quantity)::bigint as length from lineitem group by 1),
  s as (select l_orderkey as read, concat('h', l_linenumber) as hap, max(l_discount)::double as score from lineitem group by 1, 2),
  long_ as (select read from r order by length desc, read limit (select ceil(count(*) / 10.0)::bigint from r)),
  b as (select x.hap as hap1, y.hap as hap2, x.read, greatest(x.score, y.score) as g from s x join s y on x.read = y.read and x.hap <= y.hap),
  m as (select hap1, hap2, avg(g) as mean, max(g) as most from b group by 1, 2),
  w as (select hap1, hap2, count(*) as w from b join m using (hap1, hap2) where read in (select read from long_) and g > mean + 0.8 * (most - mean) group by 1, 2)
==== select hap1, hap2, mean as aln_score, coalesce(w, 0) / ((select count(*) from r) / 10.0) as aln_long_prop from m left join w using (hap1, hap2)""", "hap1 hap2 aln_score:f aln_long_prop:f")
    register("padded_annotation", _annotated, NOTES + "==== select p_partkey as variant, p_partkey % 200 as pos, ['A','C','G','T'][p_size % 4 + 1] as alt_seq, clinsig from part left join last on last.pos = p_partkey % 200 and last.alt_seq = ['A','C','G','T'][p_size % 4 + 1]", "variant:i pos:i alt_seq clinsig")
    register("allele_tallies", _tallies, "==== select l_orderkey as read, count(*) filter (l_returnflag = 'N') as nref, count(*) filter (l_returnflag = 'R') as nalt from lineitem group by 1", "read:i nref:i nalt:i")
    register("four_metric_rank", _four_metrics, "m as (select p_partkey as pair, p_size / 50.0 as a, p_retailprice::double as b, p_partkey % 13 as c, -(p_partkey % 97) as d from part), t as (select max(a) as ma, max(b) as mb, max(c) as mc, max(d) as md, min(d) as nd from m) ==== select pair, (1 - a / ma + 1 - b / mb + 1 - c / mc + 1 - (d - nd) / (md - nd)::double) / 4 as rank from m, t", "pair:i rank:f")
    register("gene_track", lambda s, d: _track(s, d).select("id", "nstart", "nend", "module", "pstart", "pend").fillna(0), TRACK + "==== select id, coalesce(nstart, 0) as nstart, coalesce(nend, 0) as nend, module, pstart, pend from track", "id:i nstart:i nend:i module pstart:f pend:f")
    register("transcription_starts", lambda s, d: views.transcription_starts(_track(s, d)).fillna(0), TRACK + "==== select gene_name, module, coalesce(case when strand = '+' then nstart else nend end, 0) as node, case when strand = '+' then pstart else pend end as pos from track", "gene_name module node:i pos:f")
    register("allele_reads", _allele_reads, SUPPORT + "==== select concat(src, '>', dst) as variant, count(distinct path_id) filter (after = dst and dst <> 'view_0') as n_alt, count(distinct path_id) filter (after = 'view_0' and dst <> 'view_0') as n_ref from found left join here on here.node = src and here.copy = found.copy group by 1", "variant n_alt:i n_ref:i")
    visits = lambda s, d, kind: steps(s, d).filter(F.col("class") == kind).select(F.col("path_id").alias("read"), "pos")
    register("position_union", lambda s, d: paths.position_union(visits(s, d, "c1"), visits(s, d, "c2"), visits(s, d, "cyc_l")).select("read", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions")), STEPS_SQL + """, u as (select path_id as read, pos from steps where class in ('c1', 'c2', 'cyc_l')) ==== select read, string_agg(pos, ',' order by pos) as positions from u group by 1""", "read:i positions")
    register("reads_in_order", _in_order, "o as (select o_orderkey as read, row_number() over (order by o_totalprice desc, o_orderkey) as place from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R')) ==== select * from o", "read:i place:i")
    register("shared_markers", _shared_markers, STEPS_SQL + """, h as (select distinct path_id % 3 as part, path_id as id, node from steps where class in ('c1', 'c2')) ==== select x.part, x.id as a, y.id as b, count(*) as w from h x join h y on x.part = y.part and x.node = y.node and x.id < y.id group by 1, 2, 3""", "part:i a:i b:i w:i")
    register("module_guess", lambda s, d: guess.modules(steps(s, d)))
