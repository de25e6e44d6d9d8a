"""The registered queries: each applies an operator to whole tables; ORACLE_SQL has the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave import functions as fn
from stepweave.operators import calls, copynumber, diplotype, graph, haplotypes, intervals, locus, paths, variants
from stepweave.plans import haplotype_queries, locus_queries
from stepweave.plans.adapter import INTERVALS_SQL, READS_SQL, STEPS_SQL, read, reads, spans, steps

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_INTS = ("tinyint", "smallint", "int", "bigint")


def final(df: DataFrame) -> DataFrame:
    """Integers as long, fractions as double rounded to six places, so that both engines compare equal."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out.append((c.cast("long") if kind in _INTS else F.round(c.cast("double"), 6) if kind in ("double", "float") or kind.startswith("decimal") else c).alias(name))
    return df.select(*out)


def register(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str | None = None, columns: str = "") -> None:
    """columns: names, with :i for integers, :f for fractions and nothing for the rest."""
    QUERIES[name] = lambda spark, sf_dir: final(make(spark, sf_dir))
    if sql:
        parts = [c.split(":") for c in columns.split()]
        cast = ", ".join(f'cast("{p[0]}" as bigint) as "{p[0]}"' if p[1:] == ["i"] else f'round(cast("{p[0]}" as double), 6) as "{p[0]}"' if p[1:] == ["f"] else f'"{p[0]}"' for p in parts)
        head, _, body = sql.rpartition("====")
        recursive = "recursive " if "recursive!" in head else ""
        ctes = [c for c in (head.replace("recursive!", "").strip(),) if c]
        ORACLE_SQL[name] = f"with {recursive}" + ", ".join([*ctes, f"result_ as ({body})"]) + f" select {cast} from result_"


S = STEPS_SQL
EDGES = S + ", edges as (select path_id, pos, node as src, lead(node) over (partition by path_id order by pos) as dst from steps)"
SUPPORT = EDGES + ", support as (select src, dst, count(*) as n, count(distinct path_id) as n_paths from edges where dst is not null group by 1, 2)"
SUBS = S + """, cuts as (select *, case when pos > 0 and (class = 'cyc_l' or coalesce(lag(class) over (partition by path_id order by pos), '') = 'cyc_r') then 1 else 0 end as cut from steps),
  numbered as (select *, cast(sum(cut) over (partition by path_id order by pos) as bigint) as sub from cuts),
  subs as (select *, row_number() over (partition by path_id, sub order by pos) - 1 as sub_pos,
    coalesce(first_value(case when class = 'ref' then 'flank' when class in ('c1','c2','cyc_l','cyc_r') then 'module' end ignore nulls) over (partition by path_id, sub order by pos rows between unbounded preceding and unbounded following), 'none') as grp from numbered)"""
MARKERS = S + ", markers as (select *, row_number() over (partition by path_id order by pos) - 1 as marker_pos, count(*) over (partition by path_id) as total from steps where class in ('c1','c2'))"
WINDOWS = MARKERS + """, w as (select *, sum((class='c1')::int) over up as up_c1, sum((class='c2')::int) over up as up_c2, sum((class='c1')::int) over down as down_c1, sum((class='c2')::int) over down as down_c2,
    lead(class) over (partition by path_id order by pos) as after from markers
    window up as (partition by path_id order by pos rows between 3 preceding and 1 preceding), down as (partition by path_id order by pos rows between current row and 2 following)),
  windows as (select *, case when up_c1 > 4*up_c2 then 'c1' when up_c2 > 4*up_c1 then 'c2' end as up, case when down_c1 > 4*down_c2 then 'c1' when down_c2 > 4*down_c1 then 'c2' end as down from w where marker_pos >= 3 and marker_pos < total - 3 and total > 6)"""

register("edge_support", lambda s, d: paths.edge_support(steps(s, d)), SUPPORT + "==== select * from support", "src dst n:i n_paths:i")
register("successors", lambda s, d: paths.successors(steps(s, d)), SUPPORT + "==== select * from support where n >= 3", "src dst n:i")
register("best_successor", lambda s, d: paths.best_successor(steps(s, d)), SUPPORT + "==== select * from support qualify row_number() over (partition by src order by n desc, dst) = 1", "src dst n:i")
register("node_coverage", lambda s, d: paths.node_coverage(steps(s, d)), S + "==== select node, count(*) as n, count(distinct path_id) as n_paths from steps group by 1", "node n:i n_paths:i")
register("coverage_norm", lambda s, d: paths.coverage_norm(steps(s, d)), S + "==== select sqrt(sum(n*n)) as norm from (select count(*)::double as n from steps group by node)", "norm:f")
register("path_multiplicity", lambda s, d: paths.multiplicity(steps(s, d)), S + "==== select path_id, node, count(*) as n from steps group by 1, 2", "path_id:i node n:i")
register("refpos_running", lambda s, d: paths.running_position(steps(s, d)), S + "==== select path_id, pos, node, coalesce(sum(size) over (partition by path_id order by pos rows between unbounded preceding and 1 preceding), 0) as read_pos from steps", "path_id:i pos:i node read_pos:i")
RNODE = S + ", filled as (select *, last_value(case when class in ('ref','none') then node end ignore nulls) over (partition by path_id order by pos rows between unbounded preceding and current row) as rnode from steps), region as (select node, rnode from filled where rnode is not null qualify row_number() over (partition by node order by path_id, pos) = 1)"
register("rnode_ffill", lambda s, d: paths.region_node(steps(s, d)), RNODE + "==== select * from region", "node rnode")
register("subread_split", lambda s, d: paths.split_subreads(steps(s, d)).select("path_id", "pos", "node", "sub", "sub_pos", "group"), SUBS + '==== select *, grp as "group" from subs', "path_id:i pos:i node sub:i sub_pos:i group")
register("subread_filter", lambda s, d: paths.drop_lone_flanks(paths.split_subreads(steps(s, d))).select("path_id", "pos", "sub"), SUBS + "==== select path_id, pos, sub from subs where path_id in (select path_id from subs group by 1 having max(sub) > 0 or min(case when sub = 0 then grp end) = 'module')", "path_id:i pos:i sub:i")
register("informative_paths", lambda s, d: paths.informative(steps(s, d)).select("path_id", "pos", "node"), S + "==== select * from steps where path_id in (select path_id from steps where class in ('c1','c2'))", "path_id:i pos:i node")
register("subread_select", lambda s, d: paths.select_module(paths.split_subreads(steps(s, d)), "c1", 2), SUBS + "==== select path_id, sub, count(*) filter (class in ('c1','c2')) as inf, count(*) filter (class = 'c1') as own from subs group by 1, 2 having count(*) filter (class in ('c1','c2')) > 2 and count(*) filter (class = 'c1') > 0.5 * count(*) filter (class in ('c1','c2'))", "path_id:i sub:i inf:i own:i")
register("marker_windows", lambda s, d: paths.marker_windows(steps(s, d), 3), WINDOWS + "==== select * from windows", "path_id:i pos:i node class marker_pos:i up_c1:i up_c2:i down_c1:i down_c2:i up down")
register("module_ordinal", lambda s, d: paths.module_ordinal(steps(s, d)), S + "==== select *, 1 + coalesce(sum((class='cyc_r')::int) over (partition by path_id order by pos rows between unbounded preceding and 1 preceding), 0) as module from steps", "path_id:i pos:i node module:i")
register("nearest_markers", lambda s, d: paths.local_copy(steps(s, d)), S + """, c as (select *, sum((class='c1')::int) over (partition by path_id order by pos) as n1, sum((class='c2')::int) over (partition by path_id order by pos) as n2 from steps),
  o as (select path_id, n1 + n2 as m, n1 as t from c where class in ('c1','c2') union all select distinct path_id, 0, 0 from steps),
  z as (select c.*, n1 + n2 as m, max(n1 + n2) over (partition by path_id) as a, coalesce(lead(n1 + n2) over (partition by path_id order by pos), n1 + n2) as nm, coalesce(lead(n1) over (partition by path_id order by pos), n1) as nn1 from c),
  y as (select z.*, greatest(z.m - 5, 0) as low, least(z.nm + 5, a) as high from z),
  x as (select y.path_id, y.pos, y.n1 - l.t as up_c1, (y.m - low) - (y.n1 - l.t) as up_c2, h.t - y.nn1 as down_c1, (high - y.nm) - (h.t - y.nn1) as down_c2 from y join o l on l.path_id = y.path_id and l.m = low join o h on h.path_id = y.path_id and h.m = high)
==== select *, case when up_c2 + down_c2 > 3*(up_c1 + down_c1) then 'c2' when down_c2 > 3*down_c1 then 'c2' when up_c2 > 3*up_c1 then 'c2' when up_c1 + down_c1 > 3*(up_c2 + down_c2) then 'c1' end as copy from x""", "path_id:i pos:i up_c1:i up_c2:i down_c1:i down_c2:i copy")
PAIRS = SUBS + ", allele as (select node as marker, lead(node) over (partition by path_id order by pos) as allele, class from subs), counts as (select marker, allele, count(*) as n from allele where class = 'none' and allele is not null group by 1, 2)"
register("marker_profile", lambda s, d: paths.marker_profile(paths.split_subreads(steps(s, d))), PAIRS + "==== select * from counts where marker in (select marker from counts where n >= 3 group by 1 having count(*) >= 2)", "marker allele n:i")
register("submatch", lambda s, d: paths.contains_run(steps(s, d), ["c1", "none", "c2"]), S + ", r as (select path_id, class, lead(class) over (partition by path_id order by pos) as b, lead(class, 2) over (partition by path_id order by pos) as c from steps) ==== select path_id, count(*) as n from r where class = 'c1' and b = 'none' and c = 'c2' group by 1", "path_id:i n:i")

FLANK = S + ", near as (select *, max((class='ref')::int) over (partition by path_id order by pos rows between 20 preceding and 19 following) as near from steps), n as (select count(*) filter (near = 1) / 2.0 as fl, count(*) filter (near = 0) / 2.0 as cyc from near where class in ('cyc_l','cyc_r'))"
register("copy_number_flanks", lambda s, d: copynumber.flank_copy_number(steps(s, d)), FLANK + "==== select fl, cyc, 2*(fl+cyc)/nullif(fl, 0) as cn from n", "fl:f cyc:f cn:f")
register("flank_edges_onesided", lambda s, d: copynumber.one_sided_flanks(steps(s, d)), S + ", near as (select class, coalesce(case when class = 'cyc_l' then max((class='ref')::int) over (partition by path_id order by pos rows between 20 preceding and 1 preceding) else max((class='ref')::int) over (partition by path_id order by pos rows between 1 following and 20 following) end, 0) as near from steps) ==== select class, count(*) filter (near = 1) as fl, count(*) filter (near = 0) as cyc from near where class in ('cyc_l','cyc_r') group by 1", "class fl:i cyc:i")
register("binned_coverage", lambda s, d: copynumber.binned_coverage(reads(s, d)), READS_SQL + ', t as (select *, unnest(range(start // 50, (stop - 1) // 50 + 1)) as b from reads where stop > start) ==== select node, b as bin, sum(greatest(0, least(stop, least(b*50+50, size)) - greatest(start, b*50)))::double / max(least(b*50+50, size) - b*50) as coverage from t group by 1, 2', "node:i bin:i coverage:f")
register("edge_in_out", lambda s, d: copynumber.edge_sides(steps(s, d)), S + ", e as (select node, class, lag(node) over (partition by path_id order by pos) as p, lead(node) over (partition by path_id order by pos) as q from steps), u as (select node, p as enode, 'in' as side from e where class in ('ref','none') union all select node, q, 'out' from e where class in ('ref','none')) ==== select node, enode, side, count(*) as n from u where enode is not null group by 1, 2, 3", "node enode side n:i")
VIS = S + ", visits as (select node, class, count(*)::double as x from steps group by 1, 2)"
register("mode_estimate", lambda s, d: copynumber.mode_estimate(steps(s, d).groupBy("node").agg(F.count(F.lit(1)).cast("double").alias("x"))), VIS + ", r as (select a.x, count(*) as n from (select distinct x from visits) a join visits b on b.x >= a.x and b.x - a.x < (select avg(x) * 0.1 from visits) group by 1), best as (select x from r order by n desc, x limit 1) ==== select median(v.x) as mode, count(*) as n from visits v, best where v.x >= best.x and v.x - best.x < (select avg(x) * 0.1 from visits)", "mode:f n:i")
register("coverage_norm_flank", lambda s, d: copynumber.normalised_coverage(steps(s, d)), VIS + "==== select node, class, 2 * x / nullif((select median(x) from visits where class = 'ref'), 0) as cn from visits", "node class cn:f")
register("allele_balance", lambda s, d: copynumber.allele_balance(steps(s, d), paths.region_node(steps(s, d))), RNODE + "==== select rnode, avg((class='c2')::int) as c2_prop, count(*) as depth from steps join region using (node) where class in ('c1','c2') group by 1 having max((class='c2')::int) = 1 and min((class='c2')::int) = 0", "rnode c2_prop:f depth:i")
register("read_n50", lambda s, d: copynumber.n50(steps(s, d).groupBy("path_id").agg(F.count(F.lit(1)).alias("length"))), S + ", l as (select count(*) as length from steps group by path_id), r as (select length, sum(length) over (order by length) as run, sum(length) over () as a from l) ==== select (select median(length) from l) as median, (select max(length) from l) as longest, (select min(length) from r where run > a / 2) as n50", "median:f longest:i n50:i")
register("pct_aligned", lambda s, d: reads(s, d).groupBy("path_id").agg(F.sum(F.col("end") - F.col("start")).alias("a"), F.sum("size").alias("b")).agg(F.percentile(100.0 * F.col("a") / F.col("b"), F.lit(0.5)).alias("median_pct"), F.count(F.lit(1)).alias("n")), READS_SQL + ", r as (select 100.0::double * sum(stop - start) / sum(size) as p from reads group by path_id) ==== select median(p) as median_pct, count(*) as n from r", "median_pct:f n:i")

HAPS = S + ", rc as (select node, count(*) as n from steps group by 1), md as (select path_id, count(*) filter (class = 'cyc_r') + 1 as modules, count(*) filter (class in ('c1','c2')) as own from steps group by 1), top as (select path_id from md qualify row_number() over (partition by modules order by own desc, path_id) <= 2), hc as (select path_id as hap, node, count(*) as n from steps where path_id in (select path_id from top) group by 1, 2), hp as (select a.hap as hap1, b.hap as hap2 from (select distinct hap from hc) a join (select distinct hap from hc) b on a.hap <= b.hap), pc as (select hap1, hap2, node, sum(n) as c from (select hap1, hap2, node, n from hp join hc on hap = hap1 union all select hap1, hap2, node, n from hp join hc on hap = hap2) group by 1, 2, 3), f as (select hp.hap1, hp.hap2, rc.node, rc.n::double as r, coalesce(c, 0)::double as c from hp cross join rc left join pc on pc.hap1 = hp.hap1 and pc.hap2 = hp.hap2 and pc.node = rc.node)"


def _haps(s, d):
    """Candidate haplotypes, chosen from all paths: the two with the most module-specific steps of each number of modules. All paths are reads."""
    return haplotypes.top_haplotypes(steps(s, d), 2)


METRICS = HAPS + ", m as (select hap1, hap2, median(r / c) filter (c > 0) as m from f group by 1, 2), metrics as (select f.hap1, f.hap2, case when var_pop(r) = 0 and var_pop(c) = 0 then 1 when var_pop(r) = 0 or var_pop(c) = 0 then 0.5 else covar_pop(r, c) / sqrt(var_pop(r) * var_pop(c)) end as cov_cor, sum(r*c) / (sqrt(sum(r*r)) * sqrt(sum(c*c))) as cov_cosine, -avg(abs(r - c * m)) as cov_dev from f join m using (hap1, hap2) group by 1, 2)"
_metrics = lambda s, d: diplotype.pair_metrics(paths.node_coverage(steps(s, d)), _haps(s, d))
register("pair_coverage", _metrics, METRICS + "==== select * from metrics", "hap1:i hap2:i cov_cor:f cov_cosine:f cov_dev:f")
register("hap_ll", lambda s, d: diplotype.pair_likelihood(paths.node_coverage(steps(s, d)), _haps(s, d)), HAPS + "==== select hap1, hap2, sum(lgamma(r+1) - lgamma(floor(r/2)+1) - lgamma(r-floor(r/2)+1) + floor(r/2) * ln(case c when 0 then 0.01 when 1 then 0.5 else 0.99 end) + (r - floor(r/2)) * ln(1 - case c when 0 then 0.01 when 1 then 0.5 else 0.99 end)) as hap_ll from f group by 1, 2", "hap1:i hap2:i hap_ll:f")
register("diplotype_rank", lambda s, d: diplotype.composite_rank(_metrics(s, d), ["cov_cor"], ["cov_dev"]).select("hap1", "hap2", "rank"), METRICS + "==== select hap1, hap2, ((1 - coalesce(cov_cor / nullif(max(cov_cor) over (), 0), 0)) + (1 - coalesce((cov_dev - min(cov_dev) over ()) / nullif(max(cov_dev) over () - min(cov_dev) over (), 0), 0))) / 2 as rank from metrics", "hap1:i hap2:i rank:f")
OBS = SUBS + ", seen as (select path_id, node as marker, lead(node) over (partition by path_id order by pos) as allele, class, pos from subs), obs as (select path_id as id, marker, allele from seen where class in ('none','ref') and allele is not null qualify row_number() over (partition by path_id, marker order by pos desc) = 1), sim as (select a.id as a, b.id as b, count(*) as common, count(*) filter (a.allele = b.allele) as same, count(*) filter (a.allele = b.allele)::double / count(*) as sim from obs a join obs b on a.marker = b.marker and a.id < b.id group by 1, 2)"


def _observed(s, d):
    """A path's last allele (next node) at each of its none and ref nodes."""
    rows = steps(s, d).withColumn("allele", F.lead("node").over(paths.by_path())).filter("class in ('none', 'ref') and allele is not null")
    return rows.groupBy(F.col("path_id").alias("id"), F.col("node").alias("marker")).agg(F.max_by("allele", "pos").alias("allele"))


register("pair_similarity", lambda s, d: diplotype.similarity(_observed(s, d)), OBS + "==== select * from sim", "a:i b:i common:i same:i sim:f")
register("adjusted_similarity", lambda s, d: diplotype.neighbour_weights(_observed(s, d), 3, 2, 150), OBS + ", both_ as (select a, b, sim from sim where common >= 3 union all select b, a, sim from sim where common >= 3), r as (select *, count(*) over (partition by a order by sim desc range between unbounded preceding and current row) as rk from both_) ==== select a, b, case when rk < 75 then 1 - rk / 75.0::double else 0 end as weight from r", "a:i b:i weight:f")
register("rank_last", lambda s, d: diplotype.rank_last(paths.multiplicity(steps(s, d)), "path_id", "n"), S + ", m as (select path_id, node, count(*) as n from steps group by 1, 2) ==== select *, count(*) over (partition by path_id order by n desc range between unbounded preceding and current row) as rk from m", "path_id:i node n:i rk:i")
register("quantile_index", lambda s, d: diplotype.quantile_at(steps(s, d), "value", 0.25), S + ", o as (select value, row_number() over (order by value) - 1 as k, count(*) over () as n from steps) ==== select value from o where k = cast(floor(n * 0.25) as bigint)", "value:f")
register("embedding_cosine", lambda s, d: _label_cosine(s, d), "l as (select label, unnest(range(64)) as i, unnest(embedding)::double as v from embeddings), c as (select label, i, sum(v) as v from l group by 1, 2) ==== select a.label as a, b.label as b, sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v))) as cosine from c a join c b on a.i = b.i and a.label < b.label group by 1, 2", "a:i b:i cosine:f")


def _label_cosine(s, d):
    """Cosine of the label sums of embeddings, on coverage-like vectors."""
    v = read(s, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.sum(F.col("v").cast("double")).alias("v"))
    two = v.select(F.col("label").alias("b"), "i", F.col("v").alias("w"))
    pairs = v.withColumnRenamed("label", "a").join(two, "i").filter("a < b")
    return pairs.groupBy("a", "b").agg((F.sum(F.col("v") * F.col("w")) / (F.sqrt(F.sum(F.col("v") * F.col("v"))) * F.sqrt(F.sum(F.col("w") * F.col("w"))))).alias("cosine"))


I = INTERVALS_SQL  # noqa: E741
# Two kinds of interval, as genes and repeats: open orders against the rest, all of them.
WHOLE = I + ", l as (select spans.* from spans join orders on o_orderkey = id where o_orderstatus = 'O'), r as (select spans.* from spans join orders on o_orderkey = id where o_orderstatus is distinct from 'O')"
_open = lambda s, d: spans(s, d, "o_orderstatus = 'O'")
_rest = lambda s, d: spans(s, d, "not o_orderstatus <=> 'O'")
_at = lambda df: df.select("key", "id", F.col("start").alias("at"))
register("interval_overlap_whole", lambda s, d: intervals.overlaps(_open(s, d), _rest(s, d)).select("key", "l_id", "r_id"), WHOLE + "==== select l.key, l.id as l_id, r.id as r_id from l join r on l.key = r.key and l.s <= r.e and r.s <= l.e", "key:i l_id:i r_id:i")
register("count_overlaps_whole", lambda s, d: intervals.count_overlaps(_open(s, d), _rest(s, d)), WHOLE + "==== select l.key, l.id as l_id, count(r.id) as n from l left join r on l.key = r.key and l.s <= r.e and r.s <= l.e group by 1, 2", "key:i l_id:i n:i")
register("interval_within", lambda s, d: intervals.within(spans(s, d), spans(s, d)), I + "==== select l.key, l.id as l_id, r.id as r_id from spans l join spans r on l.key = r.key and l.s >= r.s and l.e <= r.e and l.id <> r.id", "key:i l_id:i r_id:i")
register("interval_semi_whole", lambda s, d: intervals.semi(_open(s, d), _rest(s, d)).select("key", "id"), WHOLE + "==== select key, id from l where exists (select 1 from r where l.key = r.key and l.s <= r.e and r.s <= l.e)", "key:i id:i")
register("interval_anti_whole", lambda s, d: intervals.semi(_open(s, d), _rest(s, d), keep=False).select("key", "id"), WHOLE + "==== select key, id from l where not exists (select 1 from r where l.key = r.key and l.s <= r.e and r.s <= l.e)", "key:i id:i")
register("interval_flag_whole", lambda s, d: intervals.flagged(_open(s, d), _rest(s, d)).select("key", "id", F.col("any").cast("int").alias("any")), WHOLE + '==== select key, id, exists (select 1 from r where l.key = r.key and l.s <= r.e and r.s <= l.e)::int as "any" from l', "key:i id:i any:i")
register("band_intersect_whole", lambda s, d: intervals.band_pairs(_at(_open(s, d)), _at(_rest(s, d)), 7), WHOLE + "==== select l.key, count(*) as n from l join r on l.key = r.key and abs(l.s - r.s) <= 7 group by 1", "key:i n:i")
register("band_anti_whole", lambda s, d: intervals.band_anti(_at(_open(s, d)), _at(_rest(s, d)), 7).select("key", "id"), WHOLE + "==== select key, id from l where not exists (select 1 from r where l.key = r.key and abs(l.s - r.s) <= 7)", "key:i id:i")
register("band_tally_whole", lambda s, d: intervals.band_anti_tally(_at(_open(s, d)), _at(_rest(s, d)), 7), WHOLE + ", f as (select key, exists (select 1 from r where l.key = r.key and abs(l.s - r.s) <= 7) as hit from l) ==== select key, count(*) filter (not hit) as kept, count(*) filter (hit) as removed from f group by 1", "key:i kept:i removed:i")
register("region_bounds", lambda s, d: spans(s, d).groupBy("key").agg((F.min("start") - 60).alias("start"), (F.max("end") + 60).alias("end"), F.countDistinct("id").alias("n")), I + '==== select key, min(s) - 60 as start, max(e) + 60 as "end", count(distinct id) as n from spans group by 1', "key:i start:i end:i n:i")

CALLS = "calls as (select concat('v', cast(l_partkey as varchar)) as variant, min(l_suppkey) as pos, max(l_suppkey) as stop, min(l_returnflag) as copy, max(case when l_quantity >= 49 then l_linestatus end) as clinsig from lineitem group by 1)"


def _calls(s, d):
    n = read(s, d, "lineitem").groupBy(F.concat(F.lit("v"), F.col("l_partkey")).alias("variant"))
    return n.agg(F.min("l_suppkey").alias("pos"), F.max("l_suppkey").alias("end"), F.min("l_returnflag").alias("flag"), F.max(F.when(F.col("l_quantity") >= 49, F.col("l_linestatus"))).alias("clinsig")).select("variant", "pos", "end", F.when(F.col("flag") == "A", "c1").otherwise("c2").alias("copy"), "clinsig")


register("filter_calls", lambda s, d: calls.filter_calls(_calls(s, d), "1", 10, 60, annotated=True, fusion=True), CALLS + """==== select variant, pos, stop as "end", 'c1' as copy, clinsig from calls where copy = 'A' and pos <= 60 and stop >= 10 and (clinsig is not null or starts_with(variant, 'fus_'))""", "variant pos:i end:i copy clinsig")
register("annotation_match", lambda s, d: calls.match_annotation(_calls(s, d).select("variant", "pos", F.col("copy").alias("alt")), read(s, d, "supplier").select(F.col("s_suppkey").alias("pos"), F.when(F.col("s_nationkey") % 2 == 0, "c1").otherwise("c2").alias("alt"), F.col("s_name").alias("clinsig"), F.col("s_suppkey").alias("ord"))), CALLS + ", v as (select variant, pos, case when copy = 'A' then 'c1' else 'c2' end as alt from calls), a as (select s_suppkey as pos, case when s_nationkey % 2 = 0 then 'c1' else 'c2' end as alt, arg_max(s_name, s_suppkey) as clinsig from supplier group by 1, 2) ==== select v.pos, v.alt, variant, clinsig from v left join a using (pos, alt)", "pos:i alt variant clinsig")
register("allele_support", lambda s, d: calls.allele_support(steps(s, d)), EDGES + ", p as (select distinct path_id, src, dst from edges where dst is not null), n as (select src, count(distinct path_id) as n_all from p group by 1) ==== select p.src, p.dst, count(*) as n_alt, max(n_all) - count(*) as n_other from p join n using (src) group by 1, 2", "src dst n_alt:i n_other:i")
LISTS = S + ", lists as (select node as variant, list(distinct concat('r', path_id, '_sr', pos % 3)) filter (class in ('c1','c2')) as reads_alt, list(distinct concat('r', path_id, '_sr', pos % 3)) filter (class not in ('c1','c2')) as reads_ref, max(case when class = 'c1' then 'Pathogenic' end) as clinsig from steps group by 1), long as (select regexp_replace(r, '_sr[0-9]+$', '') as read, label, allele from (select unnest(reads_alt) as r, coalesce(clinsig, variant) as label, 'alt' as allele from lists union all select unnest(reads_ref), coalesce(clinsig, variant), 'ref' from lists))"


def _lists(s, d):
    name = F.concat(F.lit("r"), F.col("path_id"), F.lit("_sr"), F.col("pos") % 3)
    own = F.col("class").isin("c1", "c2")
    return steps(s, d).groupBy(F.col("node").alias("variant")).agg(F.collect_set(F.when(own, name)).alias("reads_alt"), F.collect_set(F.when(~own, name)).alias("reads_ref"), F.max(F.when(F.col("class") == "c1", "Pathogenic")).alias("clinsig"))


register("calls_explode", lambda s, d: calls.explode_calls(_lists(s, d)), LISTS + "==== select * from long", "read label allele")
register("calls_pivot", lambda s, d: calls.pivot_calls(calls.explode_calls(_lists(s, d)), ["Pathogenic", "purchase_1", "view_2"]), LISTS + "==== select read, max((label = 'Pathogenic' and allele = 'alt')::int) as \"Pathogenic\", max((label = 'purchase_1' and allele = 'alt')::int) as purchase_1, max((label = 'view_2' and allele = 'alt')::int) as view_2 from long group by 1", "read Pathogenic:i purchase_1:i view_2:i")
register("top_reads_per_variant", lambda s, d: calls.top_reads(paths.multiplicity(steps(s, d)).select(F.col("node").alias("variant"), F.col("path_id").alias("read"), F.col("n").alias("length")), 3), S + ", m as (select node as variant, path_id as read, count(*) as length from steps group by 1, 2) ==== select *, row_number() over (partition by variant order by length desc, read) as place from m qualify place <= 3", "variant read:i length:i place:i")

_supported = lambda s, d: paths.successors(steps(s, d)).select("src", "dst")  # noqa: E731  edges with the reference's support, for the whole closure
BUBBLES = locus_queries.WALK + RNODE.removeprefix(S).replace("filled", "carried") + EDGES.removeprefix(S) + """, g as (select src, dst from edges where dst is not null group by 1, 2 having count(*) >= 3),
  nd as (select c.node, c.size, rpos_min as lo, rpos_max as hi, rnode, class from coords c join (select distinct node, class from steps) using (node) left join region using (node)),
  trail as (select node as start, node as here, [node] as path from nd where class = 'none'
    union all select start, g.dst, list_append(path, g.dst) from trail join g on g.src = here join nd n on n.node = g.dst where n.rnode = start and not list_contains(path, g.dst))"""


def _node_table(s, d):
    at = locus.reference_coordinates(steps(s, d), steps(s, d).select("node", "size").distinct(), locus_queries.REF)
    return at.join(steps(s, d).select("node", "class").distinct(), "node").join(paths.region_node(steps(s, d)), "node", "left")


register("bubble_alleles", lambda s, d: variants.alleles(_node_table(s, d), paths.successors(steps(s, d)).select("src", "dst")).select("variant", F.size("alt").alias("n")), "recursive!" + BUBBLES + "==== select distinct array_to_string(list_append(path, g.dst), '_') as variant, len(path) + 1 as n from trail join g on g.src = here join nd n on n.node = g.dst join nd b on b.node = start where n.rnode is distinct from start and n.class = 'none' and len(path) > 1 and least(abs(n.lo - b.lo - b.size), abs(n.hi - b.hi - b.size)) < 50", "variant n:i")
CLOSURE = SUPPORT + ", g as (select src, dst from support where n >= 3), bound as (select count(*) as most from (select src from g union select dst from g)), walk as (select src, dst, 1 as steps from g union select walk.src, g.dst, steps + 1 from walk join g on g.src = walk.dst cross join bound where steps < most), closure as (select src, dst, min(steps) as steps from walk group by 1, 2)"
register("reachability_closure", lambda s, d: graph.reachable(_supported(s, d), None), "recursive!" + CLOSURE + "==== select * from closure", "src dst steps:i")
# Edges from regions to nations to groups of suppliers: no cycle, so that there are edges that exclude each other.
TREE = "e as (select distinct concat('r', n_regionkey) as src, concat('n', n_nationkey) as dst from nation union select distinct concat('n', s_nationkey), concat('s', s_suppkey % 20) from supplier)"


def _tree(s, d):
    name = lambda k, c: F.concat(F.lit(k), c)
    one = read(s, d, "nation").select(name("r", F.col("n_regionkey")).alias("src"), name("n", F.col("n_nationkey")).alias("dst"))
    return one.unionByName(read(s, d, "supplier").select(name("n", F.col("s_nationkey")).alias("src"), name("s", F.col("s_suppkey") % 20).alias("dst"))).distinct()


register("mutex_edges_closure", lambda s, d: graph.exclusive_pairs(_tree(s, d), graph.reachable(_tree(s, d), None)), TREE + ", closure as (select src, dst from e union select a.src, b.dst from e a join e b on a.dst = b.src) ==== select a.src as src1, a.dst as dst1, b.src as src2, b.dst as dst2 from e a join e b on (a.src, a.dst) < (b.src, b.dst) and a.dst <> b.src and b.dst <> a.src where not exists (select 1 from closure c where c.src = a.dst and c.dst = b.src) and not exists (select 1 from closure c where c.src = b.dst and c.dst = a.src)", "src1 dst1 src2 dst2")
COUNTS = S + ", k as (select node, max(size) as size, count(*) filter (path_id % 3 = 0) as c1, count(*) filter (path_id % 3 = 1 and class <> 'c1') as c2, count(*) filter (class = 'ref') as ref from steps group by 1), cls as (select *, case when c1 > 3*c2 then 'c1' when c2 > 3*c1 then 'c2' when ref > 0 and c1 = 0 and c2 = 0 then 'ref' else 'none' end as class from k)"


def _classified(s, d):
    c = steps(s, d)
    return graph.classify(c.groupBy("node").agg(F.max("size").alias("size"), F.count_if(F.col("path_id") % 3 == 0).alias("c1"), F.count_if((F.col("path_id") % 3 == 1) & (F.col("class") != "c1")).alias("c2"), F.count_if(F.col("class") == "ref").alias("ref")))


register("node_class", _classified, COUNTS + "==== select * from cls", "node size:i c1:i c2:i ref:i class")
register("class_summary", lambda s, d: graph.class_summary(_classified(s, d)), COUNTS + "==== select class, count(*) as n, avg(size) as mean_size, sum(size) as bp from cls group by 1", "class n:i mean_size:f bp:i")

TEXT = "t as (select l_orderkey as id, concat(cast(l_quantity as int), '=', l_linenumber, 'X', cast(l_quantity as int) % 5 + 1, 'I', l_partkey % 90 + 1, 'D') as cigar, concat('>', l_partkey, '<', l_suppkey, case when l_linenumber > 3 then '<7' else '>9' end) as p from lineitem)"


def _texts(s, d):
    q = F.col("l_quantity").cast("int")
    path = F.concat(F.lit(">"), F.col("l_partkey"), F.lit("<"), F.col("l_suppkey"), F.when(F.col("l_linenumber") > 3, "<7").otherwise(">9"))
    cigar = F.concat(q, F.lit("="), F.col("l_linenumber"), F.lit("X"), q % 5 + 1, F.lit("I"), F.col("l_partkey") % 90 + 1, F.lit("D"))
    return read(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), cigar.alias("cigar"), path.alias("p"))


register("cigar_parse", lambda s, d: _texts(s, d).select(F.explode(fn.parse_cigar(F.col("cigar"))).alias("o")).groupBy("o.op").agg(F.sum("o.n").alias("bases"), F.count(F.lit(1)).alias("n")), TEXT + ", o as (select unnest(regexp_extract_all(cigar, '([0-9]+)([A-Z=])', 1)) as n, unnest(regexp_extract_all(cigar, '([0-9]+)([A-Z=])', 2)) as op from t) ==== select op, sum(n::bigint) as bases, count(*) as n from o group by 1", "op bases:i n:i")
register("path_parse", lambda s, d: _texts(s, d).select(fn.mostly_reverse(F.col("p")).alias("flip"), F.explode(fn.parse_path(F.col("p"))).alias("s")).groupBy("flip", "s.strand", "s.node").agg(F.count(F.lit(1)).alias("n")), TEXT + ", o as (select length(p) - length(replace(p, '<', '')) > length(p) - length(replace(p, '>', '')) as flip, unnest(regexp_extract_all(p, '([<>])([^<>]+)', 1)) as strand, unnest(regexp_extract_all(p, '([<>])([^<>]+)', 2)) as node from t) ==== select flip, strand, node, count(*) as n from o group by 1, 2, 3", "flip strand node n:i")
register("revcomp", lambda s, d: read(s, d, "part").select("p_partkey", fn.reverse_complement(F.translate(F.upper("p_name"), "BDEFHIJKLMOPQRSUVWXYZ", "ACGTACGTACGTACGTACGTA")).alias("seq"), fn.preview(F.col("p_name")).alias("short")), "====select p_partkey, translate(reverse(translate(upper(p_name), 'BDEFHIJKLMOPQRSUVWXYZ', 'ACGTACGTACGTACGTACGTA')), 'ACGTN', 'TGCAN') as seq, case when length(p_name) < 10 then p_name else concat(substring(p_name, 1, 10), '+') end as short from part", "p_partkey:i seq short")

locus_queries.add(register)
haplotype_queries.add(register)
