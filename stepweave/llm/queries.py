"""The opN_ queries: thin callers of the operators with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm import chunkstore, decontaminate, embeddings, jaccard, licenses, packing, quality, substrings, tokens, toxicity, urls, whitening
from stepweave.llm.common import read


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op4_chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkstore.store_round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"), k=4, percent=85)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.without_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents"))


URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(read(spark, sf_dir, "pages"), URL_RULES)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


_ALL = (op1_decontamination, op2_packing, op3_embedding_dedup, op4_chunk_store, op5_jaccard_join, op6_token_counts, op7_suffix_dedup, op8_quality, op9_toxicity, op10_licenses, op11_url_filter, op12_whitening)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_COMPONENTS = """pairs_ as (select x as a, y as b from links union select y, x from links),
  reach as (select a, b from pairs_ union select r.a, l.b from reach r join pairs_ l on l.a = r.b),
  least as (select a, min(b) as low from reach group by 1)"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# DuckDB's answer by comparison of all pairs, all shingles and all strings: right at any size, in reasonable time on small tables.
ORACLE_SQL: dict[str, str] = {
    "op3_embedding_dedup": f"""with recursive v as (select vec_id, [x::double for x in embedding] as e from embeddings),
  ok as (select * from v where e is not null and len(e) > 0 and list_count(e) = len(e) and len([x for x in e if not isfinite(x)]) = 0 and len([x for x in e if x <> 0]) > 0),
  links as (select a.vec_id as x, b.vec_id as y from ok a join ok b on a.vec_id < b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.9),
  {_COMPONENTS}
select v.vec_id, (select count(*) from pairs_ where a = v.vec_id)::bigint as n_links, coalesce(least(low, v.vec_id), v.vec_id) as component_id, coalesce(least(low, v.vec_id), v.vec_id) = v.vec_id as kept from v left join least on a = v.vec_id""",
    "op5_jaccard_join": f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
  s as (select distinct doc_id, unnest(case when len(w) >= 4 then [array_to_string(w[i : i + 3], ' ') for i in range(1, len(w) - 2)] when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
  n as (select doc_id, count(*) as n from s group by 1),
  p as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
  links as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * k >= 85 * (a.n + b.n - k)),
  {_COMPONENTS}
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(least(low, w.doc_id), w.doc_id) as component_id from w left join n using (doc_id) left join least on a = w.doc_id""",
    "op7_suffix_dedup": """with d as (select doc_id, lower(hex(encode(coalesce(text, '')))) as h from documents),
  c as (select doc_id, len(h) // 2 - 99 as n, h, unnest(range(0, len(h) // 2 - 99, 100)) as b from d where len(h) >= 200),
  p as (select doc_id, b, substring(h, 2 * b + 1, 400) as h, unnest(range(0, least(100, n - b))) as j from c),
  x as (select doc_id, b + j as i, substring(h, 2 * j + 1, 200) as x from p),
  m as (select x, min(doc_id * 1000000000 + i) as first from x group by 1 having count(*) > 1),
  q as (select doc_id, i, doc_id * 1000000000 + i > first as again from x join m using (x)),
  g as (select doc_id, i, coalesce(i > lag(i) over (partition by doc_id order by i) + 100, true) as new from q where again),
  k as (select doc_id, i, sum(new::int) over (partition by doc_id order by i) as span from g),
  r as (select doc_id, span, min(i) as s, max(i) + 100 as e from k group by 1, 2),
  f as (select doc_id, s, e, coalesce(lag(e) over (partition by doc_id order by s), 0) as before from r),
  t as (select f.doc_id, string_agg(substring(h, 2 * before + 1, 2 * (s - before)), '' order by s) as head, max(e) as last, sum(e - s) as removed, count(*) as spans from f join d using (doc_id) group by 1)
select d.doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans, sha256(unhex(case when t.doc_id is null then h else concat(head, substring(h, 2 * last + 1)) end)) as kept_sha256 from d left join t using (doc_id)""",
    "op11_url_filter": f"""with recursive cut as (select page_id, coalesce(html, '') as html, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
  p as (select page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
  rules(rule, verdict) as (values {", ".join(str(r) for r in URL_RULES)}),
  judged as (select page_id, host, path, html, (select arg_max(rule, len(rule)) from rules where (host = split_part(rule, '/', 1) or ends_with(host, '.' || split_part(rule, '/', 1))) and starts_with(path, substr(rule, instr(rule, '/')))) as rule from p),
  pages_ as (select judged.*, verdict from judged left join rules using (rule)),
  links as (select host as src, translate(unnest(regexp_extract_all(html, '{urls.LINK.replace("'", "''")}', 1)), '{_UPPER}', '{_LOWER}') as dst from p),
  counted as (select src, dst, count(*)::bigint as w from links where src <> '' and src <> dst group by 1, 2),
  hosts as (select host from p union select dst from counted),
  up as (select host, substr(host, instr(host, '.') + 1) as domain from hosts where instr(host, '.') > 0 and instr(substr(host, instr(host, '.') + 1), '.') > 1 and not regexp_matches(host, '^[0-9.:]*$')),
  edges as (select src, dst, sum(w)::bigint as w from (select * from counted union all select host, domain, 1 from up union all select domain, host, 1 from up) group by 1, 2),
  ways as (select 'allow' as kind, src, dst, w from edges union all select 'block', dst, src, w from edges),
  outs as (select kind, src, sum(w)::bigint as total from ways group by 1, 2),
  walk as (select 0 as k, kind, host, mass from (select verdict_ as kind, host, {urls.UNIT}::bigint * count(*) filter (verdict = verdict_) // count(*) as mass from pages_, (values ('allow'), ('block')) as t(verdict_) where host <> '' group by 1, 2) where mass > 0
    union all select k + 1, kind, host, mass from (select k, w.kind, e.dst as host, sum(mass // 100 * {urls.KEPT} // total * e.w)::bigint as mass from walk w join outs o on o.kind = w.kind and o.src = w.host join ways e on e.kind = w.kind and e.src = w.host where mass // 100 * {urls.KEPT} // total > 0 group by 1, 2, 3) where k < {urls.ROUNDS}),
  scores as (select host, sum(mass) filter (kind = 'allow') as trust, sum(mass) filter (kind = 'block') as distrust from walk group by 1),
  blocked as (select host from scores where distrust >= {urls.LEAST} and distrust > coalesce(trust, 0))
select page_id, host, path, rule, coalesce(verdict, case when host in (select host from blocked) then 'block' else 'allow' end) as verdict from pages_""",
}
