"""The jobs as registered queries: each runs twice into one new folder, and its result is what stands there after the second run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import module_report, turn_support
from jobs.common import new_folder
from stepweave.plans.queries import SUBS


def job1_module_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "job1")
    for _ in range(2):
        table = module_report.run(spark, f"{sf_dir}/events.parquet", out, **module_report.SETTINGS)
    return table


def job2_turn_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "job2")
    for _ in range(2):
        table = turn_support.run(spark, f"{sf_dir}/conversations.parquet", out, **turn_support.SETTINGS)
    return table.withColumn("share", F.round("share", 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_module_report, job2_turn_support)}

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

ORACLE_SQL: dict[str, str] = {
    "job1_module_report": f"""with {SUBS},
  kept as (select path_id from subs group by 1 having max(sub) > 0 or min(grp) filter (sub = 0) = 'module'),
  pieces as (select path_id, sub, grp as part, min(pos) as first_pos, count(*) as n_steps, sum(size)::bigint as bp, count(*) filter (class = 'c1') as c1, count(*) filter (class = 'c2') as c2 from subs where path_id in (select path_id from kept) group by 1, 2, 3)
select *, case when part <> 'module' then part when c1 + c2 < 5 then 'unsure' when c1 >= 0.8 * (c1 + c2) then 'c1' when c2 >= 0.8 * (c1 + c2) then 'c2' else 'mixed' end as call from pieces""",
    "job2_turn_support": f"""with steps as (select distinct conv_id, turn, concat(coalesce(role, 'none'), '_', case when {_WORDS} < 8 then 'short' when {_WORDS} < 64 then 'middle' else 'long' end) as node from conversations where conv_id is not null and turn is not null),
  n as (select a.node as src, b.node as dst, count(*) as n from steps a join steps b on b.conv_id = a.conv_id and b.turn = a.turn + 1 group by 1, 2)
select src, dst, n, round(n / sum(n) over (partition by src), 6) as share, row_number() over (partition by src order by n desc, dst) = 1 as best, split_part(src, '_', 1) as kind from n""",
}
