"""URL filters: rules by host and path, and for urls without a rule trust and distrust that spread over links between hosts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import discard, materialize

UNIT = 10**9  # what a host hands out at first if all its pages are under rules of one kind; masses are whole numbers, so sums have no order
KEPT = 85  # percent that a host passes on, the damping of the walk
ROUNDS = 24  # 0.85 ** 24: two percent of a seed's mass are still on their way then
LEAST = UNIT // 10  # distrust from which a host is blocked, if it exceeds the host's trust
HUB, HUBS = 100_000, 1_000  # a host with more links than HUB, and than one part in HUBS of all, is dealt out in parts: at most HUBS hosts
HOT = 256  # hosts with more than one page in HOT: at most HOT

LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\s"'<>]+)"""


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path of a url column; both empty for null and where no :// stands."""
    rest = F.expr(f"if(instr(`{url}`, '://') > 0, substring(`{url}`, instr(`{url}`, '://') + 3), '')")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict), else null. rules: (host and path in one, allow or block)."""
    longest = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    parts = [F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit(r.partition("/")[0]).alias("host"), F.lit(r[r.index("/") :]).alias("path")) for r, v in longest]
    fits = F.filter(F.array(*parts), lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    return F.get(fits, 0)


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, w: links from pages of host src (columns host, html) to another host, and between a host and the domain one level up.

    Relative links stay on their host and are no edges. Counts are made before rows are dealt out, so that a popular
    host costs as many rows as hosts link to it. A domain counts from two labels on; numeric addresses have none.
    """
    targets = F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lower_ascii)
    links = pages.select(F.col("host").alias("src"), F.explode(targets).alias("dst")).filter("src <> '' and src <> dst")
    links, path = materialize(links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")), "links")
    hosts = pages.select("host").distinct().unionByName(links.select(F.col("dst").alias("host"))).distinct()
    up = F.expr("substring(host, instr(host, '.') + 1)")
    up = hosts.select("host", up.alias("domain")).filter("instr(host, '.') > 0 and instr(domain, '.') > 1 and not host rlike '^[0-9.:]*$'")
    both = up.select(F.col("host").alias("src"), F.col("domain").alias("dst"), F.lit(1).cast("long").alias("w"))
    both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    edges, _ = materialize(links.unionByName(both).groupBy("src", "dst").agg(F.sum("w").alias("w")), "edges")
    discard(pages.sparkSession, path)
    return edges


def spread(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """kind, host, mass: what seeds (kind, host, mass) hand out along edges (kind, src, dst, w), summed over all rounds, the seeds included.

    A personalised PageRank as its power series: each round a host passes KEPT percent of what came in last round to its
    links, by weight, in whole numbers (what division leaves over is lost). Each round is a table in the shared folder,
    and the walk ends early when nothing is left. Links of a hub are dealt out in parts.
    """
    spark = edges.sparkSession
    out = edges.groupBy("kind", "src").agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("links"))
    out, out_path = materialize(out, "out")
    most = max(HUB, (out.agg(F.sum("links")).first()[0] or 0) // HUBS)
    hubs = F.broadcast(out.filter(F.col("links") > most).select("kind", "src", (F.col("links") / most + 1).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("dst"), F.coalesce("parts", F.lit(1)))
    parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    dealt, dealt_path = materialize(edges.join(hubs, ["kind", "src"], "left").select("kind", "src", "dst", "w", part.cast("int").alias("part")), "dealt")

    given, path = materialize(seeds.filter("mass > 0").select("kind", "host", "mass"), "mass")
    tables, paths = [given], [path, out_path, dealt_path]
    for _ in range(rounds):
        sent = given.withColumnRenamed("host", "src").join(out.select("kind", "src", "total"), ["kind", "src"])
        sent = sent.select("kind", "src", F.expr(f"mass div 100 * {KEPT} div total").alias("each")).filter("each > 0")
        sent = sent.join(hubs, ["kind", "src"], "left").select("kind", "src", "each", parts.alias("part"))
        came = dealt.join(sent, ["kind", "src", "part"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("each") * F.col("w")).alias("mass"))
        given, path = materialize(came, "mass")
        if given.isEmpty():
            discard(spark, path)
            break
        tables.append(given)
        paths.append(path)
    total, _ = materialize(reduce(DataFrame.unionByName, tables).groupBy("kind", "host").agg(F.sum("mass").alias("mass")), "reached")
    for p in paths:
        discard(spark, p)
    return total


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], rounds: int = ROUNDS) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) of every row of pages (page_id, url, html).

    The longest rule that fits a url decides. Else its host does: hosts start with trust and distrust by the share of
    their pages that rules allow and block; trust follows links between hosts, distrust runs against them, as a host
    that links to a blocked one is suspect. A host is blocked whose distrust reaches LEAST and exceeds its trust.

    rules is a policy list of the caller, tried in full for each url. Null urls, and those without ://, have no host and
    are allowed, as nothing is known of them; a null html has no links. Repeated rows are rows of their own, other
    columns are left out, no pages give no rows.
    """
    host, path = host_and_path("url")
    pages = pages.select("page_id", host.alias("host"), path.alias("path"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    judged = pages.withColumn("by", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "html", F.col("by.rule").alias("rule"), F.col("by.verdict").alias("verdict"))

    counts = judged.filter("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "allow").alias("n_allow"), F.count_if(F.col("verdict") == "block").alias("n_block"))
    counts, _ = materialize(counts, "hosts")
    seeds = counts.select("host", "n", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"n_{k}").alias("ruled")) for k in ("allow", "block")))).alias("s"))
    seeds = seeds.select("s.kind", "host", F.expr(f"{UNIT} * s.ruled div n").alias("mass"))

    links = host_links(pages)
    along = links.select(F.lit("allow").alias("kind"), "src", "dst", "w")
    against = links.select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    reached = spread(along.unionByName(against), seeds, rounds)
    mass = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0))
    blocked = reached.groupBy("host").agg(mass("allow").alias("trust"), mass("block").alias("distrust")).filter(f"distrust >= {LEAST} and distrust > trust").select("host")
    blocked, _ = materialize(blocked.join(counts, "host").select("host", "n"), "blocked")

    most = (counts.agg(F.sum("n")).first()[0] or 0) // HOT
    hot = F.broadcast(blocked.filter(F.col("n") > most).select("host", F.lit(True).alias("hot")))  # at most HOT hosts
    rest = blocked.filter(F.col("n") <= most).select(F.col("host").alias("key"), F.lit(True).alias("cold"))
    found = judged.drop("html").join(hot, "host", "left")
    settled = F.col("rule").isNotNull() | F.col("hot").isNotNull() | (F.col("host") == "")
    key = F.when(settled, F.concat(F.lit("/"), F.pmod(F.xxhash64("page_id", "path"), F.lit(4096)).cast("string"))).otherwise(F.col("host"))  # no host holds a slash
    found = found.withColumn("key", key).join(rest, "key", "left")
    other = F.when(F.col("hot").isNotNull() | F.col("cold").isNotNull(), "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("verdict", other).alias("verdict"))
