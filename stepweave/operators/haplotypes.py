"""From subreads to diplotypes: profiles, clusters, consensus walks, module adjacency, and reads aligned to haplotypes.

Profiles, consensus and alignments are per subread, cluster or read, and run in parallel; clusters are found in rounds of joins over all
samples and parameter sets at once (clustering.py).
"""

from __future__ import annotations

from itertools import product

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepweave.operators.clustering import communities, em
from stepweave.operators.diplotype import composite_rank, pair_likelihood, pair_metrics, similarity
from stepweave.operators.graph import _settled, small
from stepweave.operators.order import longest, running
from stepweave.operators.paths import by_path
from stepweave.operators.threading import best_pairs

GAP = 10  # positions of a haplotype that a chain may skip
# The ranges of the presets (first, last, step); `default` with one method alone gives em and kcomms.
_DEFAULT = {"methods": ("kcomms", "em"), "read_support": (2, 4, 1), "read_len": (0, 10000, 2000), "modules": (2, 8, 1), "marker_support": (0.1, 0.9, 0.4)}
PRESETS = {
    "fast": {"methods": ("kcomms",), "read_support": (3, 3, 1), "read_len": (0, 10000, 5000), "modules": (2, 6, 1), "marker_support": (0.2, 0.9, 0.7)},
    "default": _DEFAULT,
    "em": _DEFAULT | {"methods": ("em",)},
    "kcomms": _DEFAULT | {"methods": ("kcomms",)},
}


def _steps(first: float, last: float, step: float) -> list:
    """first, first + step, ... up to last; the sums of fractions are rounded to one place."""
    return [round(first + k * step, 1) if isinstance(step, float) else first + k * step for k in range(int((last - first) / step + 1e-9) + 1)]


def sweep(preset: str) -> list[dict]:
    """Parameter sets of a preset, each with a name such as 3m_rl0_rs3_ms0.5; the network method (kcomms) has one for each marker quantile."""
    if preset not in PRESETS:
        raise ValueError(f"no preset {preset}; there are {', '.join(PRESETS)}")
    p, out = PRESETS[preset], []
    for rl, rs, n, method in product(*(_steps(*p[k]) for k in ("read_len", "read_support", "modules")), p["methods"]):
        for ms in _steps(*p["marker_support"]) if method == "kcomms" else [None]:
            name = f"{n}m_rl{rl}_rs{rs}" + ("" if ms is None else f"_ms{ms}")
            out.append({"name": name, "read_len": rl, "read_support": rs, "modules": n, "method": method, "marker_support": ms})
    return out


def observations(subreads: DataFrame, least: int | str = 3, by: list[str] | None = None) -> DataFrame:
    """by, id, marker, allele: what follows each marker node in a subread (by, id, pos, node, class). A later visit counts.

    Markers have two alleles of `least` subreads or more within their group; least is a number, or a column that holds it for each group.
    """
    by = by or []
    enough = F.col(least) if isinstance(least, str) else F.lit(least)
    rows = subreads.withColumn("allele", F.lead("node").over(Window.partitionBy(*by, "id").orderBy("pos"))).filter("class = 'none' and allele is not null")
    counts = rows.groupBy(*by, F.col("node").alias("marker"), "allele").agg(F.count(F.lit(1)).alias("n"), F.max(enough).alias("enough"))
    kept = counts.filter("n >= enough").groupBy(*by, "marker").count().filter("count >= 2").select(*by, "marker")
    seen = rows.withColumnRenamed("node", "marker").join(kept, [*by, "marker"], "left_semi")
    return seen.groupBy(*by, "id", "marker").agg(F.max_by("allele", "pos").alias("allele"))


def exclusive_observations(steps: DataFrame, exclusive: DataFrame) -> DataFrame:
    """id, marker (an edge), allele (the edge that is taken): each edge of a path stands for itself and for the edges that exclude it; a later one counts.

    exclusive: src1, dst1, src2, dst2, a row for each pair of edges that no walk passes both of.
    """
    two = exclusive.unionByName(exclusive.select(F.col("src2").alias("src1"), F.col("dst2").alias("dst1"), F.col("src1").alias("src2"), F.col("dst1").alias("dst2")))
    name = lambda a, b: F.concat_ws("_", a, b)
    own = steps.select("path_id", "pos", F.col("node").alias("src1"), F.lead("node").over(by_path()).alias("dst1")).filter("dst1 is not null")
    taken = own.join(two, ["src1", "dst1"]).select("path_id", "pos", name("src1", "dst1").alias("allele"), F.explode(F.array(name("src1", "dst1"), name("src2", "dst2"))).alias("marker"))
    return taken.groupBy(F.col("path_id").alias("id"), "marker").agg(F.max_by("allele", "pos").alias("allele"))


def cluster_by_em(observed: DataFrame, states: int | str, by: list[str] | None = None) -> DataFrame:
    """id, cluster, confidence of observations (id, marker, allele), for each value of the columns in `by` (sample, parameter set); see clustering.em."""
    return em(observed, states, by)


def network(observed: DataFrame, clusters: int | str, quantile: float | str = 0.5, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Similarities (by, a, b, common, same, sim; a < b) and directed weights (by, a, b, weight) of subreads, adjusted by rank.

    Pairs need as many common markers as that quantile of all pairs has. A neighbour's weight is 0 from the rank on that is the number
    of neighbours over the number of clusters. clusters and quantile are numbers, or columns that hold them for each group.
    """
    by = by or []
    known = [c for c in (clusters, quantile) if isinstance(c, str)]
    pairs = _settled(similarity(observed, by))
    settings = observed.select(*by, *(c for c in known if c not in by)).distinct() if known else None
    value = lambda c: F.col(c).cast("double") if isinstance(c, str) else F.lit(float(c))
    counts = pairs.groupBy(*by, "common").agg(F.count(F.lit(1)).alias("k"))
    whole = Window.partitionBy(*by)  # numbers of markers of one locus, counted
    counts = counts.withColumn("run", F.sum("k").over(whole.orderBy("common"))).withColumn("all", F.sum("k").over(whole))
    counts = counts.join(settings, by) if settings is not None else counts
    enough = counts.filter(F.col("run") > F.floor(F.col("all") * value(quantile))).groupBy(*by).agg(F.min("common").alias("enough"))
    counted = (pairs.join(enough, by) if by else pairs.crossJoin(F.broadcast(enough))).filter("common >= enough")  # one row
    both = counted.select(*by, "a", "b", "sim").unionByName(counted.select(*by, F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    near = Window.partitionBy(*by, "a")
    both = both.withColumn("rk", F.count(F.lit(1)).over(near.orderBy(F.desc("sim")).rangeBetween(Window.unboundedPreceding, 0))).withColumn("m", F.count(F.lit(1)).over(near))
    both = both.join(settings, by) if settings is not None else both
    limit = F.col("m") / value(clusters)
    return pairs, both.select(*by, "a", "b", F.when(F.col("rk") < limit, F.col("sim") * (1 - F.col("rk") / limit)).otherwise(0.0).alias("weight"))


def cluster_by_network(observed: DataFrame, clusters: int | str, quantile: float | str = 0.5, least: float = 0.01, by: list[str] | None = None) -> DataFrame:
    """id, cluster, confidence: communities of the network of adjusted similarities over `least`, for each value of the columns in `by`.

    An edge has the weight of its later end's direction, if that is enough, else the other one's. Clusters are numbered by their least
    subread. A subread without an edge joins its most similar one's cluster, and cluster 0 with confidence 0 if none is similar.
    """
    by = by or []
    observed = _settled(observed.withColumn("id", F.col("id").cast("string")))
    pairs, weights = network(observed, clusters, quantile, by)
    strong = weights.filter(F.col("weight") > least)
    edges = strong.select(*by, F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), (F.col("a") > F.col("b")).alias("later"), "weight")
    edges = edges.groupBy(*by, F.col("x").alias("a"), F.col("y").alias("b")).agg(F.max_by("weight", "later").alias("weight"))
    of = communities(edges, by).withColumnRenamed("node", "id")
    number = F.dense_rank().over(Window.partitionBy(*by).orderBy("community")) - 1  # over the subreads of one group
    of = _settled(of.select(*by, "id", number.alias("cluster")))
    both = pairs.select(*by, F.col("a").alias("id"), "b", "sim").unionByName(pairs.select(*by, F.col("b").alias("id"), F.col("a").alias("b"), "sim"))
    like = both.join(of.select(*by, F.col("id").alias("b"), F.col("cluster").alias("near")), [*by, "b"])
    like = like.groupBy(*by, "id").agg(F.max_by("near", F.struct("sim", "b")).alias("near"))
    rows = observed.select(*by, "id").distinct().join(of, [*by, "id"], "left").join(like, [*by, "id"], "left")
    return rows.select(*by, "id", F.coalesce("cluster", "near", F.lit(0)).cast("int").alias("cluster"), F.when(F.coalesce("cluster", "near").isNull(), 0.0).otherwise(1.0).alias("confidence"))


def adjacency(subreads: DataFrame, by: list[str] | None = None) -> DataFrame:
    """run, n: runs of neighbouring subreads with a cluster and confidence over 0, of two or more, and how many reads have each.

    subreads: path_id, sub, cluster (text), confidence; others cut a run. For each value of the columns in `by`.
    """
    by = by or []
    sure = F.col("cluster").isNotNull() & (F.col("confidence") > 0)
    w = Window.partitionBy(*by, "path_id").orderBy("sub")
    cut = F.sum((~sure).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = subreads.withColumn("cut", cut).filter(sure).groupBy(*by, "path_id", "cut").agg(F.array_sort(F.collect_list(F.struct("sub", "cluster"))).alias("r"))
    runs = runs.select(*by, F.transform("r", lambda x: x["cluster"]).alias("run")).filter("size(run) > 1")
    return runs.groupBy(*by, "run").agg(F.count(F.lit(1)).alias("n"))


def best_diplotype(runs: DataFrame, clusters: list[str], buffer: bool = True) -> DataFrame:
    """hap1, hap2, score of the pair of haplotypes that holds most runs; see threading.best_pairs."""
    return best_pairs(runs, runs.sparkSession.createDataFrame([(c,) for c in clusters], "cluster string"), None, buffer)


def chains(path: list, read: list, gap: int = GAP) -> list[list[int]]:
    """Chains of places on a path: each seed, in the read's order, goes on all chains that end less than `gap` places away, or begins one."""
    places: dict = {}
    for k, n in enumerate(path):
        places.setdefault(n, []).append(k)
    out: list[list[int]] = []
    for n in read:
        for p in places.get(n, ()):
            near = [c for c in out if abs(p - c[-1]) < gap]
            for c in near:
                c.append(p)
            if not near:
                out.append([p])
    return out


def chain_score(path: list, read: list, heavy: set, gap: int = GAP) -> float:
    """The best chain's weight over the read's: 10 for a node in `heavy`, 1 for others; rounded to three places, 0 for an empty read.

    Chains that end at the same place go on alike, so only the best weight of each place is kept, and a seed takes those less than `gap` places away.
    """
    places: dict = {}
    for k, n in enumerate(path):
        places.setdefault(n, []).append(k)
    ends, whole = [0] * (len(path) + gap), 0
    best, taken = 0, [0] * (2 * gap - 1)
    for n in read:
        w = 10 if n in heavy else 1
        whole += w
        for p in places.get(n, ()):
            low, high = max(p - gap + 1, 0), p + gap
            weight = max(ends[low:high], default=0) + w
            ends[low:high] = taken[: high - low]
            ends[p] = weight
            if weight > best:
                best = weight
    return round(best / whole, 3) if whole else 0.0


def track(path: list, read: list, gap: int = GAP) -> tuple[int, list[tuple[float, str]], dict[int, int]]:
    """Length of the longest chain, its places on the path with what lies between (mismatch, halfway), and the read's steps' places.

    A read's node that is not the chain's next place is an edit; edits before a match make one mismatch.
    """
    found = chains(path, read, gap)
    best = max(found, key=len) if found else []
    at, places, edits, k = [], {}, 0, 0
    for i, n in enumerate(read):
        if k >= len(best) or path[best[k]] != n:
            edits += 1
            continue
        if edits:
            at.append(((at[-1][0] + best[k]) / 2 if at else best[k] - 1.0, "mismatch"))
            edits = 0
        at.append((float(best[k]), "match"))
        places[i] = best[k]
        k += 1
    return len(best), at, places


def _read_lists(steps: DataFrame) -> DataFrame:
    rows = steps.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("r"))
    return rows.select(F.col("path_id").alias("read"), F.transform("r", lambda x: x["node"]).alias("nodes"))


def alignment_scores(steps: DataFrame, haplotypes: dict[str, list], heavy: set, gap: int = GAP) -> DataFrame:
    """hap, read, length, score of each read on each haplotype; haplotypes are candidates, few by design, and go to every task."""
    reads = _read_lists(steps)
    kind = reads.schema["read"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            out = [(h, r, len(n), chain_score(p, list(n), heavy, gap)) for r, n in zip(pdf["read"], pdf["nodes"]) for h, p in haplotypes.items()]
            yield pd.DataFrame(out, columns=["hap", "read", "length", "score"])

    return reads.mapInPandas(run, f"hap string, read {kind}, length int, score double")


def pair_alignment(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """hap1, hap2, aln_score, aln_long_prop of pairs (hap1, hap2): the mean over reads of the better score, and the share of long reads that align well.

    Long reads are the longest tenth, rounded up (ties by name), but the share is of the tenth as it is; a read aligns well with a
    score over the mean by 0.8 of the greatest one's distance to it. Scores are gathered by read once; pairs are made of a read's own scores, without a join.
    """
    reads = scores.groupBy("read").agg(F.max("length").alias("length"), F.collect_list(F.struct("hap", "score")).alias("on"))
    reads = _settled(reads)
    n = reads.count()
    long_ = longest(reads, -(-n // 10), [F.desc("length"), "read"])
    wanted = small(pairs.select("hap1", "hap2").distinct())

    def better(of: DataFrame) -> DataFrame:
        one = of.select(F.col("on").alias("all"), F.explode("on").alias("x"))
        both = one.select(F.col("x.hap").alias("hap1"), F.col("x.score").alias("s1"), F.explode("all").alias("y"))
        return both.select("hap1", F.col("y.hap").alias("hap2"), F.greatest("s1", "y.score").alias("s")).join(wanted, ["hap1", "hap2"])

    mean = _settled(better(reads).groupBy("hap1", "hap2").agg(F.avg("s").alias("aln_score"), F.max("s").alias("most")))
    well = better(long_).join(small(mean), ["hap1", "hap2"]).groupBy("hap1", "hap2").agg(F.count_if(F.col("s") > F.col("aln_score") + 0.8 * (F.col("most") - F.col("aln_score"))).alias("w"))
    return mean.join(well, ["hap1", "hap2"], "left").select("hap1", "hap2", "aln_score", (F.coalesce("w", F.lit(0)) / F.lit(max(n, 1) / 10)).alias("aln_long_prop"))


def evaluate_pairs(steps: DataFrame, hap_steps: DataFrame, scores: DataFrame, small: int = 5, pairs: DataFrame | None = None) -> DataFrame:
    """The nine columns of a stats table, best first: metrics of coverage, likelihood and alignment of pairs of haplotypes, and their rank.

    steps: node, size; hap_steps: hap, node, size; pairs: hap1 <= hap2, all of them if there is none. Correlation and deviation take nodes of a size under `small`. rank adds the means of the
    adjusted coverage metrics and of the adjusted alignment metrics.
    """
    cover = lambda t, *by: _settled(t.groupBy(*by, "node").agg(F.count(F.lit(1)).alias("n")))
    reads, haps, few = cover(steps), cover(hap_steps, "hap"), F.col("size") < small
    m = pair_metrics(reads, haps).select("hap1", "hap2", "cov_cosine").join(pair_likelihood(reads, haps), ["hap1", "hap2"])
    m = m.join(pair_metrics(cover(steps.filter(few)), cover(hap_steps.filter(few), "hap")).select("hap1", "hap2", "cov_cor", "cov_dev"), ["hap1", "hap2"], "left")
    m = m if pairs is None else m.join(pairs.select("hap1", "hap2").distinct(), ["hap1", "hap2"], "left_semi")
    m = _settled(m)  # it is read several times from here on
    m = _settled(m.join(pair_alignment(scores, m.select("hap1", "hap2")), ["hap1", "hap2"]))
    ranked = composite_rank(m, ["cov_cor", "aln_score", "aln_long_prop"], ["cov_dev"]).withColumn("rank", 2 * F.col("rank"))
    return ranked.select("hap1", "hap2", "cov_cor", "cov_dev", "cov_cosine", "hap_ll", "aln_score", "rank", "aln_long_prop").orderBy("rank", "hap1", "hap2")


def competition_rank(scores: DataFrame, groups: list[list[str]]) -> DataFrame:
    """rank: the sum over groups of metrics of the mean place, greatest value first, from 0; equal values share their first place.

    Places come from counts of distinct values, summed over the whole table without a one-task window.
    """
    out = scores
    for m in [m for g in groups for m in g]:
        counts = scores.groupBy(m).agg(F.count(F.lit(1)).alias("_k"))
        out = out.join(running(counts, [F.desc(m)], "_k").select(m, (F.col("run") - F.col("_k")).alias(f"_{m}")), m)
    rank = sum((F.col(f"_{m}") / len(g) for g in groups for m in g), F.lit(0.0))
    return out.withColumn("rank", rank).drop(*(f"_{m}" for g in groups for m in g))


def read_diplotype(stats: DataFrame, info: DataFrame) -> DataFrame:
    """hap, path: node lists of the two haplotypes of the best-ranked row of stats (one, if both are the same); info: hap, node, ppos."""
    best = stats.orderBy("rank", "hap1", "hap2").limit(1).select(F.explode(F.array("hap1", "hap2")).alias("hap")).distinct()
    rows = info.join(best, "hap", "left_semi").groupBy("hap").agg(F.array_sort(F.collect_list(F.struct("ppos", "node"))).alias("r"))
    return rows.select("hap", F.transform("r", lambda x: x["node"]).alias("path"))


def haplotype_labels(path: list, groups: dict, right) -> list[str]:
    """Label of each step of a haplotype: the module's number, which grows at each `right` end, or the group's name; unlabelled nodes keep the last group."""
    out, module, group = [], 1, "flankl"
    for n in path:
        group = groups.get(n, group)
        module += n == right
        out.append(str(module) if group == "module" else group)
    return out


def assign_subreads(steps: DataFrame, subreads: DataFrame, haplotypes: dict[str, list], groups: dict, right, gap: int = GAP) -> DataFrame:
    """sread, read, start, end, haplotype, module of module subreads: the haplotype of the read's longer chain, and the label that most of its mapped steps have.

    steps: path_id, pos, node; subreads: path_id, pos, sub, group, read_pos. Equal chains are dealt by a hash of the read's name; equal labels go to the one
    that stands first. Subreads without a mapped step have no module.
    """
    labels = {h: haplotype_labels(p, groups, right) for h, p in haplotypes.items()}
    reads = _read_lists(steps).withColumn("side", F.pmod(F.xxhash64("read"), F.lit(max(len(haplotypes), 1))))
    kind = reads.schema["read"].dataType.simpleString()

    def run(batches):
        names = list(haplotypes)
        for pdf in batches:
            out = []
            for r, nodes, side in zip(pdf["read"], pdf["nodes"], pdf["side"]):
                found = [track(haplotypes[h], list(nodes), gap) for h in names]
                most = max(f[0] for f in found)
                even = [k for k, f in enumerate(found) if f[0] == most]
                k = even[side % len(even)]
                out += [(r, i, names[k], labels[names[k]][p]) for i, p in found[k][2].items()]
                out.append((r, -1, names[k], None))
            yield pd.DataFrame(out, columns=["path_id", "pos", "haplotype", "label"])

    mapped = reads.mapInPandas(run, f"path_id {kind}, pos int, haplotype string, label string")
    ranked = subreads.select("path_id", "pos", "sub", "group", "read_pos", (F.row_number().over(by_path()) - 1).alias("nth"))
    inside = ranked.filter(F.col("group") == "module")
    span = inside.groupBy("path_id", "sub").agg(F.min("read_pos").alias("start"), F.max("read_pos").alias("end"))
    votes = inside.join(mapped.filter("label is not null").select("path_id", F.col("pos").alias("nth"), "label"), ["path_id", "nth"]).groupBy("path_id", "sub", "label").agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("first"))
    best = votes.groupBy("path_id", "sub").agg(F.max_by("label", F.struct("n", -F.col("first"))).alias("label"))
    rows = span.join(mapped.filter("pos = -1").select("path_id", "haplotype"), "path_id").join(best, ["path_id", "sub"], "left")
    return rows.select(F.concat(F.col("path_id").cast("string"), F.lit("_sr"), F.col("sub")).alias("sread"), F.col("path_id").alias("read"), "start", "end", "haplotype", F.concat_ws("_", "haplotype", "label").alias("module"))


def top_haplotypes(steps: DataFrame, per: int = 3) -> DataFrame:
    """hap, node, n: paths chosen as candidate haplotypes, the `per` with the most module-specific steps of each number of modules; ties by path_id."""
    n = steps.groupBy("path_id").agg((F.count_if(F.col("class") == "cyc_r") + 1).alias("modules"), F.count_if(F.col("class").isin("c1", "c2")).alias("own"))
    kept = n.withColumn("place", F.row_number().over(Window.partitionBy("modules").orderBy(F.desc("own"), "path_id"))).filter(F.col("place") <= per)
    return steps.join(kept.select("path_id"), "path_id", "left_semi").groupBy(F.col("path_id").alias("hap"), "node").agg(F.count(F.lit(1)).alias("n"))
