"""Tables behind the plots: node positions, read parts, allele balance, coverage tiles, haplotype dots, gene tracks, packed intervals.

Everywhere a `sample` column, if there is one, may stand among the keys (`by`), so that several samples are worked on at once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.operators.intervals import overlaps
from stepweave.operators.order import running

MODULES = {"c1": "1", "none": "both", "c2": "2"}  # class to the label of the plots; others are not drawn


def module_label(kind: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in MODULES.items() for x in pair))[kind]


def drawn_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes that some path passes."""
    return nodes.filter("ref + c1 + c2 > 0")


def shared_nodes(nodes: DataFrame, share: float = 0.8) -> DataFrame:
    """Nodes that both modules pass about as often, but for flanks."""
    return nodes.filter((F.col("c1") > share * F.col("c2")) & (F.col("c2") > share * F.col("c1")) & (F.col("class") != "ref"))


def node_positions(nodes: DataFrame, offset: int = 0) -> DataFrame:
    """Adds pos to drawn nodes, in ascending order of node: rpos_max, or the last one before it where both positions agree; offset is added.

    Zeros, before the first such node, become the second smallest position. The last position is found with a running maximum of places.
    """
    rows = running(drawn_nodes(nodes), ["node"]).withColumnRenamed("run", "place")
    moved = rows.filter("rpos_min <> rpos_max").select("place", F.col("rpos_max").alias("p"))
    spans = running(moved, ["place"]).withColumnRenamed("run", "nth")
    after = spans.select((F.col("nth") - 1).alias("nth"), F.col("place").alias("stop"))
    spans = spans.join(after, "nth", "left").select("p", F.explode(F.sequence("place", F.coalesce(F.col("stop") - 1, F.col("place")))).alias("place"), F.col("stop").isNull().alias("last"), F.col("place").alias("begin"))
    tail = spans.filter("last").agg(F.max("begin").alias("begin"), F.max_by("p", "begin").alias("tail"))  # one row
    placed = rows.join(spans.select("place", "p"), "place", "left").crossJoin(F.broadcast(tail))
    placed = placed.withColumn("pos", F.when(F.col("rpos_min") != F.col("rpos_max"), F.col("rpos_max")).otherwise(F.coalesce("p", F.when(F.col("place") > F.col("begin"), F.col("tail")), F.lit(0))))
    second = placed.select("pos").distinct().orderBy("pos").limit(2).agg(F.max("pos").alias("second"))
    placed = placed.crossJoin(F.broadcast(second)).withColumn("pos", F.when(F.col("pos") == 0, F.col("second")).otherwise(F.col("pos")) + offset)
    return placed.select(*nodes.columns, "pos")


def split_paths(steps: DataFrame, key: str = "read", order: str = "readpos", low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Adds path_part (from 1): a path is cut at cyc_r nodes that lie neither near its beginning nor near its end, and such a row is in both parts.

    A path of which most steps go to smaller nodes is turned round first. A path of two rows or more is expected.
    """
    w = Window.partitionBy(key).orderBy(order)
    turned = steps.withColumn("_back", (F.col("node") < F.lag("node").over(w)).cast("double")).groupBy(key).agg((F.avg("_back") > 0.5).alias("_turn"), F.count(F.lit(1)).alias("_n"))
    rows = steps.join(turned, key).withColumn("_o", F.when(F.col("_turn"), -F.col(order)).otherwise(F.col(order)))
    w = Window.partitionBy(key).orderBy("_o")
    rows = rows.withColumn("_place", F.row_number().over(w))
    cut = (F.col("class") == "cyc_r") & (F.col("_place") / F.col("_n") > low) & (F.col("_place") / F.col("_n") < high)
    rows = rows.withColumn("_cut", F.coalesce(cut, F.lit(False)))
    rows = rows.withColumn("_part", F.coalesce(F.sum(F.col("_cut").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1)
    parts = F.when(F.col("_cut"), F.array(F.col("_part"), F.col("_part") + 1)).otherwise(F.array("_part"))
    return rows.withColumn("path_part", F.explode(parts)).select(*steps.columns, F.col("path_part").cast("long").alias("path_part"))


def allele_sites(steps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """rnode, c2_prop, c2_prop_adj, depth, node, pos of regions where both modules' alleles are seen; node and pos are of the least node.

    steps: rnode, node, pos, class (and `by`). c2_prop_adj is 1 minus the other module's share where that of the second is 0.
    """
    rows = steps.filter(F.col("class").isin("c1", "c2"))
    two = F.avg((F.col("class") == "c2").cast("double"))
    out = rows.groupBy(*(by or []), "rnode").agg(two.alias("c2_prop"), (1 - two).alias("c1_prop"), F.count(F.lit(1)).alias("depth"), F.min("node").alias("node"), F.min_by("pos", "node").alias("pos"), F.max("class").alias("hi"), F.min("class").alias("lo"))
    adjusted = F.when(F.col("c2_prop") == 0, 1 - F.col("c1_prop")).otherwise(F.col("c2_prop"))
    return out.filter("hi <> lo").select(*(by or []), "rnode", "c2_prop", adjusted.alias("c2_prop_adj"), "depth", "node", "pos")


def tiles(steps: DataFrame, width: int = 10, by: list[str] | None = None) -> DataFrame:
    """node, tile, start, end, cov: reads over about equal tiles of ref and none nodes, 0 where there are none.

    A node from its least to its greatest covered position (both included) is cut into as many tiles as it has whole widths, one at least.
    """
    by = by or []
    rows = steps.filter(F.col("class").isin("ref", "none")).select(*by, "node", "class", F.least("startpos", "endpos").alias("s"), F.greatest("startpos", "endpos").alias("e"))
    span = rows.groupBy(*by, "node", "class").agg(F.min("s").alias("lo"), F.max("e").alias("hi"))
    length = F.col("hi") - F.col("lo") + 1
    n = F.greatest(F.ceil(length / width), F.lit(1))
    cut = span.withColumn("tile", F.explode(F.sequence(F.lit(0), n.cast("int") - 1))).withColumn("n", n)
    cut = cut.withColumn("start", (F.col("lo") + F.floor(F.col("tile") * length / F.col("n"))).cast("long")).withColumn("end", (F.col("lo") + F.floor((F.col("tile") + 1) * length / F.col("n")) - 1).cast("long"))
    key = F.concat_ws("\t", *by, "node")
    left = cut.select(key.alias("key"), F.col("tile").alias("id"), "start", "end")
    right = rows.withColumn("id", F.lit(0)).select(key.alias("key"), "id", F.col("s").alias("start"), F.col("e").alias("end"))
    hits = overlaps(left, right).groupBy("key", F.col("l_id").alias("tile")).agg(F.count(F.lit(1)).alias("cov"))
    return cut.withColumn("key", key).join(hits, ["key", "tile"], "left").select(*by, "node", "class", "tile", "start", "end", F.coalesce("cov", F.lit(0)).alias("cov"))


def tile_copies(tiled: DataFrame, flank_edges: float | None, nodes: DataFrame) -> DataFrame:
    """node, class, cov_n, cov_n_2: medians over a shared node's tiles of twice the coverage over the flanks' median, and over the count of flank edges."""
    flank = tiled.filter("class = 'ref'").agg(F.percentile("cov", F.lit(0.5)).alias("m"))
    rows = tiled.crossJoin(F.broadcast(flank)).join(shared_nodes(nodes).select("node"), "node", "left_semi")
    one, two = F.try_divide(2.0 * F.col("cov"), F.col("m")), F.try_divide(2.0 * F.col("cov"), F.lit(flank_edges).cast("double"))
    return rows.groupBy("node", "class").agg(F.percentile(one, F.lit(0.5)).alias("cov_n"), F.percentile(two, F.lit(0.5)).alias("cov_n_2"))


def read_lengths(steps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """read, nodes, kbp: steps and covered bases of each read."""
    return steps.groupBy(*(by or []), "read").agg(F.count(F.lit(1)).alias("nodes"), (F.sum(F.col("endpos") - F.col("startpos")) / 1000).alias("kbp"))


def allele_tallies(long: DataFrame) -> DataFrame:
    """read, nref, nalt of rows (read, variant, allele)."""
    return long.groupBy("read").agg(F.count_if(F.col("allele") == "ref").alias("nref"), F.count_if(F.col("allele") == "alt").alias("nalt"))


def call_points(parts: DataFrame, calls: DataFrame) -> DataFrame:
    """Read steps joined with their alternate calls (read, node), and of these the points to draw: those on a read's last part.

    A fusion stands halfway between its two nodes and is named by its positions.
    """
    rows = parts.join(calls, ["read", "node"], "left")
    last = rows.withColumn("_last", F.max("path_part").over(Window.partitionBy("read"))).filter((F.col("path_part") == F.col("_last")) & F.col("variant").isNotNull())
    fusion = F.col("fusion_start_node").isNotNull()
    return last.select("read", "path_part", F.when(fusion, (F.col("node") + F.col("fusion_start_node")) / 2).otherwise(F.col("node").cast("double")).alias("node"), F.when(fusion, F.concat_ws("_FUS_", "pos", "end")).otherwise(F.col("variant")).alias("variant"))


def haplotype_dots(stats: DataFrame, haps: DataFrame, nodes: DataFrame, place: int = 1) -> DataFrame:
    """hap (hap_1, hap_2), node, ppos, pos, module, specific of the pair at `place` of stats by rank; a pair of one haplotype shows it twice."""
    best = stats.orderBy("rank", "hap1", "hap2").limit(place).orderBy(F.desc("rank"), F.desc("hap1"), F.desc("hap2")).limit(1)
    sides = best.select(F.explode(F.array(F.struct(F.col("hap1").alias("hap"), F.lit("hap_1").alias("side")), F.struct(F.col("hap2").alias("hap"), F.lit("hap_2").alias("side")))).alias("x")).select("x.hap", "x.side")
    rows = haps.join(F.broadcast(sides), "hap").withColumn("module", module_label(F.col("class"))).filter("module is not null")  # two rows
    return rows.join(nodes.select("node", "pos"), "node").select(F.col("side").alias("hap"), "node", "ppos", "pos", "module", (F.col("module") != "both").alias("specific"))


def annotated_parts(steps: DataFrame) -> DataFrame:
    """Parts of reads with more than one step, with the label of each step's class; classes that are not drawn go."""
    n = steps.groupBy("read").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("read")
    return split_paths(steps.join(n, "read", "left_semi")).withColumn("module", module_label(F.col("class"))).filter("module is not null")


def limits(*columns: DataFrame) -> DataFrame:
    """One row: least and greatest value over one-column tables."""
    out = columns[0].toDF("x")
    for c in columns[1:]:
        out = out.unionByName(c.toDF("x"))
    return out.agg(F.min("x").alias("low"), F.max("x").alias("high"))


def gene_nodes(genes: DataFrame, nodes: DataFrame, offset: int = 0) -> DataFrame:
    """Adds nstart, nend: the least and greatest node between the module's ends that an element overlaps at either position, one more where they agree."""
    ends = nodes.filter(F.col("class").isin("cyc_l", "cyc_r")).agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    inner = nodes.crossJoin(F.broadcast(ends)).filter("node >= lo and node <= hi")
    spot = lambda c: inner.select(F.lit(0).alias("key"), F.col("node").alias("id"), F.col(c).alias("start"), (F.col(c) + F.col("size") - 1).alias("end"))
    own = genes.select(F.lit(0).alias("key"), F.col("id"), (F.col("start") - offset).alias("start"), (F.col("end") - offset).alias("end"))
    hit = overlaps(own, spot("rpos_min"), 1 << 12).unionByName(overlaps(own, spot("rpos_max"), 1 << 12))
    span = hit.groupBy(F.col("l_id").alias("id")).agg(F.min("r_id").alias("nstart"), F.max("r_id").alias("b")).select("id", "nstart", F.when(F.col("nstart") == F.col("b"), F.col("b") + 1).otherwise(F.col("b")).alias("nend"))
    return genes.join(span, "id", "left")


def gene_track(genes: DataFrame, nodes: DataFrame, offset: int = 0) -> DataFrame:
    """Adds module (by the midpoint against cyc_l's second position), pstart and pend (moved by the median distance of the two modules, where the midpoint lies before all nodes).

    nodes has pos; one row of totals is broadcast.
    """
    jump = nodes.agg(F.percentile(F.when(F.col("rpos_min") != F.col("rpos_max"), F.col("rpos_max") - F.col("rpos_min")), F.lit(0.5)).alias("jump"), F.min("pos").alias("first"), F.max(F.when(F.col("class") == "cyc_l", F.col("rpos_max"))).alias("border"))
    mid = (F.col("start") + F.col("end")) / 2
    moved = lambda c: F.when(mid < F.col("first"), F.col(c) + F.col("jump")).otherwise(F.col(c))
    return gene_nodes(genes, nodes, offset).crossJoin(F.broadcast(jump)).select(*genes.columns, "nstart", "nend", F.when(mid - offset < F.col("border"), "c1").otherwise("c2").alias("module"), moved("start").alias("pstart"), moved("end").alias("pend"))


def transcription_starts(track: DataFrame) -> DataFrame:
    """gene_name, module, node, pos of genes' beginnings, by strand."""
    plus = F.col("strand") == "+"
    return track.filter("type = 'gene'").select("gene_name", "module", F.when(plus, F.col("nstart")).otherwise(F.col("nend")).alias("node"), F.when(plus, F.col("pstart")).otherwise(F.col("pend")).alias("pos"))


def clipped(track: DataFrame, low: float, high: float, start: str = "pstart", end: str = "pend") -> DataFrame:
    """Elements cut to [low, high]; those of which nothing is left go."""
    cut = lambda c: F.least(F.greatest(F.col(c), F.lit(low)), F.lit(high))
    return track.withColumns({start: cut(start), end: cut(end)}).filter(F.col(start) != F.col(end))


def gene_point_nodes(points: DataFrame, nodes: DataFrame, offset: int = 0) -> DataFrame:
    """id, node, module of points (id, at): the last node, by ord, that holds a point at its first position (c1), else at its second one (c2).

    No pairs of points and nodes are made: a range is cut into aligned blocks of 1, 2, 4, ... positions, two of each size at most, each block keeps its last node,
    and a point looks up the blocks that it lies in, one of each size.
    """
    spot = lambda c, first: nodes.select("ord", F.lit(first).alias("first"), (F.col(c) + offset).cast("long").alias("s"), (F.col(c) + offset + F.col("size")).cast("long").alias("e")).filter("s < e")
    ranges = spot("rpos_min", 1).unionByName(spot("rpos_max", 0)).withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("e") - F.col("s"))).cast("int"))))
    # the whole blocks of size 2^k in a range are those from l to r; of these an odd l and an even r are not part of a larger one
    ranges = ranges.withColumns({"l": F.expr("-shiftright(-s, k)"), "r": F.expr("shiftright(e, k) - 1")}).filter("l <= r")
    ends = F.array_distinct(F.array_compact(F.array(F.when(F.col("l") % 2 != 0, F.col("l")), F.when(F.col("r") % 2 == 0, F.col("r")))))
    blocks = ranges.select("k", F.explode(ends).alias("block"), F.struct("ord", "first").alias("t")).groupBy("k", "block").agg(F.max("t").alias("t"))
    sizes = [r["k"] for r in blocks.select("k").distinct().collect()]  # 63 at most
    own = points.select("id", F.col("at").cast("long").alias("at"), F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")).alias("k")).withColumn("block", F.expr("shiftright(at, k)"))
    last = own.join(blocks, ["k", "block"]).groupBy("id").agg(F.max("t").alias("t"))
    last = last.select("id", "t.ord", F.when(F.col("t.first") == 1, "c1").otherwise("c2").alias("module"))
    return last.join(nodes.select("ord", "node"), "ord").select("id", "node", "module")


def flipped(genes: DataFrame, anchor: str, key: str = "sample") -> DataFrame:
    """Intervals of a sample mirrored inside its bounds, strands turned, where its `anchor` gene is on the minus strand."""
    w = Window.partitionBy(key)
    rows = genes.withColumns({"_lo": F.min("start").over(w), "_hi": F.max("end").over(w), "_turn": F.max(((F.col("gene") == anchor) & (F.col("strand") == "-")).cast("int")).over(w) == 1})
    turn, other = F.col("_turn"), F.translate("strand", "+-", "-+")
    changed = {"start": F.when(turn, F.col("_lo") + F.col("_hi") - F.col("end")).otherwise(F.col("start")), "end": F.when(turn, F.col("_lo") + F.col("_hi") - F.col("start")).otherwise(F.col("end")), "strand": F.when(turn, other).otherwise(F.col("strand"))}
    return rows.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in genes.columns))


def shifted(genes: DataFrame, anchor: str, key: str = "sample") -> DataFrame:
    """Adds rel_start and rel_end: positions from the beginning of the sample's `anchor` gene."""
    base = F.max(F.when(F.col("gene") == anchor, F.col("start"))).over(Window.partitionBy(key))
    return genes.withColumns({"rel_start": F.col("start") - base, "rel_end": F.col("end") - base})


def complete_contigs(genes: DataFrame, once: list[str], size: int = 300, sources: int = 2) -> DataFrame:
    """key, of contigs on which each gene of `once` of a length over `size` stands exactly once, as `sources` sources or more say."""
    big = genes.filter(F.col("end") - F.col("start") > size)
    ok = F.lit(True)
    for g in once:
        ok = ok & (F.count_distinct(F.when(F.col("gene") == g, F.col("start"))) == 1)
    return big.groupBy("key").agg(ok.alias("ok"), F.count_distinct("source").alias("n")).filter((F.col("n") >= sources) & F.col("ok")).select("key")


def joined_names(rows: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """key, names (joined by _ in order), n (different ones)."""
    out = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, name))).alias("r"), F.count_distinct(name).alias("n"))
    return out.select(key, F.array_join(F.transform("r", lambda x: x[name].cast("string")), "_").alias("names"), "n")


def count_of_counts(rows: DataFrame, key: str, of: list[str]) -> DataFrame:
    """How many keys have each combination of counts of the values in `of`; its columns are n_<value> and keys."""
    each = rows.groupBy(key).agg(*(F.count_if(F.col("gene") == g).alias(f"n_{g}") for g in of))
    return each.groupBy(*(f"n_{g}" for g in of)).agg(F.count(F.lit(1)).alias("keys"))


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def sampled(rows: DataFrame, n: int, key: str, seed: int = 1) -> DataFrame:
    """n rows, those of the least hash of their key: the same ones each time."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def jumps(walk: DataFrame) -> DataFrame:
    """pos, node, next, jump along a reference walk: the next node, and how far its position lies from this one's."""
    w = Window.partitionBy(F.lit(0)).orderBy("pos")  # one path: the reference
    return walk.select("pos", "node", F.lead("node").over(w).alias("next"), (F.lead("refpos").over(w) - F.col("refpos")).alias("jump")).filter("next is not null")


def packed_levels(intervals: DataFrame, by: str = "sample") -> DataFrame:
    """Adds level, from 1: each interval, by its start, takes the first level whose last interval ends before it. One group per sample."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, ends, out = pdf.sort_values(["start", "end"], kind="stable"), [], []
        for s, e in zip(pdf["start"], pdf["end"]):
            k = next((k for k, last in enumerate(ends) if last < s), len(ends))
            ends[k : k + 1] = [e]
            out.append(k + 1)
        return pdf.assign(level=out)

    return intervals.groupBy(by).applyInPandas(pack, intervals.select("*", F.lit(0).alias("level")).schema)


def read_order(long: DataFrame) -> DataFrame:
    """read, place: reads of a read by variant table (read, variant, allele) in the order of an agglomeration of the nearest, by complete linkage.

    The table is as wide as there are calls and as long as there are reads to plot, so it is one group.
    """

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.assign(x=(pdf["allele"] == "alt").astype(float)).pivot_table(index="read", columns="variant", values="x", aggfunc="max", fill_value=0.0).sort_index()
        groups = {k: [k] for k in range(len(wide))}
        m = wide.to_numpy()
        far = {(a, b): float(((m[a] - m[b]) ** 2).sum() ** 0.5) for a in groups for b in groups if a < b}
        while len(groups) > 1:
            a, b = min(far, key=lambda p: (far[p], p))
            groups[a] += groups.pop(b)
            for c in groups:
                if c != a:
                    p = (min(a, c), max(a, c))
                    far[p] = max(far[p], far[(min(b, c), max(b, c))])
            far = {p: d for p, d in far.items() if b not in p}
        flat = next(iter(groups.values()), [])
        return pd.DataFrame({"read": [str(wide.index[k]) for k in flat], "place": range(1, len(flat) + 1)})

    return long.groupBy(F.lit(0).alias("all")).applyInPandas(order, "read string, place long")
