"""Candidate haplotypes by recursive bisection of subreads: marker walks, balanced cuts, and bounded paths through a graph of clusters.

A part is a set of subreads; its name is the sides of the cuts it came from (a string of 0 and 1, empty for all). All parts of a level are
walked, marked and cut at once: every table has the part as a key, and a level is a fixed number of joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepweave.operators import pairs as blocks
from stepweave.operators.graph import _settled, follow, small

TOP = 16  # nodes of each side that are looked at for an exchange
ROUNDS = 64  # exchanges of one cut; each lowers its weight, so that they end long before


def default_successors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst: of a node's successors, in the order of the edges, the one that a fold keeps.

    A later one replaces the one kept if the reference passes it more often, or passes it at all and more module haplotypes do. nodes: node, ref, c1, c2.
    """
    own = nodes.select(F.col("node").alias("dst"), "ref", (F.col("c1") + F.col("c2")).alias("c12"))
    lists = edges.join(small(own), "dst").groupBy("src").agg(F.array_sort(F.collect_list(F.struct("ord", "dst", "ref", "c12"))).alias("after"))
    better = lambda kept, x: F.when(((x["ref"] > 0) & (x["c12"] > kept["c12"])) | (x["ref"] > kept["ref"]), x).otherwise(kept)
    return lists.select("src", F.aggregate("after", F.get("after", F.lit(0)), better)["dst"].alias("dst"))


def outer_flanks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """group, pos, node: flankl by the last ref predecessors back from cyc_l, flankr by the last ref successors from cyc_r on; without the module's ends."""
    kind = nodes.select("node", "class")
    out = edges.join(small(kind.withColumnsRenamed({"node": "dst", "class": "kind"})), "dst").filter("kind = 'ref'").groupBy("src").agg(F.max_by("dst", "ord").alias("to"))
    back = edges.join(small(kind.withColumnsRenamed({"node": "src", "class": "kind"})), "src").filter("kind = 'ref'").groupBy("dst").agg(F.max_by("src", "ord").alias("to"))
    state = lambda node, g: F.struct(node.alias("node"), F.lit(g).alias("group"))
    steps = out.select(state(F.col("src"), "flankr").alias("at"), state(F.col("to"), "flankr").alias("to")).unionByName(back.select(state(F.col("dst"), "flankl").alias("at"), state(F.col("to"), "flankl").alias("to")))
    ends = nodes.filter("class in ('cyc_l', 'cyc_r')")
    starts = ends.select(F.when(F.col("class") == "cyc_l", state(F.col("node"), "flankl")).otherwise(state(F.col("node"), "flankr")).alias("at"))
    walked = follow(steps, starts).select("at.group", "at.node", "hops").filter("hops > 0")
    return _settled(walked.select("group", F.when(F.col("group") == "flankl", -F.col("hops")).otherwise(F.col("hops")).alias("pos"), "node"))


def coverage(steps: DataFrame) -> DataFrame:
    """part, src, dst, n of steps (part, id, pos, node)."""
    after = F.lead("node").over(Window.partitionBy("part", "id").orderBy("pos"))
    return steps.withColumn("dst", after).filter("dst is not null").groupBy("part", F.col("node").alias("src"), "dst").agg(F.count(F.lit(1)).alias("n"))


def _walks(own: DataFrame, before: DataFrame, default: DataFrame, parts: DataFrame, start, end) -> DataFrame:
    """part, hops, node: each part's walk from start to end, by its own best edge, else the best one it was cut from, else the default one."""
    best = lambda t, c: t.groupBy("part", "src").agg(F.min(F.struct((-F.col("n")).alias("m"), "dst")).alias("t")).select("part", "src", F.col("t.dst").alias(c))
    spare = parts.select("part").crossJoin(small(default.select("src", F.col("dst").alias("spare"))))  # each part needs each default
    table = best(own, "one").join(best(before, "two"), ["part", "src"], "full").join(spare, ["part", "src"], "full")
    table = table.select("part", "src", F.coalesce("one", "two", "spare").alias("dst")).filter(F.col("src") != F.lit(end))
    state = lambda node: F.struct("part", node.alias("node"))
    kind = table.schema["src"].dataType
    walked = follow(table.select(state(F.col("src")).alias("at"), state(F.col("dst")).alias("to")), parts.select(state(F.lit(start).cast(kind)).alias("at")))
    return walked.select("at.part", "hops", "at.node")


def markers(own: DataFrame, walks: DataFrame, least: int) -> DataFrame:
    """part, node, n: successors with `least` reads or more at places of the walk that have two of them; n is the second best support there, the greatest of several."""
    there = own.join(walks.select("part", F.col("node").alias("src")), ["part", "src"], "left_semi").filter(F.col("n") >= least)
    sites = there.groupBy("part", "src").agg(F.sort_array(F.collect_list("n"), asc=False).alias("ns")).filter("size(ns) > 1")
    return there.join(sites, ["part", "src"]).groupBy("part", F.col("dst").alias("node")).agg(F.max(F.get("ns", F.lit(1))).alias("n"))


def co_occurrence(held: DataFrame) -> DataFrame:
    """part, a < b, w: how many marker nodes two subreads of a part both hold. held: part, id, node, each once.

    Where most pairs share nodes they are compared in blocks (pairs.py), else by a join on the node.
    """
    held = _settled(held)
    observed = held.select("part", "id", F.col("node").alias("marker"), F.lit(None).cast("string").alias("allele"))
    if blocks.dense(observed, ["part"]):
        return blocks.counted(blocks.members(observed, ["part"]), ["part"], same=False).withColumnRenamed("common", "w")
    return held.withColumnRenamed("id", "a").join(held.withColumnRenamed("id", "b"), ["part", "node"]).filter("a < b").groupBy("part", "a", "b").agg(F.count(F.lit(1)).alias("w"))


def bisect(edges: DataFrame) -> DataFrame:
    """part, id, side (0 or 1) of weighted edges (part, a, b, w), each pair once: two halves of even size, few edges between them.

    Nodes are dealt to the sides in the order of their weights' sum and name; then rounds of exchanges lower the cut of every part at once. In a
    round the TOP nodes of each side that would gain most on the other are paired, each with the one it gains most with, if both agree, and change
    places: the better half of these pairs, or, where that does not lower the part's cut, the best pair alone. Parts without such a pair are done.
    """
    ways = _settled(edges.select("part", "a", "b", "w").unionByName(edges.select("part", F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    order = Window.partitionBy("part").orderBy(F.desc("all"), "id")
    nodes = ways.groupBy("part", F.col("a").alias("id")).agg(F.sum("w").alias("all"))
    state = _settled(nodes.select("part", "id", (F.row_number().over(order) % 2).cast("int").alias("side")))
    cut = lambda s: ways.join(s.withColumnsRenamed({"id": "a", "side": "x"}), ["part", "a"]).join(s.withColumnsRenamed({"id": "b", "side": "y"}), ["part", "b"]).groupBy("part").agg(F.sum(F.when(F.col("x") != F.col("y"), F.col("w")).otherwise(0)).alias("cut"))
    open_ = state.select("part").distinct()
    for _ in range(ROUNDS):
        sides = ways.join(open_, "part", "left_semi").join(state.withColumnsRenamed({"id": "a", "side": "x"}), ["part", "a"]).join(state.withColumnsRenamed({"id": "b", "side": "y"}), ["part", "b"])
        gain = sides.groupBy("part", F.col("a").alias("id"), F.col("x").alias("side")).agg(F.sum(F.when(F.col("x") != F.col("y"), F.col("w")).otherwise(-F.col("w"))).alias("d"))
        place = F.row_number().over(Window.partitionBy("part", "side").orderBy(F.desc("d"), F.xxhash64("id"), "id"))
        ranked = _settled(gain.withColumn("k", place).filter(F.col("k") <= TOP))
        one, two = (ranked.filter(F.col("side") == s).select("part", F.col("id").alias(i), F.col("d").alias(f"d{i}")) for s, i in ((0, "a"), (1, "b")))
        pairs = one.join(two, "part").join(ways, ["part", "a", "b"], "left").withColumn("gain", F.col("da") + F.col("db") - 2 * F.coalesce("w", F.lit(0)))  # TOP x TOP in a part
        best = lambda *of: F.row_number().over(Window.partitionBy("part", *of).orderBy(F.desc("gain"), F.xxhash64("a", "b"), "a", "b"))
        pairs = pairs.filter("gain > 0").withColumn("ka", best("a")).withColumn("kb", best("b")).filter("ka = 1 and kb = 1")
        pairs = _settled(pairs.withColumn("r", best()).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("part"))))
        if pairs.isEmpty():
            break
        change = lambda p: state.join(p.select("part", F.explode(F.array("a", "b")).alias("id"), F.lit(1).alias("other")), ["part", "id"], "left").select("part", "id", F.when(F.col("other") == 1, 1 - F.col("side")).otherwise(F.col("side")).alias("side"))  # noqa: B023, E731
        many = _settled(change(pairs.filter("2 * r <= m + 1")))
        lower = _settled(cut(many).withColumnRenamed("cut", "new").join(cut(state), "part").filter("new < cut").select("part"))
        state = _settled(many.join(lower, "part", "left_semi").unionByName(change(pairs.filter("r = 1")).join(lower, "part", "left_anti")))
        open_ = pairs.select("part").distinct()
    return state


def candidates(steps: DataFrame, default: DataFrame, start, end, least: int = 3, most: int = 50) -> tuple[DataFrame, DataFrame, int]:
    """Members (part, id) of all parts, whole and cut ones alike, each part's consensus (part, path), and the support that was asked of markers.

    steps: id, pos, node of module subreads. A part whose walk has markers is cut by how many markers its subreads share; subreads that share none
    with any other go no further. If there are more than `most` parts, all begins anew with a support of one more.
    """
    whole = _settled(steps.select(F.lit("").alias("part"), "id", "pos", "node"))
    while True:
        rows, before, members, paths, count = whole, None, [], [], 0
        while True:
            own = _settled(coverage(rows))
            parts = _settled(rows.select("part").distinct())
            walks = _settled(_walks(own, own.filter("false") if before is None else before, default, parts, start, end))
            members.append(rows.select("part", "id").distinct())
            listed = walks.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("hops", "node"))).alias("w"))
            paths.append(listed.select("part", F.transform("w", lambda x: x["node"]).alias("path")))
            count += parts.count()
            found = _settled(markers(own, walks, least))
            if count > most or found.isEmpty():
                break
            held = _settled(rows.join(found.select("part", "node"), ["part", "node"], "left_semi").select("part", "id", "node").distinct())
            sides = bisect(_settled(co_occurrence(held)))
            rows = _settled(rows.join(sides, ["part", "id"]).select(F.concat("part", F.col("side").cast("string")).alias("part"), "id", "pos", "node"))
            if rows.isEmpty():
                break
            before = own.crossJoin(F.broadcast(rows.sparkSession.createDataFrame([("0",), ("1",)], "s string"))).select(F.concat("part", "s").alias("part"), "src", "dst", "n")  # two rows
        if count <= most:
            return _settled(reduce(DataFrame.unionByName, members)), _settled(reduce(DataFrame.unionByName, paths)), least
        least += 1


def cluster_edges(subreads: DataFrame, of: DataFrame) -> DataFrame:
    """src, dst, n: how many subreads of a cluster follow one of another, or a flank. subreads: read, sub, id, group; of: id, cluster, of which a subread may have several.

    Edges lead from flankl to the clusters of the read's next module subread, from cluster to cluster between neighbouring module subreads, buffers
    left out, and from the last one to flankr if the read goes on in the right flank.
    """
    w = Window.partitionBy("read").orderBy("sub")
    rows = subreads.filter("group in ('flankl', 'module', 'flankr')").withColumn("next", F.lead(F.struct("id", "group")).over(w)).filter("next is not null")
    rows = rows.filter("not (group <> 'module' and next.group <> 'module')").select("id", "group", F.col("next.id").alias("id2"), F.col("next.group").alias("group2"))
    of2 = of.select(F.col("id").alias("id2"), F.col("cluster").cast("string").alias("cluster2"))
    rows = rows.join(of.select("id", F.col("cluster").cast("string").alias("cluster")), "id", "left").join(of2, "id2", "left")
    src = F.when(F.col("group") == "module", F.col("cluster")).otherwise(F.col("group"))
    dst = F.when(F.col("group2") == "module", F.col("cluster2")).otherwise(F.col("group2"))
    return rows.select(src.alias("src"), dst.alias("dst")).filter("src is not null and dst is not null and src <> 'flankr' and dst <> 'flankl'").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def cluster_paths(edges: DataFrame, least: int = 3, most_clusters: int = 3, limit: int = 20_000, start: str = "flankl", end: str = "flankr") -> DataFrame:
    """path, support: walks from start to end over edges (src, dst, n) with `least` reads or more, through at most most_clusters clusters, which may repeat.

    support is the sum of the edges' n. A frontier join, one round for each cluster; more than `limit` walks are an error, as they tell that the
    support asked is too low.
    """
    edges = _settled(edges.filter((F.col("n") >= least) & (F.col("dst") != start) & (F.col("src") != end)).select("src", "dst", "n"))
    front = edges.filter((F.col("src") == start) & (F.col("dst") != end)).select(F.array("src", "dst").alias("path"), F.col("n").alias("support"))
    found = None
    for _ in range(most_clusters):
        front = _settled(front)
        if front.limit(limit + 1).count() > limit:
            raise ValueError(f"more than {limit} paths through clusters; ask for more support than {least}")
        on = front.join(edges, F.element_at("path", -1) == F.col("src")).select(F.concat("path", F.array("dst")).alias("path"), (F.col("support") + F.col("n")).alias("support"), "dst")
        on = _settled(on)
        done = on.filter(F.col("dst") == end).drop("dst")
        found = done if found is None else found.unionByName(done)
        front = on.filter(F.col("dst") != end).drop("dst")
    found = _settled(found)
    if found.count() > limit:
        raise ValueError(f"more than {limit} paths through clusters; ask for more support than {least}")
    return found


def top_by_support(paths: DataFrame, per: int = 50) -> DataFrame:
    """The `per` paths with the greatest support of each number of clusters; ties by the path."""
    place = F.row_number().over(Window.partitionBy(F.size("path")).orderBy(F.desc("support"), "path"))
    return paths.withColumn("place", place).filter(F.col("place") <= per).drop("place")
