"""A locus on its graph: reference coordinates, module ends, node classes, node groups, and the flanks' paths.

paths: path_id, pos, node; nodes: node, size; edges: src, dst, ord. The reference is one of the paths. Walks over reference nodes are
followed for many loci at once, within blocks of neighbouring nodes by one task each, and from block to block by doubling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepweave.operators.graph import _settled, follow_in_blocks
from stepweave.operators.paths import by_path


def reference_walk(paths: DataFrame, nodes: DataFrame, ref) -> DataFrame:
    """The reference's steps: pos, node, size, refpos (sizes before), first (no earlier visit of it or of any node again)."""
    own = paths.filter(F.col("path_id") == ref).select("path_id", "pos", "node").join(nodes.select("node", "size"), "node")
    nth = F.row_number().over(Window.partitionBy("path_id", "node").orderBy("pos"))
    before = F.sum("size").over(by_path().rowsBetween(Window.unboundedPreceding, -1))
    walk = own.withColumn("refpos", F.coalesce(before, F.lit(0)).cast("long")).withColumn("nth", nth)
    again = F.min(F.when(F.col("nth") > 1, F.col("pos"))).over(Window.partitionBy("path_id"))
    return walk.withColumn("again", again).select("pos", "node", "size", "refpos", ((F.col("nth") == 1) & (F.col("again").isNull() | (F.col("pos") < F.col("again")))).alias("first"))


def reference_coordinates(paths: DataFrame, nodes: DataFrame, ref) -> DataFrame:
    """node, size, ref (visits of the reference), rpos_min, rpos_max; -1 where a position is unknown.

    rpos_min is where the reference first passes a node, as long as it has passed none twice; rpos_max where it last passes it
    from then on. Nodes before the first one with a rpos_max take rpos_min for it, and nodes after the last one with a rpos_min take
    rpos_max (position 1 stops either). Other nodes take the median, cut to an integer, of the ends of the last positioned nodes
    before them on all paths; rpos_min counts from 0 where there is none.
    """
    walk = reference_walk(paths, nodes, ref)
    each = walk.groupBy("node").agg(F.count(F.lit(1)).alias("ref"), F.min(F.when(F.col("first"), F.col("refpos"))).alias("low"), F.max(F.when(~F.col("first"), F.col("refpos"))).alias("high"), F.min("pos").alias("p"), F.max("pos").alias("q"))
    edge = each.agg(F.min(F.when(F.col("high").isNotNull() | (F.col("low") == 1), F.col("p"))).alias("left"), F.max(F.when(F.col("low").isNotNull() | (F.col("high") == 1), F.col("q"))).alias("right"))
    each = each.crossJoin(F.broadcast(edge))  # one row
    high = F.when(F.col("high").isNull() & (F.col("left").isNull() | (F.col("p") < F.col("left"))), F.col("low")).otherwise(F.col("high"))
    low = F.when(F.col("low").isNull() & (F.col("right").isNull() | (F.col("q") > F.col("right"))), F.col("high")).otherwise(F.col("low"))
    known = _settled(nodes.select("node", "size").join(each.select("node", "ref", low.alias("low"), high.alias("high")), "node", "left"))
    steps = paths.select("path_id", "pos", "node").join(known, "node")
    up_to = by_path().rowsBetween(Window.unboundedPreceding, 0)
    at_low = F.coalesce(F.last(F.col("low") + F.col("size"), ignorenulls=True).over(up_to), F.lit(0))
    at_high = F.last(F.col("high") + F.col("size"), ignorenulls=True).over(up_to)
    filled = steps.select("node", F.when(F.col("low").isNull(), at_low).alias("l"), F.when(F.col("high").isNull(), at_high).alias("h"))
    near = filled.groupBy("node").agg(F.percentile("l", F.lit(0.5)).cast("long").alias("l"), F.percentile("h", F.lit(0.5)).cast("long").alias("h"))
    return known.join(near, "node", "left").select(
        "node", "size", F.coalesce("ref", F.lit(0)).alias("ref"), F.coalesce("low", "l", F.lit(-1)).alias("rpos_min"), F.coalesce("high", "h", F.lit(-1)).alias("rpos_max")
    )


def module_ends(coordinates: DataFrame, walk: DataFrame, share: float = 0.9) -> DataFrame:
    """One row: cyc_l and cyc_r, the first and the last reference node whose two positions lie more than `share` of the greatest distance apart."""
    jump = walk.join(coordinates.select("node", (F.col("rpos_max") - F.col("rpos_min")).alias("jump")), "node")
    far = jump.crossJoin(F.broadcast(jump.agg(F.max("jump").alias("most")))).filter(F.col("jump") > share * F.col("most"))
    return far.agg(F.min_by("node", "pos").alias("cyc_l"), F.max_by("node", "pos").alias("cyc_r"))


def module_counts_by_name(paths: DataFrame) -> DataFrame:
    """node, c1, c2: visits of paths whose name begins with c1_ or c2_."""
    own = paths.select("node", F.substring(F.col("path_id").cast("string"), 1, 3).alias("p")).filter("p in ('c1_', 'c2_')")
    return own.groupBy("node").agg(F.count_if(F.col("p") == "c1_").alias("c1"), F.count_if(F.col("p") == "c2_").alias("c2"))


def module_counts_by_overlap(paths: DataFrame, ends: DataFrame, ref) -> DataFrame:
    """node, c1, c2: each path's stretches from cyc_l on and up to before cyc_r count for the reference module that holds more of their nodes.

    The reference's own first and second stretch are c1 and c2; a tie goes to c1.
    """
    rows = paths.select("path_id", "pos", "node").crossJoin(F.broadcast(ends))  # one row
    nth = F.sum((F.col("node") == F.col("cyc_l")).cast("int")).over(by_path().rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("part", nth).filter("part > 0")
    inside = Window.partitionBy("path_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("over", F.max((F.col("node") == F.col("cyc_r")).cast("int")).over(inside)).filter("over = 0").select("path_id", "part", "node")
    own = rows.filter(F.col("path_id") == ref)
    members = own.filter("part <= 2").select("node", F.concat(F.lit("in_c"), F.col("part")).alias("m")).distinct().groupBy("node").pivot("m", ["in_c1", "in_c2"]).agg(F.count(F.lit(1)))
    of = rows.filter(F.col("path_id") != ref).join(members, "node", "left").groupBy("path_id", "part").agg(F.count("in_c1").alias("a"), F.count("in_c2").alias("b"))
    kinds = of.select("path_id", "part", F.when(F.col("b") > F.col("a"), "c2").otherwise("c1").alias("kind"))
    kinds = kinds.unionByName(own.filter("part <= 2").select("path_id", "part", F.concat(F.lit("c"), F.col("part")).alias("kind")).distinct())
    return rows.join(kinds, ["path_id", "part"]).groupBy("node").agg(F.count_if(F.col("kind") == "c1").alias("c1"), F.count_if(F.col("kind") == "c2").alias("c2"))


def annotate_nodes(paths: DataFrame, nodes: DataFrame, ref, fold: int = 3, guess: bool = False) -> DataFrame:
    """node, size, ref, c1, c2, rpos_min, rpos_max, rnode, class: the node table of a locus.

    Module counts go by the paths' names, or with guess by their overlap with the reference's modules. class is cyc_l and cyc_r for
    the module's ends, c1 or c2 where one count is more than fold times the other, ref where only the reference passes, else none.
    rnode is the last ref or none node at or before a node's first visit, on the reference first, then in the order of path_id.
    """
    at = _settled(reference_coordinates(paths, nodes, ref))
    ends = _settled(module_ends(at, reference_walk(paths, nodes, ref)))
    counts = module_counts_by_overlap(paths, ends, ref) if guess else module_counts_by_name(paths)
    rows = at.join(counts, "node", "left").fillna(0, ["c1", "c2"]).crossJoin(F.broadcast(ends))
    kind = (
        F.when(F.col("node") == F.col("cyc_l"), "cyc_l").when(F.col("node") == F.col("cyc_r"), "cyc_r").when(F.col("c1") > fold * F.col("c2"), "c1")
        .when(F.col("c2") > fold * F.col("c1"), "c2").when((F.col("ref") > 0) & (F.col("c1") == 0) & (F.col("c2") == 0), "ref").otherwise("none")
    )
    rows = _settled(rows.withColumn("class", kind).drop("cyc_l", "cyc_r"))
    steps = paths.select("path_id", "pos", "node").join(rows.select("node", "class"), "node")
    fill = F.last(F.when(F.col("class").isin("ref", "none"), F.col("node")), ignorenulls=True).over(by_path().rowsBetween(Window.unboundedPreceding, 0))
    filled = steps.withColumn("rnode", fill).filter("rnode is not null")
    region = filled.groupBy("node").agg(F.min_by("rnode", F.struct(F.col("path_id") != ref, "path_id", "pos")).alias("rnode"))
    return rows.join(region, "node", "left").select("node", "size", "ref", "c1", "c2", "rpos_min", "rpos_max", "rnode", "class")


BLOCK_NODES = 4096  # a block has about as many reference nodes, and as many places more as a node has


def _in_blocks(nodes: DataFrame, by: list[str]) -> DataFrame:
    """Reference nodes with their block: of neighbours by rpos_min, in stretches of equal width; where these hold too many, they are dealt out."""
    own = _settled(nodes.filter("ref > 0"))
    at = F.col("rpos_min").cast("double")
    ends = own.groupBy(*by).agg(F.min(at).alias("low"), F.max(at).alias("high"), F.count(F.lit(1)).alias("count"))
    own = own.join(F.broadcast(ends), by) if by else own.crossJoin(F.broadcast(ends))  # a row for each locus
    own = own.withColumn("stretch", F.coalesce(F.floor((at - F.col("low")) * F.col("count") / ((F.col("high") - F.col("low") + 1) * BLOCK_NODES)), F.lit(-1)))
    many = own.groupBy(*by, "stretch").agg(F.ceil(F.count(F.lit(1)) / (4 * BLOCK_NODES)).alias("parts"))
    own = own.join(many, [*by, "stretch"]).withColumn("block", F.xxhash64(*by, "stretch", F.pmod(F.xxhash64("node"), "parts")))
    return _settled(own.drop("low", "high", "count", "stretch", "parts"))


def _reference_edges(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """Edges between reference nodes (with block): src, dst, ord, their positions sp and dp, their block and to_block, and dst's class."""
    src = nodes.select(*by, F.col("node").alias("src"), F.col("rpos_min").alias("sp"), "block")
    dst = nodes.select(*by, F.col("node").alias("dst"), F.col("rpos_min").alias("dp"), F.col("class").alias("kind"), F.col("block").alias("to_block"))
    return edges.select(*by, "src", "dst", "ord").join(src, [*by, "src"]).join(dst, [*by, "dst"])


def _first_flank_node(nodes: DataFrame, by: list[str]) -> DataFrame:
    flank = nodes.filter("ref > 0 and class = 'ref'")
    first = flank.groupBy(*by).agg(F.min_by(F.struct("node", "block"), F.struct("rpos_min", F.col("node").cast("string"))).alias("first"))
    return first.select(*by, "first.*").filter("node is not null")


GROUPS = "flankl", "module", "buffer", "flankr"


def node_groups(nodes: DataFrame, edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """node, group: flankl, module, buffer or flankr, along a walk over reference nodes that passes the module twice; a later visit counts.

    The walk starts at the first flank node and goes on to the nearest reference node beyond it. From cyc_l on it is in the module, from cyc_r
    on in the buffer, which may lead back to cyc_l; after that second lap cyc_r leads to the right flank, and the farthest node is taken.
    For each value of the columns in `by` (locus) there is a walk of its own. Where a walk stands is node, group and lap, which tells
    where it goes, so all steps are joined at once, and the walks are followed in blocks.
    """
    by = by or []
    own = _in_blocks(nodes, by)
    modes = F.array(*(F.struct(F.lit(g).alias("group"), F.lit(lap).alias("lap")) for g, lap in (("flankl", 1), ("module", 1), ("buffer", 1), ("module", 2), ("flankr", 2))))
    ways = _reference_edges(own, edges, by).withColumn("mode", F.explode(modes)).select("*", "mode.*").drop("mode")
    ways = ways.filter((F.col("dp") > F.col("sp")) | ((F.col("group") == "buffer") & (F.col("kind") == "cyc_l")))
    near = F.when(F.col("lap") == 1, F.col("dp")).otherwise(-F.col("dp"))
    step = ways.groupBy(*by, "src", "block", "group", "lap").agg(F.min_by(F.struct("dst", "kind", "to_block"), F.struct(near, "ord")).alias("to"))
    lap = F.when((F.col("to.kind") == "cyc_l") & (F.col("group") == "buffer"), 2).otherwise(F.col("lap"))
    right = F.when(F.col("lap") == 2, "flankr").otherwise("buffer")
    group = F.when(F.col("to.kind") == "cyc_l", "module").when(F.col("to.kind") == "cyc_r", right).otherwise(F.col("group"))
    state = lambda node, g, k: F.struct(*(F.col(c).alias(c) for c in by), node.alias("node"), g.alias("group"), k.cast("int").alias("lap"))
    steps = step.select(state(F.col("src"), F.col("group"), F.col("lap")).alias("at"), state(F.col("to.dst"), group, lap).alias("to"), "block", "to.to_block")
    starts = _first_flank_node(own, by).select(state(F.col("node"), F.lit("flankl"), F.lit(1)).alias("at"), "block")
    walked = follow_in_blocks(steps, starts).select("at.*", "hops")
    return _settled(walked.groupBy(*by, "node").agg(F.max_by("group", "hops").alias("group")))


def flank_paths(nodes: DataFrame, edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """group, pos, node: the nodes of flankl, buffer and flankr along the reference, without the module's ends.

    The left flank goes from the first flank node by the first edge, the others from cyc_r; the right one takes the farthest reference node at
    each step, the buffer the nearest or cyc_l, where it and the left flank end.
    """
    by = by or []
    own = _in_blocks(nodes, by)
    modes = F.array(*(F.lit(g) for g in ("flankl", "buffer", "flankr")))
    kinds = nodes.select(*by, F.col("node").alias("src"), F.col("class").alias("from_kind"))
    ways = _reference_edges(own, edges, by).join(kinds, [*by, "src"]).withColumn("group", F.explode(modes))
    ways = ways.filter("(dp > sp or (group = 'buffer' and kind = 'cyc_l')) and not (from_kind = 'cyc_l' and group <> 'flankr')")
    first = F.when(F.col("group") == "flankl", F.lit(0)).when(F.col("group") == "flankr", -F.col("dp")).otherwise(F.when(F.col("kind") == "cyc_l", -1).otherwise(F.col("dp")))
    step = ways.groupBy(*by, "src", "block", "group").agg(F.min_by(F.struct("dst", "to_block"), F.struct(first, "ord")).alias("to"))
    state = lambda node, g: F.struct(*(F.col(c).alias(c) for c in by), node.alias("node"), g.alias("group"))
    steps = step.select(state(F.col("src"), F.col("group")).alias("at"), state(F.col("to.dst"), F.col("group")).alias("to"), "block", "to.to_block")
    right = own.filter("class = 'cyc_r'").select(*by, "node", "block", F.explode(F.array(F.lit("buffer"), F.lit("flankr"))).alias("group"))
    starts = _first_flank_node(own, by).withColumn("group", F.lit("flankl")).unionByName(right)
    walked = follow_in_blocks(steps, starts.select(state(F.col("node"), F.col("group")).alias("at"), "block")).select("at.*", F.col("hops").alias("pos"))
    inner = nodes.filter("class not in ('cyc_l', 'cyc_r')").select(*by, "node")
    return _settled(walked.join(inner, [*by, "node"]).select(*by, "group", "pos", "node"))


def flank_path(nodes: DataFrame, edges: DataFrame, group: str) -> list:
    """Nodes of one flank of flank_paths, in order: a list as long as the reference of one locus."""
    return [r["node"] for r in flank_paths(nodes, edges).filter(F.col("group") == group).orderBy("pos").select("node").collect()]
