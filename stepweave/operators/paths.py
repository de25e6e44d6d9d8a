"""Operators over path steps (path_id, pos, node, class, size, ...): order, support, splitting, markers.

Every operator keeps rows of a path together by path_id alone, so that one shuffle serves all windows of a plan.
`class` is c1 or c2 for module-specific nodes, cyc_l and cyc_r for the ends of a module, ref for flanks, none for the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.operators.graph import small


def by_path() -> Window:
    return Window.partitionBy("path_id").orderBy("pos")


def edges(steps: DataFrame) -> DataFrame:
    """Each transition of a path: path_id, pos, src, dst."""
    return steps.select("path_id", "pos", F.col("node").alias("src"), F.lead("node").over(by_path()).alias("dst")).filter("dst is not null")


def neighbour_edges(steps: DataFrame) -> DataFrame:
    """src, dst of each pair of steps (path_id, pos, node) at neighbouring places of a path, by a join on the place: also for a stream, whose steps may arrive in any order.

    A repeated step counts once; two nodes at one place are two steps there. Steps without path or place are left out.
    """
    own = steps.select("path_id", "pos", "node").filter("path_id is not null and pos is not null").dropDuplicates(["path_id", "pos", "node"])
    before = own.select("path_id", F.col("node").alias("src"), (F.col("pos") + 1).alias("pos"))
    return before.join(own.withColumnRenamed("node", "dst"), ["path_id", "pos"]).select("src", "dst")


def ranked_successors(counts: DataFrame) -> DataFrame:
    """src, dst, n, share (of src's transitions) and best (most transitions, then the least name), from counts (src, dst, n) that may come in parts."""
    n = counts.groupBy("src", "dst").agg(F.sum("n").alias("n"))
    total = n.groupBy("src").agg(F.sum("n").alias("total"), F.min(F.struct(-F.col("n"), F.col("dst").alias("dst"))).alias("top"))
    return n.join(total, "src").select("src", "dst", "n", (F.col("n") / F.col("total")).alias("share"), (F.col("dst") == F.col("top.dst")).alias("best"))


def edge_support(steps: DataFrame) -> DataFrame:
    """How often, and in how many paths, node dst follows node src."""
    return edges(steps).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path_id").alias("n_paths"))


def successors(steps: DataFrame, least: int = 3) -> DataFrame:
    """Successors with at least `least` transitions."""
    return edge_support(steps).filter(F.col("n") >= least).select("src", "dst", "n")


def best_successor(steps: DataFrame) -> DataFrame:
    """The best supported successor of each node; a tie goes to the least node name, in place of an insertion order."""
    top = edge_support(steps).groupBy("src").agg(F.min(F.struct((-F.col("n")).alias("m"), "dst")).alias("t"))
    return top.select("src", F.col("t.dst").alias("dst"), (-F.col("t.m")).alias("n"))


def node_coverage(steps: DataFrame) -> DataFrame:
    """Visits of each node, and distinct paths."""
    return steps.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path_id").alias("n_paths"))


def coverage_norm(steps: DataFrame) -> DataFrame:
    """L2 norm of the visit counts."""
    return steps.groupBy("node").count().agg(F.sqrt(F.sum((F.col("count") * F.col("count")).cast("double"))).alias("norm"))


def multiplicity(steps: DataFrame) -> DataFrame:
    return steps.groupBy("path_id", "node").agg(F.count(F.lit(1)).alias("n"))


def running_position(steps: DataFrame) -> DataFrame:
    """Offset of each step in its path: the sizes of the steps before it."""
    before = F.sum("size").over(by_path().rowsBetween(Window.unboundedPreceding, -1))
    return steps.select("path_id", "pos", "node", F.coalesce(before, F.lit(0)).cast("long").alias("read_pos"))


def forward_fill(steps: DataFrame, wanted: Column, value: Column) -> Column:
    """The last value at a step where `wanted` holds, this one included."""
    return F.last(F.when(wanted, value), ignorenulls=True).over(by_path().rowsBetween(Window.unboundedPreceding, 0))


def region_node(steps: DataFrame) -> DataFrame:
    """For each node the last ref or none node before or at its first visit, over paths in ascending path_id."""
    filled = steps.withColumn("rnode", forward_fill(steps, F.col("class").isin("ref", "none"), F.col("node"))).filter("rnode is not null")
    return filled.groupBy("node").agg(F.min(F.struct("path_id", "pos", "rnode")).alias("t")).select("node", F.col("t.rnode").alias("rnode"))


def labelled(steps: DataFrame, groups: DataFrame) -> DataFrame:
    """Adds label, the group of a step's node (groups: node, group, as of locus.node_groups), null for nodes off the walk."""
    return steps.join(small(groups.select("node", F.col("group").alias("label"))), "node", "left")


def split_subreads(steps: DataFrame) -> DataFrame:
    """Cuts paths before cyc_l and after cyc_r: adds sub (from 0), sub_pos, and group, that of the segment's first labelled step.

    Labels are in the column label (see labelled()); without one, they follow the classes: flank or module.
    """
    cut = (F.col("pos") > 0) & ((F.col("class") == "cyc_l") | (F.lag("class").over(by_path()) == "cyc_r"))
    cut = steps.withColumn("cut", F.coalesce(cut, F.lit(False)).cast("int"))
    subs = cut.withColumn("sub", F.sum("cut").over(by_path().rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("cut")
    inside = Window.partitionBy("path_id", "sub").orderBy("pos")
    group = F.when(F.col("class") == "ref", "flank").when(F.col("class").isin("c1", "c2", "cyc_l", "cyc_r"), "module")
    group = F.col("label") if "label" in steps.columns else group
    first = F.first(group, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return subs.withColumn("sub_pos", (F.row_number().over(inside) - 1).cast("long")).withColumn("group", F.coalesce(first, F.lit("none")))


def drop_lone_flanks(subreads: DataFrame) -> DataFrame:
    """Drops a path with exactly one subread that is no module."""
    n = subreads.groupBy("path_id").agg(F.max("sub").alias("last"), F.min(F.when(F.col("sub") == 0, F.col("group"))).alias("g"))
    return subreads.join(n.filter("last > 0 or g = 'module'").select("path_id"), "path_id", "left_semi")


def informative(steps: DataFrame, on_walk: bool = False) -> DataFrame:
    """Paths that hold a module-specific node; with on_walk, one whose label is module (see labelled()).

    Of two alleles at one place the walk over the reference passes one, so on_walk drops reads that hold only the other's nodes.
    """
    own = F.col("class").isin("c1", "c2")
    own = own & (F.col("label") == "module") if on_walk else own
    whole = by_path().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in order of pos, as the windows after it
    return steps.withColumn("_own", F.max(own).over(whole)).filter("path_id is not null and _own").drop("_own")


def select_module(subreads: DataFrame, module: str, least: int = 5, share: float = 0.5) -> DataFrame:
    """Subreads with more than `least` informative steps, more than `share` of them of the module."""
    n = subreads.groupBy("path_id", "sub").agg(F.count_if(F.col("class").isin("c1", "c2")).alias("inf"), F.count_if(F.col("class") == module).alias("own"))
    return n.filter((F.col("inf") > least) & (F.col("own") > share * F.col("inf"))).select("path_id", "sub", "inf", "own")


def markers(steps: DataFrame) -> DataFrame:
    """Module-specific steps only, numbered from 0 in each path: marker_pos."""
    some = steps.filter(F.col("class").isin("c1", "c2"))
    return some.withColumn("marker_pos", (F.row_number().over(by_path()) - 1).cast("long"))


def side(c1: Column, c2: Column, purity: int) -> Column:
    return F.when(c1 > purity * c2, "c1").when(c2 > purity * c1, "c2")


def marker_windows(steps: DataFrame, k: int = 10, purity: int = 4) -> DataFrame:
    """At each marker with k before it and k from it on: counts of c1 and c2 on both sides, and the side each favours."""
    up, down = by_path().rowsBetween(-k, -1), by_path().rowsBetween(0, k - 1)
    rows = markers(steps).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("path_id")))
    for c in ("c1", "c2"):
        hit = (F.col("class") == c).cast("int")
        rows = rows.withColumn(f"up_{c}", F.sum(hit).over(up)).withColumn(f"down_{c}", F.sum(hit).over(down))
    rows = rows.filter((F.col("marker_pos") >= k) & (F.col("marker_pos") < F.col("total") - k) & (F.col("total") > 2 * k))
    return rows.select("path_id", "pos", "node", "class", "marker_pos", "up_c1", "up_c2", "down_c1", "down_c2", side(F.col("up_c1"), F.col("up_c2"), purity).alias("up"), side(F.col("down_c1"), F.col("down_c2"), purity).alias("down"))


def fusions(steps: DataFrame, k: int = 10, purity: int = 4) -> DataFrame:
    """Windows whose two sides favour different modules, at a marker of the upstream one that one of the other follows: the breakpoint is after it."""
    following = markers(steps).select("path_id", "marker_pos", F.lead("class").over(by_path()).alias("after"))
    rows = marker_windows(steps, k, purity).join(following, ["path_id", "marker_pos"])
    return rows.filter("up <> down and class = up and after <> class").select("path_id", "pos", "node", "up", "down")


def local_copy(steps: DataFrame, k: int = 5, purity: int = 3) -> DataFrame:
    """The module that markers around a step favour: the k nearest up to it, and the k nearest from two steps after it on.

    The step right after it, which tells alleles apart, is on neither side. In turn: c2 by all of them, by those after, by those before; c1 by all.
    """
    so_far = by_path().rowsBetween(Window.unboundedPreceding, 0)
    rows = steps
    for c in ("c1", "c2"):
        rows = rows.withColumn(f"n_{c}", F.sum((F.col("class") == c).cast("int")).over(so_far))
    total = F.max(F.col("n_c1") + F.col("n_c2")).over(by_path().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("m", F.col("n_c1") + F.col("n_c2")).withColumn("all", total)
    for c in ("m", "n_c1"):  # markers up to the next step, or all at the end
        rows = rows.withColumn(f"next_{c}", F.coalesce(F.lead(c).over(by_path()), F.col(c)))
    at = markers(steps).select("path_id", (F.col("marker_pos") + 1).alias("m"), F.sum((F.col("class") == "c1").cast("int")).over(by_path()).alias("t_c1"))
    zero = steps.select("path_id").distinct().select("path_id", F.lit(0).cast("long").alias("m"), F.lit(0).cast("long").alias("t_c1"))
    at = at.unionByName(zero)
    low = at.select("path_id", F.col("m").alias("low"), F.col("t_c1").alias("low_c1"))
    high = at.select("path_id", F.col("m").alias("high"), F.col("t_c1").alias("high_c1"))
    rows = rows.withColumn("low", F.greatest(F.col("m") - k, F.lit(0))).withColumn("high", F.least(F.col("next_m") + k, F.col("all")))
    rows = rows.join(low, ["path_id", "low"]).join(high, ["path_id", "high"])
    up1, down1 = F.col("n_c1") - F.col("low_c1"), F.col("high_c1") - F.col("next_n_c1")
    up2, down2 = F.col("m") - F.col("low") - up1, F.col("high") - F.col("next_m") - down1
    call = F.when(up2 + down2 > purity * (up1 + down1), "c2").when(down2 > purity * down1, "c2").when(up2 > purity * up1, "c2").when(up1 + down1 > purity * (up2 + down2), "c1")
    return rows.select("path_id", "pos", up1.cast("long").alias("up_c1"), up2.cast("long").alias("up_c2"), down1.cast("long").alias("down_c1"), down2.cast("long").alias("down_c2"), call.alias("copy"))


def module_ordinal(steps: DataFrame) -> DataFrame:
    """How many cyc_r steps lie before a step, and so which module of its path it is in."""
    n = F.sum((F.col("class") == "cyc_r").cast("int")).over(by_path().rowsBetween(Window.unboundedPreceding, -1))
    return steps.select("path_id", "pos", "node", (F.coalesce(n, F.lit(0)) + 1).cast("long").alias("module"))


def marker_profile(subreads: DataFrame, least: int = 3) -> DataFrame:
    """Counts of the nodes seen after each none node, where at least two of them have `least` reads."""
    pairs = subreads.withColumn("allele", F.lead("node").over(by_path())).filter("class = 'none' and allele is not null")
    counts = pairs.groupBy(F.col("node").alias("marker"), "allele").agg(F.count(F.lit(1)).alias("n"))
    kept = counts.filter(F.col("n") >= least).groupBy("marker").count().filter("count >= 2").select("marker")
    return counts.join(kept, "marker", "left_semi")


def contains_run(steps: DataFrame, run: list[str]) -> DataFrame:
    """Paths whose classes hold the run as neighbours, and how often."""
    hit = F.lit(True)
    for i, c in enumerate(run):
        hit = hit & (F.lead("class", i).over(by_path()) == c) if i else F.col("class") == c
    return steps.withColumn("hit", hit).groupBy("path_id").agg(F.count_if("hit").alias("n")).filter("n > 0")


def position_union(*tables: DataFrame) -> DataFrame:
    """read, positions: the positions of all tables (read, pos) together, ascending, those that several tables hold as often as they do."""
    rows = tables[0].select("read", "pos")
    for t in tables[1:]:
        rows = rows.unionByName(t.select("read", "pos"))
    return rows.groupBy("read").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
