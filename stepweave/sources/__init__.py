"""Readers: graph and alignment text, FASTQ, tables. Files are split by Spark; nothing is read on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepweave.functions import mostly_reverse, parse_cigar, parse_difference, parse_path, tag
from stepweave.operators.graph import small

NODE_INFO = "node string, size int, seq string, ref int, c1 int, c2 int, rpos_min int, rpos_max int, rnode string, class string"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their order (file name, then place in the file) and tab-separated fields; gzip is transparent.

    ord is a struct: Spark deals files and their parts to tasks by size, so a row's number alone tells its place within one part only.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select(place.alias("ord"), F.split("value", "\t").alias("f"))


def node_info(spark: SparkSession, path: str) -> DataFrame:
    """A node table; columns are found by header name, missing ones are null."""
    raw = spark.read.csv(path, sep="\t", header=True)
    known = dict(x.split() for x in NODE_INFO.split(", "))
    return raw.select(*((F.col(c) if c in raw.columns else F.lit(None)).cast(kind).alias(c) for c, kind in known.items()))


def gfa_nodes(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).filter("f[0] = 'S'").select(F.expr("f[1]").alias("node"), F.expr("f[2]").alias("seq"), F.expr("length(f[2])").alias("size"))


def gfa_edges(spark: SparkSession, path: str, nodes: DataFrame | None = None) -> DataFrame:
    """src, dst, same_sense of distinct links, of those from `nodes` if there are any; ord is the first line of each."""
    rows = lines(spark, path).filter("f[0] = 'L'").select("ord", F.expr("f[1]").alias("src"), F.expr("f[3]").alias("dst"), F.expr("f[2] = f[4]").alias("same_sense"))
    rows = rows if nodes is None else rows.join(nodes.select(F.col("node").alias("src")), "src", "left_semi")
    return rows.groupBy("src", "dst").agg(F.min_by("same_sense", "ord").alias("same_sense"), F.min("ord").alias("ord"))


def gfa_paths(spark: SparkSession, path: str, sample_names: bool = False) -> DataFrame:
    """path_id, pos, node of P and W lines, flipped where most steps are reverse. W lines are named by sequence, or by sample."""
    rows = lines(spark, path).filter("f[0] in ('P', 'W')")
    w = F.col("f")[1] if sample_names else F.col("f")[3]
    steps = F.when(F.col("f")[0] == "P", F.transform(F.split(F.col("f")[2], ","), lambda s: F.concat(F.when(s.endswith("-"), "<").otherwise(">"), F.regexp_replace(s, "[+-]$", "")))).otherwise(F.array(F.get("f", F.lit(6))))
    flat = rows.select(F.when(F.col("f")[0] == "P", F.col("f")[1]).otherwise(w).alias("path_id"), F.concat_ws("", steps).alias("p"))
    nodes = F.transform(parse_path(F.col("p")), lambda s: s["node"])
    return flat.select("path_id", F.posexplode(F.when(mostly_reverse(F.col("p")), F.reverse(nodes)).otherwise(nodes)).alias("pos", "node"))


def paths_as_reads(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds start_pos 0, end_pos = size and read_pos = sizes before."""
    w = Window.partitionBy("path_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return paths.join(nodes.select("node", "size"), "node").select("path_id", "pos", "node", F.lit(0).alias("start_pos"), F.col("size").alias("end_pos"), F.coalesce(F.sum("size").over(w), F.lit(0)).alias("read_pos"))


def gaf_records(spark: SparkSession, path: str, least: int = 0, least_span: int = 0) -> DataFrame:
    """Usable records, the first one of each read: name, start, path, path_start, ops.

    A record is usable if the read is at least `least` long, its aligned span at least `least_span`, and it has a cg or cs tag; others do not
    hide later ones.
    """
    rows = lines(spark, path).filter("size(f) >= 12")
    rest = F.slice(F.col("f"), 13, F.greatest(F.size("f") - 12, F.lit(1)))
    rows = rows.select("ord", F.expr("f[0]").alias("name"), F.expr("cast(f[1] as int)").alias("length"), F.expr("cast(f[2] as int)").alias("start"), F.expr("cast(f[3] as int)").alias("stop"), F.expr("f[5]").alias("path"), F.expr("cast(f[7] as int)").alias("path_start"), F.expr("cast(f[9] as int)").alias("matches"), F.expr("cast(f[10] as int)").alias("block"), tag(rest, "cg").alias("cg"), tag(rest, "cs").alias("cs"), tag(rest, "dv").alias("dv"), tag(rest, "id").alias("id"))
    usable = rows.filter((F.col("length") >= least) & (F.col("stop") - F.col("start") >= least_span) & (F.col("cg").isNotNull() | F.col("cs").isNotNull()))
    first = usable.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("ord"))).filter("k = 1")
    return first.withColumn("ops", F.when(F.col("cg").isNotNull(), parse_cigar(F.col("cg"))).otherwise(parse_difference(F.col("cs")))).drop("k", "ord")


def gaf_stats(spark: SparkSession, path: str, nodes: DataFrame) -> DataFrame:
    """read, length, aligned, matches, dv, id of every record that touches a node that is not flank."""
    rows = lines(spark, path).filter("size(f) >= 12")
    rest = F.slice(F.col("f"), 13, F.greatest(F.size("f") - 12, F.lit(1)))
    inner = nodes.filter("class <> 'ref'").select("node")
    flat = rows.withColumn("node", F.explode(F.transform(parse_path(F.expr("f[5]")), lambda s: s["node"])))
    hit = flat.join(inner, "node", "left_semi").select("ord").distinct()
    return rows.join(hit, "ord").select(F.expr("f[0]").alias("read"), F.expr("cast(f[1] as int)").alias("length"), F.expr("cast(f[10] as int)").alias("aligned"), F.expr("cast(f[9] as int)").alias("matches"), tag(rest, "dv").alias("dv"), tag(rest, "id").alias("id"))


def expand_alignments(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """path_id, pos, node, start_pos, end_pos, read_pos of each covered node; flipped where most steps are reverse.

    records: name, path, path_start, start, ops. = and M cover; M does not move the end, which is that of the last = base. X, = and M move both
    sides, I the read, D the graph; other operations count for nothing. On a reverse step positions count from the node's end. Neighbouring
    visits of one node are one step. Records with a node that is not in `nodes` are left out.

    Operations and nodes both lie along the path, at the sums of what comes before them. Sorted by place once for all windows of a record, each
    stretch between two of these places has one operation and one node; a visit begins and ends where the node of the stretches changes.
    """
    per = Window.partitionBy("name")
    every, so_far = Window.unboundedFollowing, lambda w, to=0: w.rowsBetween(Window.unboundedPreceding, to)
    records = records.filter("name is not null")
    ops = records.select("name", F.col("path_start").alias("g"), F.col("start").alias("r"), F.posexplode("ops").alias("i", "o")).select("name", "g", "r", "i", "o.n", "o.op")
    ops = ops.filter((F.col("n") > 0) & F.col("op").isin("=", "M", "X", "D", "I"))
    moved = lambda *kinds: F.coalesce(F.sum(F.when(F.col("op").isin(*kinds), F.col("n"))).over(so_far(per.orderBy("i"), -1)), F.lit(0))
    ops = ops.select("name", "op", "n", (F.col("g") + moved("=", "M", "X", "D")).alias("at"), (F.col("r") + moved("I", "=", "M", "X")).alias("read")).filter("op in ('=', 'M')")

    steps = records.select("name", mostly_reverse(F.col("path")).alias("flip"), F.posexplode(parse_path(F.col("path"))).alias("k", "s")).select("name", "flip", "k", "s.node", "s.strand").join(small(nodes.select("node", "size")), "node", "left")
    in_order = per.orderBy("k")
    steps = steps.select("*", F.max(F.col("size").isNull()).over(so_far(in_order, every)).alias("unknown"), F.coalesce(F.sum("size").over(so_far(in_order, -1)), F.lit(0)).alias("at")).filter("not unknown")

    op, node = F.struct("op", "read", "at", (F.col("at") + F.col("n")).alias("stop")), F.struct("node", "strand", "size", "flip", "at")
    none = lambda t, c: F.lit(None).cast(t.select(c.alias("x")).schema["x"].dataType)
    places = steps.select("name", "at", "k", none(ops, op).alias("op"), node.alias("node")).unionByName(ops.select("name", "at", F.lit(None).cast("int").alias("k"), op.alias("op"), none(steps, node).alias("node")))
    along = per.orderBy("at", "k")
    seen = lambda c: F.last(c, ignorenulls=True).over(so_far(along))
    runs = places.select("name", "at", "k", F.lead("at").over(along).alias("next"), seen("op").alias("op"), seen("node").alias("node"))
    runs = runs.withColumn("stop", F.least("next", F.col("op.stop"), F.col("node.at") + F.col("node.size"))).filter("op is not null and node is not null and stop > at")

    new = F.col("before").isNull() | (F.col("before") != F.col("node.node"))
    first = F.struct("node", "at", (F.col("at") - F.col("node.at")).alias("place"), (F.col("op.read") + F.col("at") - F.col("op.at")).alias("read"))
    last = F.struct("at", (F.col("stop") - 1 - F.col("node.at")).alias("place"))
    nth = lambda to: F.sum(new.cast("int")).over(so_far(along, to))
    runs = runs.select("*", F.lag("node.node").over(along).alias("before"))
    visits = runs.select(F.coalesce(F.lead(new).over(along), F.lit(True)).alias("ends"), nth(0).alias("nth"), nth(every).alias("n"), "name", seen(F.when(new, first)).alias("first"), seen(F.when(F.col("op.op") == "=", last)).alias("last")).filter("ends")
    visits = visits.select("name", "nth", "n", "first.node.*", "first.read", F.col("first.place").alias("a"), F.when(F.col("last.at") >= F.col("first.at"), F.col("last.place")).otherwise(F.col("first.place")).alias("b"))
    place = lambda c: F.when(F.col("strand") == ">", F.col(c)).otherwise(F.col("size") - F.col(c))
    turned = lambda x, y: F.when(F.col("flip"), x).otherwise(y).cast("int")
    return visits.select(F.col("name").alias("path_id"), turned(F.col("n") - F.col("nth"), F.col("nth") - 1).alias("pos"), "node", turned(place("b"), place("a")).alias("start_pos"), turned(place("a"), place("b")).alias("end_pos"), F.col("read").cast("int").alias("read_pos"))


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """name, seq, qual of four-line records, by line number: a quality line may begin like a name.

    Line numbers come from the place within a partition and the sizes of the partitions before it, one row for each.
    """
    text = spark.read.text(path).withColumn("id", F.monotonically_increasing_id())
    text = text.select("value", F.shiftright("id", 33).alias("part"), F.col("id").bitwiseAND((1 << 33) - 1).alias("nth"))
    before = F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = text.groupBy("part").count().select("part", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = text.join(F.broadcast(sizes), "part").withColumn("line", F.col("nth") + F.col("before"))
    at = lambda k: F.max(F.when(F.col("line") % 4 == k, F.col("value")))
    rows = numbered.groupBy(F.floor(F.col("line") / 4).alias("record")).agg(at(0).alias("name"), at(1).alias("seq"), at(3).alias("qual"))
    return rows.filter("qual is not null").select(F.regexp_replace("name", "^@", "").alias("name"), "seq", "qual")


def calls(spark: SparkSession, path: str) -> DataFrame:
    """A wide calls table; NA and None are null, lists are split, rows of one variant are merged."""
    raw = spark.read.csv(path, sep="\t", header=True)
    clean = raw.select(*(F.when(F.col(c).isin("NA", "None", ""), None).otherwise(F.col(c)).alias(c) for c in raw.columns))
    sets = [c for c in ("reads_alt", "reads_ref", "haps_alt", "haps_ref") if c in raw.columns]
    others = [c for c in raw.columns if c not in sets and c != "variant"]
    clean = clean.withColumn("ord", F.monotonically_increasing_id())
    merged = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(F.split(c, ","), F.array().cast("array<string>")))))).alias(c) for c in sets]
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c) for c in others]  # the first row's that has one
    return clean.groupBy("variant").agg(*first, *merged)
