"""Variants of a graph: alleles from bubbles, reference traversals, positions and sequences, support by subreads, output rows.

A variant is its alternate allele, an array of nodes from one shared node to another (alt), named by its nodes.
nodes: node, size, seq, ref, rpos_min, rpos_max, rnode, class; edges: src, dst.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.functions import same_start
from stepweave.operators.graph import _settled, small
from stepweave.operators.paths import by_path, local_copy

ROUNDS = 4  # nodes that are added to a walk in one pass
DEPTH = 20  # nodes of a reference traversal that is still followed


def _region_steps(nodes: DataFrame, edges: DataFrame, near: int) -> tuple[DataFrame, DataFrame]:
    """Edges at, dst within one region (rnode), and edges start, at, dst out of it to where an allele may end; only of nodes from which an end can be reached.

    Which nodes lead to an end is found backwards from the ends, before any walk is made: a node is of one region, so a mark for each node will do.
    """
    own = nodes.select("node", "rnode", F.col("class").alias("kind"), F.col("rpos_min").alias("lo"), F.col("rpos_max").alias("hi"), "size")
    at, dst, first = (own.select(*(F.col(c).alias(f"{p}_{c}") for c in own.columns)) for p in ("at", "dst", "first"))
    ways = edges.select(F.col("src").alias("at_node"), F.col("dst").alias("dst_node")).join(at, "at_node").join(dst, "dst_node")
    ways = ways.select(F.col("at_node").alias("at"), F.col("dst_node").alias("dst"), F.col("at_rnode").alias("region"), "dst_rnode", "dst_kind", "dst_lo", "dst_hi")
    begun = edges.select(F.col("src").alias("at"), F.col("dst").alias("dst_node")).join(dst, "dst_node").select("at", F.col("dst_node").alias("dst"), F.col("at").alias("region"), "dst_rnode", "dst_kind", "dst_lo", "dst_hi")
    every = _settled(ways.unionByName(begun).filter("region is not null").distinct())  # a walk is in the region of its start, also at the start itself
    inside = F.col("dst_rnode").eqNullSafe(F.col("region"))
    gap = F.least(*(F.abs(F.col(f"dst_{c}") - F.col(f"first_{r}") - F.col("first_size")) for c, r in (("lo", "lo"), ("hi", "hi"))))
    ends = every.filter(~inside & (F.col("dst_kind") == "none")).join(first.filter("first_kind = 'none'"), F.col("region") == F.col("first_node")).filter(gap < near)
    ends = _settled(ends.select(F.col("region").alias("start"), "at", "dst").distinct())
    within = _settled(every.filter(inside).select("region", "at", "dst"))
    live = _settled(ends.select(F.col("start").alias("region"), "at").distinct())
    front = live
    while not front.isEmpty():
        back = within.join(front.withColumnRenamed("at", "dst"), ["region", "dst"]).select("region", "at").distinct()
        front = _settled(back.join(live, ["region", "at"], "left_anti"))
        live = _settled(live.unionByName(front))
    return within.join(live.withColumnRenamed("at", "dst"), ["region", "dst"], "left_semi").select(F.col("region").alias("start"), "at", "dst"), ends


def alleles(nodes: DataFrame, edges: DataFrame, near: int = 50, most: int | None = None) -> DataFrame:
    """variant, alt: walks that leave a none node, pass nodes of its region (rnode) and end at a none node beyond.

    Either position of the end must lie less than `near` bases from the start's end. A walk does not pass a node twice.
    The frontier is a table; a round adds one node to each walk, and the rounds end when no walk goes on. Only walks from which such an end can
    still be reached go on. ROUNDS of them run in one pass without a shuffle: a walk looks up what may follow its last node, and walks that have ended are
    kept beside those that go on. More than `most` walks in a round, if that is given, are an error: where k nodes of a region are all joined, there are about e k! of them.
    """
    nodes, edges = _settled(nodes), _settled(edges)  # they are read several times
    within, ends = _region_steps(nodes, edges, near)
    ways = within.withColumn("end", F.lit(False)).unionByName(ends.withColumn("end", F.lit(True)))
    ways = small(_settled(ways.groupBy("start", "at").agg(F.collect_set(F.struct("dst", "end")).alias("ways"))))
    stay = F.array(F.struct(F.lit(None).cast(nodes.schema["node"].dataType).alias("dst"), F.lit(True).alias("end")))
    onward = F.filter("ways", lambda x: F.when(x["end"], F.size("path") > 1).otherwise(~F.array_contains("path", x["dst"])))
    longer = F.when(F.col("x.dst").isNull(), F.col("path")).otherwise(F.concat("path", F.array("x.dst"))).alias("path")
    front = nodes.filter("class = 'none'").select(F.col("node").alias("start"), F.col("node").alias("at"), F.array("node").alias("path"), F.lit(False).alias("end")).distinct()
    spread, found = 4 * nodes.sparkSession.sparkContext.defaultParallelism, []
    while True:
        for _ in range(ROUNDS if most is None else 1):
            each = front.join(ways, ["start", "at"], "left").select("start", "at", "path", F.explode(F.when(F.col("end"), stay).otherwise(onward)).alias("x"))
            front = each.select("start", F.coalesce("x.dst", "at").alias("at"), longer, "x.end")
        front = _settled(front)
        found.append(front.filter("end").select(F.col("path").alias("alt")))
        front = front.filter("not end")
        if most is not None and front.limit(most + 1).count() > most:
            raise ValueError(f"more than {most} walks are open at once")
        if front.isEmpty():
            break
        front = front.repartition(spread, "path")
    return reduce(DataFrame.unionByName, found).select(F.array_join(F.col("alt").cast("array<string>"), "_").alias("variant"), "alt")


def _along(variants: DataFrame, nodes: DataFrame) -> DataFrame:
    return variants.select("variant", F.posexplode("alt").alias("i", "node"), (F.size("alt") - 1).alias("last")).join(nodes, "node")


def described(variants: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds copy, pos and alt_seq.

    copy is c2 for an allele with more c1 than c2 nodes (a c1 allele matters in the c2 copy), else c1. pos is the end of the first node
    on that copy; alt_seq joins the sequences of the inner nodes.
    """
    inner = F.array_sort(F.collect_list(F.when((F.col("i") > 0) & (F.col("i") < F.col("last")), F.struct("i", F.coalesce("seq", F.lit("")).alias("s")))))
    at = lambda c: F.max(F.when(F.col("i") == 0, F.col(c) + F.col("size")))
    balance = F.count_if(F.col("class") == "c1") - F.count_if(F.col("class") == "c2")
    rows = _along(variants, nodes).groupBy("variant").agg(balance.alias("b"), at("rpos_min").alias("low"), at("rpos_max").alias("high"), F.array_join(F.transform(inner, lambda x: x["s"]), "").alias("alt_seq"))
    copy = F.when(F.col("b") > 0, "c2").otherwise("c1")
    rows = rows.select("variant", copy.alias("copy"), F.when(copy == "c1", F.col("low")).otherwise(F.col("high")).alias("pos"), "alt_seq")
    return variants.join(rows, "variant")


def _to_stops(variants: DataFrame, step: DataFrame, depth: int) -> DataFrame:
    """stop, copy, at, left: the least number of steps, up to depth, from a node to a stop over nodes that a traversal of that copy may pass."""
    front = _settled(variants.select("copy", F.element_at("alt", -1).alias("stop")).distinct().select("stop", "copy", F.col("stop").alias("at"), F.lit(0).alias("left")))
    known = front
    for k in range(1, depth + 1):
        back = front.join(step.select(F.col("at").alias("src"), F.col("dst").alias("at"), "kind"), "at").filter((F.col("at") == F.col("stop")) | (F.col("kind") == "none") | (F.col("kind") == F.col("copy")))
        back = back.select("stop", "copy", F.col("src").alias("at")).distinct().withColumn("left", F.lit(k))
        front = _settled(back.join(known, ["stop", "copy", "at"], "left_anti"))
        if front.isEmpty():
            break
        known = _settled(known.unionByName(front))
    return known


def reference_traversals(variants: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = DEPTH) -> DataFrame:
    """variant, ref: walks from alt's first to its last node over none nodes and nodes of the variant's copy, of at most depth + 1 nodes.

    variants: variant, alt, copy. The frontier is a table that holds only walks which can still reach their end within the depth, by the number
    of steps that each node is away from it.
    """
    step = _settled(edges.join(nodes.select(F.col("node").alias("dst"), F.col("class").alias("kind")), "dst").select(F.col("src").alias("at"), "dst", "kind"))
    away = _to_stops(variants, step, depth).withColumnRenamed("at", "dst")
    first = F.element_at("alt", 1)
    front = variants.select("variant", "copy", F.element_at("alt", -1).alias("stop"), first.alias("at"), F.array(first).alias("path"))
    found = []
    for k in range(1, depth + 1):
        on = front.join(step, "at").withColumn("longer", F.concat("path", F.array("dst")))
        found.append(on.filter(F.col("dst") == F.col("stop")).select("variant", F.col("longer").alias("ref")))
        on = on.filter((F.col("dst") != F.col("stop")) & ((F.col("kind") == "none") | (F.col("kind") == F.col("copy"))))
        on = on.join(away, ["stop", "copy", "dst"]).filter(F.col("left") <= depth - k)
        front = _settled(on.select("variant", "copy", "stop", F.col("dst").alias("at"), F.col("longer").alias("path")))
        if front.isEmpty():
            break
    return reduce(DataFrame.unionByName, found).distinct()


def with_reference(variants: DataFrame, traversals: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds refs (all traversals, sorted) and ref_seq: the inner sequence of the first one whose inner nodes all lie on the reference, else of the last one; '' without any."""
    rows = traversals.select("variant", "ref", F.posexplode("ref").alias("i", "node"), (F.size("ref") - 1).alias("last")).join(nodes.select("node", "seq", F.col("ref").alias("on")), "node")
    inner = (F.col("i") > 0) & (F.col("i") < F.col("last"))
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(inner, F.struct("i", F.coalesce("seq", F.lit("")).alias("s"))))), lambda x: x["s"]), "")
    each = rows.groupBy("variant", "ref").agg(seq.alias("s"), F.coalesce(F.bool_and(F.when(inner, F.col("on") > 0)), F.lit(True)).alias("all_on"))
    best = each.groupBy("variant").agg(F.array_sort(F.collect_list("ref")).alias("refs"), F.min_by("s", F.when(F.col("all_on"), F.col("ref"))).alias("good"), F.max_by("s", "ref").alias("late"))
    none = F.array().cast(traversals.select(F.collect_list("ref")).schema[0].dataType)
    return variants.join(best, "variant", "left").withColumn("refs", F.coalesce("refs", none)).withColumn("ref_seq", F.coalesce("good", "late", F.lit(""))).drop("good", "late")


def support(steps: DataFrame, variants: DataFrame, k: int = 5, haplotypes: bool = False) -> DataFrame:
    """variant and arrays reads_alt, reads_ref (haps_alt, haps_ref with haplotypes): who takes the allele, and who a reference traversal.

    steps: path_id, pos, node, class of subreads; variants: variant, alt, copy, refs. Each visit of a variant's first node counts that
    has a next node and whose local copy, by the k nearest markers on both sides, is the variant's. What follows is compared up to the shorter
    one's end, and counts where it agrees with the allele or with reference traversals, but not with both.
    """
    most = variants.agg(F.max(F.greatest(F.size("alt"), F.coalesce(F.array_max(F.transform("refs", lambda r: F.size(r))), F.lit(0))))).first()[0] or 1
    ahead = steps.select("path_id", "pos", "node", F.collect_list("node").over(by_path().rowsBetween(0, most - 1)).alias("rest"))
    here = ahead.filter(F.size("rest") > 1).join(local_copy(steps, k).select("path_id", "pos", "copy"), ["path_id", "pos"])
    both = here.join(variants.select("variant", "copy", "alt", "refs", F.element_at("alt", 1).alias("node")), ["node", "copy"])
    alt, ref = same_start(F.col("rest"), F.col("alt")), F.exists("refs", lambda r: same_start(F.col("rest"), r))
    seen = both.select("variant", "path_id", (alt & ~ref).alias("a"), (ref & ~alt).alias("r"))
    kind = "haps" if haplotypes else "reads"
    lists = seen.groupBy("variant").agg(F.array_sort(F.collect_set(F.when(F.col("a"), F.col("path_id")))).alias(f"{kind}_alt"), F.array_sort(F.collect_set(F.when(F.col("r"), F.col("path_id")))).alias(f"{kind}_ref"))
    return variants.select("variant").join(lists, "variant", "left")


def annotation_keys(notes: DataFrame, offset: int = 0) -> DataFrame:
    """pos, alt, clinsig, ord of notes (start, ref, alt, id, nuc.change, prot.change, ord): a padding base that both alleles share is stripped."""
    padded = F.substring("ref", 1, 1) == F.substring("alt", 1, 1)
    rest = lambda c: F.when(padded, F.expr(f"substring({c}, 2)")).otherwise(F.col(c))
    pos = F.col("start") - offset + F.when(padded, 1).otherwise(0)
    return notes.select(pos.cast("long").alias("pos"), rest("alt").alias("alt"), F.concat_ws("_", "id", "`nuc.change`", "`prot.change`").alias("clinsig"), "ord")


def with_annotation(variants: DataFrame, notes: DataFrame, offset: int = 0) -> DataFrame:
    """Adds clinsig of the last note that begins at the variant's pos and has its alternate sequence; the reference allele is not compared."""
    last = annotation_keys(notes, offset).groupBy("pos", F.col("alt").alias("alt_seq")).agg(F.max_by("clinsig", "ord").alias("clinsig"))
    return variants.join(last, ["pos", "alt_seq"], "left")


def offset_positions(variants: DataFrame, offset: int) -> DataFrame:
    end = [(F.col("end") + offset).alias("end")] if "end" in variants.columns else []
    return variants.select(*(c for c in variants.columns if c not in ("pos", "end")), (F.col("pos") + offset).alias("pos"), *end)


def fusion_info(fusions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds pos, end, pos_error and ref_seq to fusions (variant, copy, alt of two nodes): midpoints of the two nodes, halves to even.

    A fusion on c1 begins at the lesser positions and ends at the greater ones, one on c2 the other way round.
    """
    side = lambda k: nodes.select(F.col("node").alias(f"n{k}"), F.col("rpos_min").alias(f"lo{k}"), F.col("rpos_max").alias(f"hi{k}"), F.col("seq").alias(f"s{k}"))
    rows = fusions.withColumn("n1", F.element_at("alt", 1)).withColumn("n2", F.element_at("alt", 2)).join(side(1), "n1").join(side(2), "n2")
    mid = lambda a, b: F.bround((F.col(a) + F.col(b)) / 2, 0).cast("long")
    low, high, first = mid("lo1", "lo2"), mid("hi1", "hi2"), F.col("copy") == "c1"
    error = F.bround((F.abs(F.col("lo1") - F.col("lo2")) + F.abs(F.col("hi1") - F.col("hi2"))) / 4, 0).cast("long")
    return rows.select(*fusions.columns, F.when(first, low).otherwise(high).alias("pos"), F.when(first, high).otherwise(low).alias("end"), error.alias("pos_error"), F.col("s1").alias("ref_seq"))


def union_calls(one: DataFrame, two: DataFrame) -> DataFrame:
    """Both collections of calls; of a variant in both, the second one's row stays. Columns that one lacks are null."""
    return one.join(two.select("variant"), "variant", "left_anti").unionByName(two, allowMissingColumns=True)


def _has(table: DataFrame, column: str, kind: str) -> Column:
    return F.col(column).cast(kind) if column in table.columns else F.lit(None).cast(kind)


def _end(table: DataFrame) -> Column:
    return F.coalesce(_has(table, "end", "long"), F.col("pos") + F.length("ref_seq"))


def call_rows(calls: DataFrame) -> DataFrame:
    """The 13 columns of a calls table as text, by pos; lists are joined by commas, what is missing is NA (None for clinsig).

    node is the allele's second node, or its only one; a fusion, known by its pos_error, also has its first node. A pos of 0 is missing.
    """
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(F.col(c).cast("array<string>"), ",")) if c in calls.columns else F.lit(None)
    error = _has(calls, "pos_error", "long")
    columns = {
        "variant": F.col("variant"), "pos": F.when(F.col("pos") != 0, F.col("pos")), "end": _end(calls), "node": F.element_at("alt", F.least(F.size("alt"), F.lit(2))),
        "clinsig": F.coalesce(_has(calls, "clinsig", "string"), F.lit("None")), "copy": F.col("copy"), "fusion_start_node": F.when(error.isNotNull(), F.element_at("alt", 1)), "pos_ci": error,
        "supp_reads": F.greatest(F.size("reads_alt"), F.lit(0)), **{c: listed(c) for c in ("reads_alt", "reads_ref", "haps_alt", "haps_ref")},
    }
    return calls.orderBy("pos", "variant").select(*(F.coalesce(c.cast("string"), F.lit("NA")).alias(n) for n, c in columns.items()))


def deconstruct_rows(calls: DataFrame) -> DataFrame:
    """The ten columns of a deconstruct table as text, by pos: traversals joined by _, several reference traversals by -."""
    trail = lambda c: F.array_join(c.cast("array<string>"), "_")
    columns = {
        "variant": F.col("variant"), "pos": F.coalesce(F.when(F.col("pos") != 0, F.col("pos")).cast("string"), F.lit("NA")), "end": _end(calls), "node": F.element_at("alt", 1),
        "ref_trav": F.array_join(F.transform("refs", trail), "-"), "ref_seq": F.col("ref_seq"), "alt_trav": trail(F.col("alt")), "alt_seq": F.col("alt_seq"), "copy": F.col("copy"), "clinsig": F.coalesce(_has(calls, "clinsig", "string"), F.lit("None")),
    }
    return calls.orderBy("pos", "variant").select(*(c.cast("string").alias(n) for n, c in columns.items()))


def vcf_header(chrom: str, length: int) -> list[str]:
    field = lambda kind, name, n, type_, text: f'##{kind}=<ID={name},Number={n},Type={type_},Description="{text}">'
    known = [("RREF", 1, "Integer", "Reads with the reference allele"), ("RALT", 1, "Integer", "Reads with the alternate allele"), ("MALT", ".", "String", "Haplotypes with the alternate allele"), ("END", 1, "Integer", "End of a fusion"), ("CLIN", 1, "String", "Known variant"), ("SVLEN", ".", "Integer", "Length of a fusion"), ("SVTYPE", 1, "String", "Kind of a fusion")]
    return ["##fileformat=VCFv4.2", f"##contig=<ID={chrom},length={length}>", *(field("INFO", *k) for k in known), field("FORMAT", "GT", 1, "String", "Genotype"), "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "SAMPLE"])]


def vcf_body(calls: DataFrame, chrom: str, genome: Column) -> DataFrame:
    """VCF lines (value) by pos; genome is the chromosome's sequence as a column, of which base 1 is that of pos 1.

    Where the chromosome's base at pos is not the reference allele's first, an empty allele makes both take the base before, with pos one
    less; or, if the base is the alternate allele, the two are swapped and the genotype is 0/0. A fusion (it has an end) is a
    deletion <DEL> from the base after pos.
    """
    end, ref, alt = _has(calls, "end", "long"), F.coalesce("ref_seq", F.lit("")), F.coalesce(_has(calls, "alt_seq", "string"), F.lit(""))
    at = lambda p: F.substring(genome, p.cast("int"), F.lit(1))
    odd = (ref == "") | (at(F.col("pos")) != F.substring(ref, 1, 1))
    pad = odd & end.isNull() & ((ref == "") | (alt == ""))
    swap = odd & ~pad & (at(F.col("pos")) == alt)
    before = at(F.col("pos") - 1)
    one = F.when(pad, F.concat(before, ref)).when(swap, alt).otherwise(ref)
    two = F.when(end.isNotNull(), F.lit("<DEL>")).when(pad, F.concat(before, alt)).when(swap, ref).otherwise(alt)
    pos = F.col("pos") + F.when(end.isNotNull(), 1).when(pad, -1).otherwise(0)
    number = lambda c: F.greatest(F.size(c), F.lit(0))
    haps = [F.when(F.size("haps_alt") > 0, F.concat(F.lit("MALT="), F.array_join(F.col("haps_alt").cast("array<string>"), ",")))] if "haps_alt" in calls.columns else []
    sv = F.when(end.isNotNull(), F.concat(F.lit("SVTYPE=DEL;END="), end, F.lit(";SVLEN="), end - F.col("pos") + 1))
    info = F.concat_ws(";", sv, F.concat(F.lit("CLIN="), _has(calls, "clinsig", "string")), F.concat(F.lit("RREF="), number("reads_ref")), F.concat(F.lit("RALT="), number("reads_alt")), *haps)
    line = F.concat_ws("\t", F.lit(chrom), pos, "variant", F.when(end.isNotNull(), F.substring(one, 1, 1)).otherwise(one), two, F.lit("30"), F.lit("PASS"), info, F.lit("GT"), F.when(swap, "0/0").otherwise("0/1"))
    return calls.orderBy("pos", "variant").select(line.alias("value"))
