"""Graph operators over edges (src, dst): paths between nodes, reachability, edges that exclude each other, node classes."""

from __future__ import annotations

import tempfile
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _settled(df: DataFrame) -> DataFrame:
    """A checkpoint, from which later rounds restart: in spark.checkpoint.dir, or, if that is unset and Spark runs in one process, in a temporary folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None and (folder := df.sparkSession.conf.get("spark.checkpoint.dir", "")):
        context.setCheckpointDir(folder)
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="stepweave-"))
    return df.checkpoint()


def small(df: DataFrame, most: int = 1 << 18) -> DataFrame:
    """df, to be broadcast if it is counted and found to have `most` rows at most; else joins shuffle it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def bubbles(edges: DataFrame, inner: DataFrame, most: int | None = 4) -> DataFrame:
    """Walks that leave a node, pass one to `most` nodes of `inner` (node) once each, and end outside it: path (array), dst.

    A loop of joins, one for each length; the frontier stays a table, walks that close on themselves are dropped. With
    most=None the loop ends when no walk is left; where k inner nodes are all joined, that is after about e k! walks.
    """
    into = edges.join(inner.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")
    out = edges.join(inner.withColumnRenamed("node", "dst"), "dst", "left_anti").select(F.col("src").alias("at"), "dst")
    front = edges.join(inner.withColumnRenamed("node", "src"), "src", "left_anti").join(inner.withColumnRenamed("node", "dst"), "dst", "left_semi")
    front = front.select(F.col("dst").alias("at"), F.array("src", "dst").alias("path"))
    found = None
    for _ in count() if most is None else range(most):
        if most is None:
            front = _settled(front)
            if found is not None and front.isEmpty():
                break
        closed = front.join(out, "at").select("path", "dst")
        found = closed if found is None else found.unionByName(closed)
        front = front.join(into, F.col("at") == F.col("src")).filter(~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"))
    return found


def reachable(edges: DataFrame, most: int | None = 3) -> DataFrame:
    """src, dst, steps: nodes that can be reached in 1 to `most` steps, with the least number of steps; semi-naive rounds.

    With most=None the rounds go on until none finds a new pair: the whole closure.
    """
    edges = _settled(edges) if most is None else edges
    known = edges.select("src", "dst", F.lit(1).alias("steps")).distinct()
    front = known
    for k in count(2) if most is None else range(2, most + 1):
        step = front.select("src", F.col("dst").alias("mid")).join(edges.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        front = step.join(known, ["src", "dst"], "left_anti").withColumn("steps", F.lit(k))
        if most is None:
            front = _settled(front)
            if front.isEmpty():
                break
        known = known.unionByName(front)
        if most is None:
            known = _settled(known)
    return known


def follow(steps: DataFrame, starts: DataFrame) -> DataFrame:
    """at, hops: where walks from `starts` (at) come, when each place has one step on (at, to), and after how many steps first.

    By doubling: each round joins the places reached with jumps of twice the length, so a walk of n steps takes log n
    rounds. Walks end where there is no step, or where they come round to where they have been; walks that meet go on as one.
    """
    jump = _settled(steps.select("at", "to"))
    reached, length = _settled(starts.select("at", F.lit(0).cast("long").alias("hops")).distinct()), 1
    while True:
        more = reached.join(jump, "at").select(F.col("to").alias("at"), (F.col("hops") + length).alias("hops"))
        more = _settled(more.join(reached.select("at"), "at", "left_anti").groupBy("at").agg(F.min("hops").alias("hops")))
        if more.isEmpty():
            return reached
        reached = _settled(reached.unionByName(more))
        jump = _settled(jump.withColumnRenamed("to", "mid").join(jump.select(F.col("at").alias("mid"), "to"), "mid").select("at", "to"))
        length *= 2


def _to_block_ends(steps: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """For each entry of a block where its walk leaves the block, and after how many steps; nothing where it does not."""
    k = (steps.shape[1] - 2) // 2  # fields of a place
    rows = [steps[c].tolist() for c in steps.columns]
    step = dict(zip(zip(*rows[:k]), zip(zip(*rows[k : 2 * k]), *rows[2 * k :])))
    out, found = {}, []
    for at in zip(*(entries[c].tolist() for c in entries.columns[:k])):
        walk, end = [], at
        while end in step and end not in out:
            out[end] = None  # where the walk comes round to itself
            walk.append(end)
            to, block, to_block = step[end]
            if block != to_block:
                out[end] = (to, to_block, 1)
                break
            end = to
        known = out.get(end)
        for place in reversed(walk):
            if place != end or known is None:
                known = out[place] = known and (*known[:2], known[2] + 1)
        if out.get(at):
            to, to_block, n = out[at]
            found.append((*at, *to, to_block, n))
    return pd.DataFrame(found, columns=[*entries.columns[:k], *steps.columns[k : 2 * k], "to_block", "n"])


def _through_block(steps: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """The places of a block on walks from the entries reached, with the fewest steps."""
    k = entries.shape[1] - 2
    inside = steps[steps["block"] == steps["to_block"]]
    rows = [inside[c].tolist() for c in inside.columns[: 2 * k]]
    step, best = dict(zip(zip(*rows[:k]), zip(*rows[k:]))), {}
    for *at, hops in sorted(zip(*(entries[c].tolist() for c in [*entries.columns[:k], "hops"])), key=lambda e: e[-1]):
        at = tuple(at)
        while at is not None and (at not in best or hops < best[at]):
            best[at] = hops
            at, hops = step.get(at), hops + 1
    return pd.DataFrame([(*at, hops) for at, hops in best.items()], columns=[*entries.columns[:k], "hops"])


def follow_in_blocks(steps: DataFrame, starts: DataFrame) -> DataFrame:
    """at, hops: as follow() for steps (at, to, block, to_block) and starts (at, block), where at and to are structs, and each place is in one block.

    Blocks are of a bounded number of places. Walks are followed within each block by one task; only the places by which they come into a
    block are joined in rounds, by doubling. Right for any blocks, and quick where few steps lead from one to another, as along a reference.
    """
    names = steps.schema["at"].dataType.names
    flat = lambda c: [F.col(f"{c}.{n}").alias(f"{c}_{i}") for i, n in enumerate(names)]
    place = lambda c: F.struct(*(F.col(f"{c}_{i}").alias(n) for i, n in enumerate(names))).alias(c)
    steps = _settled(steps.select("at", "to", "block", "to_block"))
    starts = _settled(starts.select("at", "block").distinct())
    entries = _settled(starts.unionByName(steps.filter("block <> to_block").select(F.col("to").alias("at"), F.col("to_block").alias("block"))).distinct())
    rows = steps.select(*flat("at"), *flat("to"), "block", "to_block")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    ats, tos = ([f"{c}_{i}" for i in range(len(names))] for c in ("at", "to"))
    own = rows.groupBy("block").cogroup
    ends = own(entries.select(*flat("at"), "block").groupBy("block")).applyInPandas(_to_block_ends, ", ".join(f"{c} {kind[c]}" for c in [*ats, *tos]) + ", to_block long, n long")
    jump = _settled(ends.select(place("at"), place("to"), "n"))
    reached = starts.select("at", F.lit(0).cast("long").alias("hops"))
    while True:
        more = reached.join(jump, "at").select(F.col("to").alias("at"), (F.col("hops") + F.col("n")).alias("hops"))
        both = _settled(reached.unionByName(more).groupBy("at").agg(F.min("hops").alias("hops")))
        if both.join(reached, ["at", "hops"], "left_anti").isEmpty():
            break
        reached = both
        jump = _settled(jump.withColumnsRenamed({"to": "mid", "n": "m"}).join(jump.select(F.col("at").alias("mid"), "to", "n"), "mid").select("at", "to", (F.col("m") + F.col("n")).alias("n")))
    told = reached.join(entries, "at").select(*flat("at"), "block", "hops")
    walked = own(told.groupBy("block")).applyInPandas(_through_block, ", ".join(f"{c} {kind[c]}" for c in ats) + ", hops long")
    return walked.select(place("at"), "hops")


def exclusive_pairs(edges: DataFrame, reach: DataFrame) -> DataFrame:
    """All pairs of edges that no walk passes both of: src1, dst1 < src2, dst2. reach: the whole closure, reachable(edges, None).

    Two edges exclude each other if neither one's end is or reaches the other's beginning. Ends that cannot reach a beginning are listed once, as
    pairs of nodes; edges are joined to that list by equal nodes, so only pairs that pass the first test are made.
    """
    e = _settled(edges.select("src", "dst").distinct())
    one, two = (e.select(F.col("src").alias(f"src{i}"), F.col("dst").alias(f"dst{i}")) for i in (1, 2))
    ends, begins = e.select(F.col("dst").alias("f")).distinct(), e.select(F.col("src").alias("t")).distinct()
    apart = ends.crossJoin(small(begins)).filter("f <> t").join(reach.select(F.col("src").alias("f"), F.col("dst").alias("t")), ["f", "t"], "left_anti")
    apart = _settled(apart)
    pairs = one.join(apart.withColumnsRenamed({"f": "dst1", "t": "src2"}), "dst1").join(two, "src2").filter("struct(src1, dst1) < struct(src2, dst2)")
    return pairs.join(apart.withColumnsRenamed({"f": "dst2", "t": "src1"}), ["dst2", "src1"], "left_semi").select("src1", "dst1", "src2", "dst2")


def classify(counts: DataFrame, fold: int = 3) -> DataFrame:
    """class from c1, c2, ref counts: c1 if c1 > fold c2, else c2 if c2 > fold c1, else ref if only ref, else none."""
    c = F.when(F.col("c1") > fold * F.col("c2"), "c1").when(F.col("c2") > fold * F.col("c1"), "c2").when((F.col("ref") > 0) & (F.col("c1") == 0) & (F.col("c2") == 0), "ref").otherwise("none")
    return counts.withColumn("class", c)


def class_summary(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean_size"), F.sum("size").alias("bp"))
