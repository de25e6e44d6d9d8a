"""Embedding near-duplicates: inverted lists over product-quantised residuals, asymmetric distances, exact cosine at the end."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import materialize, small_batches
from stepweave.llm.graph import components

SAMPLE = 16_384  # vectors that the quantisers are fitted on, at most
PER_LIST = 256  # vectors that a list shall hold about
PARTS, CODES = 8, 64  # subspaces and codewords in each
BLOCK = 1024  # members and queries that one group holds, at most
REACHED = 0.995  # share of trial neighbours at the threshold whose list must be among the probed ones


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (x @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        count = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(count > 0, total / np.maximum(count, 1), centres)
    return centres


class Quantiser:
    """Coarse centres and, for residuals, a codebook in each subspace. Fitted on unit vectors."""

    def __init__(self, sample: np.ndarray, n: int, threshold: float, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.threshold, dim = threshold, sample.shape[1]
        self.centres = k_means(sample, max(1, min(n // PER_LIST, len(sample) // 8)), rng)
        rest = sample - self.centres[self.nearest(sample, 1)[:, 0]]
        self.cuts = np.linspace(0, dim, min(PARTS, dim) + 1).astype(int)
        self.books = [k_means(rest[:, a:b], min(CODES, len(rest)), rng, 6) for a, b in zip(self.cuts[:-1], self.cuts[1:])]
        self.probes = self._probes(sample[: 4096], rng)

    def nearest(self, x: np.ndarray, k: int) -> np.ndarray:
        score = x @ self.centres.T - 0.5 * (self.centres**2).sum(axis=1)
        k = min(k, len(self.centres))
        top = np.argpartition(-score, k - 1, axis=1)[:, :k]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable"), 1)

    def _probes(self, x: np.ndarray, rng: np.random.Generator) -> int:
        """Lists to probe: random neighbours at exactly the threshold's angle show how far down a query's ranking their lists lie."""
        noise = rng.normal(size=x.shape)
        noise -= (noise * x).sum(axis=1, keepdims=True) * x
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        other = self.threshold * x + np.sqrt(1 - self.threshold**2) * noise
        own = self.nearest(other, 1)
        rank = (self.nearest(x, len(self.centres)) == own).argmax(axis=1)
        return int(np.quantile(rank, REACHED)) + 1

    def encode(self, x: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the length of what the codes leave of each."""
        rest = x - self.centres[near]
        codes = np.stack([(rest[:, a:b] @ k.T - 0.5 * (k**2).sum(axis=1)).argmax(axis=1) for a, b, k in zip(self.cuts[:-1], self.cuts[1:], self.books)], axis=1).astype(np.uint8)
        back = np.concatenate([k[codes[:, i]] for i, k in enumerate(self.books)], axis=1)
        return codes, np.linalg.norm(rest - back, axis=1)

    def tables(self, x: np.ndarray, centre: int) -> np.ndarray:
        """Squared distances of each query's residual to every codeword: query, part, code."""
        rest = x - self.centres[centre]
        return np.stack([((rest[:, None, a:b] - k[None]) ** 2).sum(axis=2) if len(k) == len(self.books[0]) else np.zeros((len(x), len(self.books[0]))) for a, b, k in zip(self.cuts[:-1], self.cuts[1:], self.books)], axis=1)


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _placed(shared):
    """A row as a member of its own list, and one as a query of each probed list."""

    def rows(batches):
        q = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_matrix(batch.column("v")))
            lists = q.nearest(x, q.probes)
            codes, error = q.encode(x, lists[:, 0])
            n, k = lists.shape
            none = pa.nulls(n * k, pa.binary())
            i = pa.array(np.repeat(np.arange(n), k))
            near = pa.array(lists.tolist(), pa.list_(pa.int64()))
            member = pa.RecordBatch.from_arrays([pa.array(lists[:, 0]), batch.column("rep"), batch.column("copies"), pa.array(np.zeros(n, np.int32)), batch.column("v"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), near], names=_NAMES)
            query = pa.RecordBatch.from_arrays([pa.array(lists.ravel()), batch.column("rep").take(i), batch.column("copies").take(i), pa.array(np.ones(n * k, np.int32)), batch.column("v").take(i), none, pa.array(np.zeros(n * k)), near.take(i)], names=_NAMES)
            yield member
            yield query

    return rows


_NAMES = ["list", "rep", "copies", "role", "v", "codes", "error", "probed"]


def _links(shared):
    """Links between a block of queries and a block of members of one list: for each query how many, and a forest that connects them.

    A pair is a candidate unless its asymmetric distance, less what the member's codes leave out, exceeds the
    threshold's distance: by the triangle inequality no link is lost to the codes. Candidates get exact cosines.
    """

    def links(key, table):
        q = shared.value
        centre = key[0].as_py()
        role = table["role"].to_numpy()
        rep, copies = table["rep"].to_numpy(), table["copies"].to_numpy()
        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        members, queries = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        if not len(members) or not len(queries):
            return empty
        x = _unit(_matrix(table["v"].combine_chunks()))
        codes = np.frombuffer(b"".join(table["codes"].take(pa.array(members)).to_pylist()), np.uint8).reshape(len(members), -1)
        error = table["error"].to_numpy()[members]
        most = np.sqrt(2 - 2 * q.threshold)
        count, back, parent, found = np.zeros(len(queries), np.int64), np.zeros(len(members), np.int64), {}, []
        probed = _matrix(table["probed"].combine_chunks())

        def root(v):
            while parent.setdefault(v, v) != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        for s in range(0, len(queries), 256):
            own = queries[s : s + 256]
            lut = q.tables(x[own], centre)
            squared = np.zeros((len(own), len(members)))
            for part in range(codes.shape[1]):
                squared += lut[:, part, codes[:, part]]
            i, j = np.nonzero(np.sqrt(np.maximum(squared, 0)) - error[None] <= most + 1e-7)
            same = rep[own[i]] != rep[members[j]]
            i, j = i[same], j[same]
            good = np.concatenate([(x[own[i[k : k + 65536]]] * x[members[j[k : k + 65536]]]).sum(axis=1) >= q.threshold for k in range(0, len(i), 65536)]) if len(i) else np.zeros(0, bool)
            i, j = i[good], j[good]
            np.add.at(count, s + i, copies[members[j]])
            only = (probed[members[j]] != probed[own[i], :1]).all(axis=1)  # the member does not probe the query's list
            np.add.at(back, j[only], copies[own[i[only]]])
            for a, b in zip(rep[own[i]].tolist(), rep[members[j]].tolist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        found = [(v, root(v)) for v in list(parent) if root(v) != v]
        some, more = np.flatnonzero(count), np.flatnonzero(back)
        a = np.concatenate([rep[queries[some]], rep[members[more]], np.array([f[0] for f in found], np.int64)])
        b = np.concatenate([rep[queries[some]], rep[members[more]], np.array([f[1] for f in found], np.int64)])
        n = np.concatenate([count[some], back[more], np.zeros(len(found), np.int64)])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    return links


def _searched(good: DataFrame, threshold: float) -> DataFrame:
    """v, n, c of each distinct vector: links and component; all vectors are of one length."""
    spark = good.sparkSession
    distinct, _ = materialize(good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "distinct")
    n = distinct.count()
    sample = distinct.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").toPandas()["v"]
    quantiser = Quantiser(_unit(np.stack([np.asarray(v, float) for v in sample])), n, threshold)
    shared = spark.sparkContext.broadcast(quantiser)
    kind = "list long, rep long, copies long, role int, v array<double>, codes binary, error double, probed array<long>"
    placed, _ = materialize(distinct.select("v", "rep", "copies").mapInArrow(_placed(shared), kind), "placed")
    size = placed.groupBy("list").agg(F.sum(F.expr("1 - role")).alias("m"), F.sum("role").alias("q"))
    size = size.select("list", F.ceil(F.col("m") / BLOCK).cast("int").alias("mb"), F.ceil(F.col("q") / BLOCK).cast("int").alias("qb")).filter("mb > 0")
    block = F.pmod(F.xxhash64("rep"), F.when(F.col("role") == 0, F.col("mb")).otherwise(F.col("qb"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("role") == 0, F.col("qb")).otherwise(F.col("mb")) - 1)
    dealt = placed.join(size, "list").withColumn("own", block).withColumn("other", F.explode(others))
    dealt = dealt.withColumn("member_block", F.expr("if(role = 0, own, other)")).withColumn("query_block", F.expr("if(role = 0, other, own)"))
    found = dealt.select("list", "member_block", "query_block", *_NAMES[1:]).groupBy("list", "member_block", "query_block").applyInArrow(_links(shared), "a long, b long, n long")
    found, _ = materialize(found, "found")
    counted = found.filter("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    linked = components(found.filter("a <> b").select("a", "b")).withColumnRenamed("node", "rep")
    return distinct.join(counted, "rep", "left").join(linked, "rep", "left").select("v", F.expr("coalesce(others, 0) + copies - 1").alias("n"), F.coalesce("component", "rep").alias("c"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector; two link at a cosine of at least the threshold, in double precision.

    Vectors that are null, zero, or with null or non-finite components link with nothing.
    Each length is a group of its own, searched one after the other. A link found from one side counts for both.
    Equal vectors are one in the search and count as links of each other; an empty table gives an empty result.
    Lists larger than BLOCK are split into blocks of members and of queries, so that a hot list is many groups of bounded
    size. Rows that repeat a vec_id count as copies of their vector. Columns other than vec_id and embedding are not read.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    usable = F.coalesce(finite & F.exists("v", lambda e: e != 0) & (F.size("v") > 0), F.lit(False)) & F.col("vec_id").isNotNull()
    marked, _ = materialize(rows.select("vec_id", F.when(usable, F.transform("v", lambda e: e + 0.0)).alias("v")), "vectors")
    dims = [d[0] for d in marked.filter("v is not null").groupBy(F.size("v").alias("dim")).count().filter("count > 1").orderBy("dim").collect()]
    alone = marked.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not dims:
        return alone
    by_vector = reduce(DataFrame.unionByName, [_searched(marked.filter(F.size("v") == d), threshold) for d in dims])
    out = marked.join(by_vector, "v", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
