"""All pairs of members of a group (subreads, say) compared on the markers that both hold, in blocks of members.

Where most pairs share markers, a join on the marker makes a row for each pair and marker. Here members are dealt to blocks by a hash, each member goes to
every pair of blocks that its own is in, and a task compares one pair of blocks by matrix products and yields its pairs in slices. What is shuffled is
members times blocks, not pairs; a task's memory is that of two blocks. Where few pairs share a marker, the join makes fewer rows than there are pairs, and is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepweave.operators.graph import _settled, small

BLOCK = 4096  # members of a block at most, about
LEAST = 256  # and at least, if there are not enough for so many blocks that all cores have work
SPREAD = 16  # blocks of a group, if it has members enough for them
SLICE = 256  # members of one block that are compared with all of the other at once
CODES = 1024  # markers that are multiplied at once


def dense(observed: DataFrame, by: list[str]) -> bool:
    """Whether a join on the marker would make more than a quarter as many rows as there are pairs."""
    pairs = lambda t: t.agg(F.sum(F.col("k") * (F.col("k") - 1))).first()[0] or 0.0
    joined = pairs(observed.groupBy(*by, "marker").agg(F.count(F.lit(1)).cast("double").alias("k")))
    return 4 * joined > pairs(observed.select(*by, "id").distinct().groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("k")))


def members(observed: DataFrame, by: list[str], block: int = BLOCK) -> DataFrame:
    """by, id, blocks, block, ms, vs: each member with the numbers of its markers and of its (marker, allele) pairs, its block, and its group's number of blocks.

    observed: by, id, marker, allele, each marker once for a member. A null allele (-1) agrees with none.
    """
    number = lambda t, name: _settled(t.distinct().withColumn(name, F.monotonically_increasing_id()))
    codes = number(observed.select("marker", "allele"), "v").join(small(number(observed.select("marker"), "m")), "marker")
    codes = codes.withColumn("v", F.when(F.col("allele").isNotNull(), F.col("v")).otherwise(-1)).withColumnsRenamed({"marker": "_marker", "allele": "_allele"})
    rows = observed.join(small(codes), (F.col("marker") == F.col("_marker")) & F.col("allele").eqNullSafe(F.col("_allele")))
    rows = _settled(rows.groupBy(*by, "id").agg(F.collect_list("m").alias("ms"), F.collect_list("v").alias("vs")))
    size = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_k"))
    blocks = F.greatest(F.ceil(F.col("_k") / block), F.least(F.lit(SPREAD), F.ceil(F.col("_k") / min(LEAST, block)))).cast("int")
    rows = rows.join(size, by) if by else rows.crossJoin(F.broadcast(size))  # one row
    return rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("_k")


def _met(rows: DataFrame, by: list[str]) -> DataFrame:
    """Members once for each pair of blocks (i <= j) with their own, side 1 for those of j if it is another block; in as many partitions as there are pairs."""
    n = rows.select(*by, "blocks").distinct().agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2)).first()[0] or 1
    met = rows.withColumn("_y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"i": F.least("block", "_y"), "j": F.greatest("block", "_y"), "side": (F.col("block") > F.col("_y")).cast("int")})
    return met.drop("_y", "block", "blocks").repartition(int(min(n, 5000)), *by, "i", "j")


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of each entry of a column of lists."""
    return np.repeat(np.arange(len(column)), pc.list_value_length(column).to_numpy(zero_copy_only=False)), column.flatten().to_numpy(zero_copy_only=False)


def _together(one: pa.Table, two: pa.Table, column: str) -> np.ndarray:
    """How many values of a column of lists each row of one and each of two have in common; markers are multiplied CODES at a time."""
    (r1, c1), (r2, c2) = (_flat(t.column(column).combine_chunks()) for t in (one, two))
    r1, c1, r2, c2 = r1[c1 >= 0], c1[c1 >= 0], r2[c2 >= 0], c2[c2 >= 0]
    known = np.intersect1d(c1, c2)
    out = np.zeros((len(one), len(two)), dtype=np.float32)  # whole numbers under 2^24
    for k in range(0, len(known), CODES):
        some = known[k : k + CODES]
        sides = []
        for r, c, n in ((r1, c1, len(one)), (r2, c2, len(two))):
            at = np.minimum(np.searchsorted(some, c), len(some) - 1)
            hit = some[at] == c
            x = np.zeros((n, len(some)), dtype=np.float32)
            x[r[hit], at[hit]] = 1
            sides.append(x)
        out += sides[0] @ sides[1].T
    return out


def _compared(batches: Iterator[pa.RecordBatch], same: bool) -> tuple[pa.Table, pa.Table, np.ndarray, np.ndarray | None] | None:
    """Both blocks of a pair, with the numbers of markers and of alleles in common; of a block with itself only the pairs above the diagonal have any."""
    table = pa.Table.from_batches(list(batches))
    one, two = table.filter(pc.equal(table["side"], 0)), table.filter(pc.equal(table["side"], 1))
    own = table["i"][0].as_py() == table["j"][0].as_py()
    two = one if own else two
    common = _together(one, two, "ms")
    if own:
        common[np.tril_indices(len(one))] = 0
    return one, two, common, _together(one, two, "vs") if same else None


def _keys(key: tuple, by: list[str], n: int) -> list[pa.Array]:
    return [pa.repeat(k, n) for k in key[: len(by)]]


def _schema(rows: DataFrame, by: list[str], **columns: str) -> str:
    kinds = {c: rows.schema[c].dataType.simpleString() for c in [*by, "id"]}
    return ", ".join([*(f"`{c}` {kinds[c]}" for c in by), *(f"{c} {kinds['id'] if k == 'id' else k}" for c, k in columns.items())])


def counted(rows: DataFrame, by: list[str], same: bool = True) -> DataFrame:
    """by, a < b, common, same of members that have a marker in common; without same if that is not asked for."""
    names = [*by, "a", "b", "common", *(["same"] if same else [])]

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, common, equal = _compared(batches, same)
        a, b = one["id"].combine_chunks(), two["id"].combine_chunks()
        for k in range(0, len(one), SLICE):
            x, y = np.nonzero(common[k : k + SLICE])
            values = [common[k : k + SLICE][x, y].astype(np.int32)] + ([equal[k : k + SLICE][x, y].astype(np.int32)] if same else [])
            yield pa.RecordBatch.from_arrays([*_keys(key, by, len(x)), a.take(pa.array(x + k)), b.take(pa.array(y)), *map(pa.array, values)], names=names)

    found = _met(rows, by).groupBy(*by, "i", "j").applyInArrow(run, _schema(rows, by, a="id", b="id", common="int", **({"same": "int"} if same else {})))
    return found.select(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *(F.col(c).cast("long").alias(c) for c in names[len(by) + 2 :]))


def _similarities(common: np.ndarray, equal: np.ndarray, least: int) -> np.ndarray:
    """same / common where `least` markers or more are in common, else -1."""
    return np.where(common >= max(least, 1), equal.astype(np.float64) / np.maximum(common, 1), -1.0)


def _first_places(rows: DataFrame, by: list[str], least: int, limit: float) -> DataFrame:
    """by, id, sims, rks: a member's similarities that take a place under `limit`, greatest first, with the last place of those that are equal.

    A pair of blocks tells each member's similarities with how often they are seen there, in falling order, up to that which brings their number to the
    limit: what comes after it there has no place under the limit at all.
    """
    names = [*by, "id", "sim", "n"]

    def told(ids: pa.Array, sims: np.ndarray, key: tuple) -> pa.RecordBatch:
        r = np.sort(-sims, axis=1)
        first = np.ones(r.shape, dtype=bool)
        first[:, 1:] = r[:, 1:] != r[:, :-1]
        x, y = np.nonzero(first & (r <= 0) & (np.arange(r.shape[1]) < limit)[None, :])
        after = np.where(first, np.arange(r.shape[1]), r.shape[1])
        after = np.minimum.accumulate(after[:, ::-1], axis=1)[:, ::-1]  # the next place with another value
        n = np.append(after, np.full((len(r), 1), r.shape[1]), axis=1)[x, y + 1] - y
        return pa.RecordBatch.from_arrays([*_keys(key, by, len(x)), ids.take(pa.array(x)), pa.array(np.abs(r[x, y])), pa.array(n.astype(np.int64))], names=names)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, common, equal = _compared(batches, True)
        a, b = one["id"].combine_chunks(), two["id"].combine_chunks()
        own = key[-2].as_py() == key[-1].as_py()
        if own:
            common, equal = common + common.T, equal
        for k in range(0, len(one), SLICE):
            yield told(a.slice(k, SLICE), _similarities(common[k : k + SLICE], equal[k : k + SLICE], least), key)
        for k in range(0, 0 if own else len(two), SLICE):
            yield told(b.slice(k, SLICE), _similarities(common[:, k : k + SLICE].T, equal[:, k : k + SLICE].T, least), key)

    seen = _met(rows, by).groupBy(*by, "i", "j").applyInArrow(run, _schema(rows, by, id="id", sim="double", n="bigint"))
    seen = seen.groupBy(*by, "id", "sim").agg(F.sum("n").alias("n"))
    place = F.sum("n").over(Window.partitionBy(*by, "id").orderBy(F.desc("sim")))  # at most `limit` rows or so from each block
    kept = seen.withColumn("rk", place).filter(F.col("rk") < limit).groupBy(*by, "id").agg(F.sort_array(F.collect_list(F.struct("sim", "rk")), asc=False).alias("t"))
    return kept.select(*by, "id", F.transform("t", lambda x: x["sim"]).alias("sims"), F.transform("t", lambda x: x["rk"].cast("double")).alias("rks"))


def weighted(rows: DataFrame, by: list[str], least: int, limit: float) -> DataFrame:
    """by, a, b, weight, in both directions, of members with `least` common markers or more: 1 - place / limit of b among a's similarities, 0 from the limit on.

    The places come first, from one comparison of all pairs; a second one yields the weights. Pairs are neither shuffled nor sorted.
    """
    names = [*by, "a", "b", "weight"]
    places = _settled(_first_places(rows, by, least, limit))
    none = F.array().cast("array<double>")
    rows = rows.join(places, [*by, "id"], "left").withColumns({c: F.coalesce(c, none) for c in ("sims", "rks")})

    def weights(sims: np.ndarray, of: pa.Table) -> np.ndarray:
        (r, s), (_, rk) = _flat(of.column("sims").combine_chunks()), _flat(of.column("rks").combine_chunks())
        out, nth = np.zeros(sims.shape), np.arange(len(r)) - np.searchsorted(r, r)
        for k in range(int(nth.max()) + 1 if len(nth) else 0):
            value, weight = np.full(len(of), -2.0), np.zeros(len(of))
            value[r[nth == k]], weight[r[nth == k]] = s[nth == k], 1 - rk[nth == k] / limit
            out = np.where(sims == value[:, None], weight[:, None], out)
        return out

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, common, equal = _compared(batches, True)
        for x, y, c, e in ((one, two, common, equal), (two, one, common.T, equal.T)):
            a, b = x["id"].combine_chunks(), y["id"].combine_chunks()
            for k in range(0, len(x), SLICE):
                sims = _similarities(c[k : k + SLICE], e[k : k + SLICE], least)
                p, q = np.nonzero(sims >= 0)
                w = weights(sims, x.slice(k, SLICE))[p, q]
                yield pa.RecordBatch.from_arrays([*_keys(key, by, len(p)), a.take(pa.array(p + k)), b.take(pa.array(q)), pa.array(w)], names=names)

    return _met(rows, by).groupBy(*by, "i", "j").applyInArrow(run, _schema(rows, by, a="id", b="id", weight="double"))
