"""Packing by cutting-stock column generation over the histogram of piece lengths."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepweave.llm.common import id_text, materialize, shuffles, text_blocks
from stepweave.llm.tokens import encoder, with_end


def knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of lengths with the greatest value that fits: dynamic programming over capacities. lengths ascend."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c], last[c] = best[c - 1], -1
        if m := fits[c]:
            gain = values[:m] + best[c - lengths[:m]]
            k = int(np.argmax(gain))
            if gain[k] > best[c] + 1e-15:
                best[c], last[c] = gain[k], k
    counts, c = np.zeros(len(lengths), np.int64), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            counts[last[c]] += 1
            c -= int(lengths[last[c]])
    return float(best[capacity]), counts


def greedy_basis(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of a first basis and their amounts: each pattern takes the longest lengths that are left and fit.

    A pattern is used until one of its lengths runs out, and later patterns lack that length; so the columns
    are triangular in the order in which lengths run out, and the basis is regular.
    """
    m = len(lengths)
    columns, amount, left = np.zeros((m, m)), np.zeros(m), demand.astype(float)
    open_ = np.ones(m, bool)
    for _ in range(m):
        pattern, room = np.zeros(m), capacity
        while (fit := np.flatnonzero(open_[: np.searchsorted(lengths, room, "right")] & (pattern[: np.searchsorted(lengths, room, "right")] == 0))).size:
            k = fit[-1]
            pattern[k] = room // lengths[k]
            room -= int(pattern[k]) * int(lengths[k])
        held = np.flatnonzero(pattern)
        ratio = left[held] / pattern[held]
        r = held[int(np.argmin(ratio))]
        columns[:, r], amount[r] = pattern, ratio.min()
        left = np.maximum(left - ratio.min() * pattern, 0)
        left[r], open_[r] = 0, False
    return columns, amount


def column_generation(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float, most_rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used in a solution of the covering program within gap of the bound.

    Revised simplex: the dual prices of the basis go to knapsack(), whose pattern enters.
    Stops at an optimum, or when the objective is within gap of Farley's bound.
    """
    m = len(lengths)
    columns, amount = greedy_basis(lengths, demand, capacity)
    inverse = np.linalg.inv(columns)
    for _ in range(most_rounds):
        prices = inverse.sum(axis=0)
        value, pattern = knapsack(lengths, prices, capacity)
        if value <= 1 + max(gap, 1e-9):
            break
        step = inverse @ pattern
        up = step > 1e-10
        if not up.any():
            break
        ratio = np.full(m, np.inf)
        ratio[up] = amount[up] / step[up]
        r = int(np.argmin(ratio))
        row = inverse[r] / step[r]
        theta = max(ratio[r], 0.0)
        amount = np.maximum(amount - theta * step, 0)
        amount[r] = theta
        touched = np.flatnonzero(np.abs(step) > 1e-14)
        used = np.flatnonzero(row)
        inverse[np.ix_(touched, used)] -= np.outer(step[touched], row[used])
        inverse[r] = row
        columns[:, r] = pattern
    return columns.T.astype(np.int64), amount


def plan(histogram: dict[int, int], capacity: int = 1024, gap: float = 0.005, most_rounds: int = 400) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first_rank, n_pieces, first_sequence, copies, offset) that place every ranked piece.

    The program's pattern counts are rounded down; what is left of each length is dealt out by
    filling patterns first-fit decreasing, each used as often as what is left allows.
    Work and result depend on the capacity only, not on how many pieces there are.
    """
    lengths = np.array(sorted(k for k, v in histogram.items() if v > 0), np.int64)
    if not len(lengths):
        return []
    left = np.array([histogram[int(k)] for k in lengths], np.int64)
    placed: list[tuple[np.ndarray, int]] = []
    columns, amount = column_generation(lengths, left.astype(float), capacity, gap, most_rounds)
    for k in np.argsort(-amount, kind="stable"):
        if (n := int(min([np.floor(amount[k] + 1e-7), *(left[columns[k] > 0] // columns[k][columns[k] > 0])]))) > 0:
            placed.append((columns[k], n))
            left = left - n * columns[k]
    while left.any():
        pattern, room = np.zeros(len(lengths), np.int64), capacity
        while (fit := np.flatnonzero((left > pattern) & (lengths <= room))).size:
            k = fit[-1]
            n = int(min(left[k] - pattern[k], room // lengths[k]))
            pattern[k] += n
            room -= n * int(lengths[k])
        n = int((left[pattern > 0] // pattern[pattern > 0]).min())
        placed.append((pattern, n))
        left = left - n * pattern
    rows, rank, sequence = [], np.zeros(len(lengths), np.int64), 0
    for pattern, n in placed:
        offset = 0
        for k in np.flatnonzero(pattern)[::-1]:
            copies = int(pattern[k])
            rows.append((int(lengths[k]), int(rank[k]), n * copies, sequence, copies, offset))
            rank[k] += n * copies
            offset += copies * int(lengths[k])
        sequence += n
    return rows


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, lossless: bool = True) -> DataFrame:
    """Cuts each document's ids and end id into full pieces and one rest: doc_id, start, length, ids_crc32, doc_tokens."""

    def cut(batches):
        encode = encoder(tokenizer, lossless)
        for batch in batches:
            ids_of = batch.column(0)
            for i, j, raw, at in text_blocks(batch.column(1)):
                ids, at = with_end(*encode(raw, at), end_id)
                n = np.diff(at)
                per = -(-n // capacity)
                doc = np.repeat(np.arange(j - i), per)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * capacity
                length = np.minimum(capacity, n[doc] - start)
                data = memoryview(ids.astype("<u4").tobytes())
                head = (at[doc] + start) * 4
                crc = [zlib.crc32(data[s:e]) for s, e in zip(head.tolist(), (head + 4 * length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [ids_of.take(pa.array(doc + i)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[doc])],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    return id_text(docs).mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def assign(cut: DataFrame, capacity: int = 1024, gap: float = 0.005) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, ...). cut is read several times: a table.

    Pieces of one length are ranked by salt and then doc_id, so that a hot length is ranked by
    many tasks; the ranks go to the planned patterns. The plan has a row for each length of each
    pattern, a number bounded by the capacity, and is broadcast; so is nothing else.
    """
    spark = cut.sparkSession
    salts = max(64, shuffles(spark))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").count()
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    rows = plan(histogram, capacity, gap)
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).drop("count")
    within = salted.withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start")) - 1)
    ranked = within.join(before, ["length", "salt"]).withColumn("rank", F.col("nth") + F.coalesce("before", F.lit(0)))

    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(table)
    names = [c for c in cut.columns]

    def place(batches):
        t = shared.value
        span = int(t[:, 2].sum() + 1) if len(t) else 1
        keys = t[:, 0] * span + t[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            k = np.searchsorted(keys, length * span + rank, "right") - 1
            own = rank - t[k, 1]
            sequence, offset = t[k, 3] + own // t[k, 4], t[k, 5] + own % t[k, 4] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.select(*names, F.col("rank").cast("long")).mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, gap: float = 0.005, lossless: bool = True) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` tokens.

    A document is its ids and end_id; it is cut into full pieces and one rest, and column generation
    decides which rests share a sequence. A null or empty text has one token, the end id. Repeated
    rows are packed as rows of their own, an empty table packs into nothing, columns other than
    doc_id and text are not read. Ties between equal lengths go by salt, doc_id and start.
    """
    cut, _ = materialize(pieces(docs, tokenizer, capacity, end_id, lossless), "pieces")
    return assign(cut, capacity, gap)
