"""Removal of repeated byte strings: content-chosen anchors bring equal strings together, Lyndon-grouped suffix arrays settle what overlaps only in part."""

from __future__ import annotations

import functools
import gc
import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import TABLE, forget, id_text, materialize, mix, powers, prefix_hash, ranges, shuffles, slice_hash, small_batches, text_bytes, trim
from stepweave.llm.rows import numbered

LENGTH = 100  # bytes of a string that may not occur twice
GRAM = 20  # bytes of an anchor; each string has LENGTH - GRAM + 1 grams to choose from
PART = 1 << 20  # longer texts are taken in parts of so many string starts
BLOCK = 1 << 20  # bytes of contexts that are settled together
FLUSH = 1 << 18  # rows that a task gathers before it settles repeats among them


def _before(text: bytes, i: int, m: int, j: int, k: int) -> int:
    """Below, at or above 0 as text[i : i + m] stands before, equals or stands after text[j : j + k]; pieces that double in size are compared."""
    at, step, both = 0, 32, min(m, k)
    while at < both:
        end = min(at + step, both)
        one, two = text[i + at : i + end], text[j + at : j + end]
        if one != two:
            return -1 if one < two else 1
        at, step = end, 2 * step
    return m - k


def lyndon_suffix_array(text: bytes) -> list[int]:
    """All suffixes of text in ascending order.

    From the right, each suffix's longest Lyndon prefix grows over the next smaller suffix's for as long as that one
    is greater; suffixes with equal prefixes form a group, and groups stand in their prefixes' order. A prefix is
    known by its first part and the last prefix it grew over, a pair of numbers: equal prefixes grew alike, and no
    bytes are kept. Then, in ascending order, each suffix that is placed places those that it ends the prefix of,
    found over previous-smaller pointers, into the next place of their groups: no ranks are made anew. Memory is
    linear, and so is the time but for comparing prefixes, while they grow and when the groups are sorted: prefixes
    that are long and alike cost what they have in common.
    """
    n = len(text)
    size, group_of, names = array("i", [0]) * n, array("i", [0]) * n, {}
    wide = n + n + 257  # more than there are names
    for i in range(n - 1, -1, -1):
        j = i + 1
        word = names.setdefault(text[i] - 256, len(names))
        while j < n:
            m, k = j - i, size[j]
            if text[i:j] < text[j : j + k] if m < 64 and k < 64 else _before(text, i, m, j, k) < 0:
                word, j = names.setdefault(word * wide + group_of[j], len(names)), j + k
            else:
                break
        size[i], group_of[i] = j - i, word
    count, place = array("i", [0]) * len(names), array("i", [-1]) * len(names)
    del names
    for i in range(n):
        count[group_of[i]] += 1
        place[group_of[i]] = i
    previous, stack = array("i", [-1]) * n, []  # previous smaller suffix: the nearest one to the left whose prefix reaches beyond
    for i in range(n):
        while stack and stack[-1] + size[stack[-1]] <= i:
            stack.pop()
        previous[i] = stack[-1] if stack else -1
        stack.append(i)
    order = functools.cmp_to_key(lambda g, h: _before(text, place[g], size[place[g]], place[h], size[place[h]]))
    free, at = array("i", [0]) * len(count), 0
    for word in sorted((g for g in range(len(count)) if count[g]), key=order):
        free[word] = at
        at += count[word]
    out = array("i", [-1]) * n
    for placed in range(-1, n):
        s = n if placed < 0 else out[placed]
        p = s - 1
        while p >= 0 and p + size[p] == s:
            g = group_of[p]
            out[free[g]] = p
            free[g] += 1
            p = _left(p, previous, size, s)
    return out.tolist()


def _left(p: int, previous: array, size: array, s: int) -> int:
    """The next suffix to the left of p whose Lyndon prefix ends at s, or -1."""
    q = p - 1
    while q >= 0 and q + size[q] < s:
        q = previous[q]
    return q if q >= 0 and q + size[q] == s else -1


def repeated_strings(pieces: list[bytes], length: int = LENGTH) -> list[tuple[int, int]]:
    """(piece, offset) of each string of `length` bytes that also starts earlier, in an earlier piece or place."""
    text = b"\xff".join(pieces)
    edge = np.cumsum([len(p) + 1 for p in pieces])
    order = lyndon_suffix_array(text)
    out, first, last, held = [], -1, b"", []
    for p in [*order, -1]:
        window = text[p : p + length] if p >= 0 else b""
        if window != last or p < 0:
            if len(held) > 1:
                first = min(held)
                out += [q for q in held if q != first]
            last, held = window, []
        if len(window) == length and b"\xff" not in window:
            held.append(p)
    owner = np.searchsorted(edge, out, "right")
    return [(int(o), int(q - (edge[o - 1] if o else 0))) for o, q in zip(owner, out)]


def anchors(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of string starts [u, v] that choose the same gram, the one with the least hash: key, context hash, u, v, anchor.

    Equal strings choose the same gram at the same place in them, wherever they stand.
    """
    n = len(raw)
    width = length - gram + 1
    sums = prefix_hash(TABLE[raw])
    grams = mix((sums[gram:] - sums[:-gram]) * powers(n)[1][: n - gram + 1])
    low = np.uint64((1 << 21) - 1)
    key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    rows = np.concatenate([key, np.full(-len(key) % width, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    chosen = (np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts]) & low).astype(np.int64)
    u = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    v = np.append(u[1:], starts) - 1
    a = chosen[u]
    context = mix(slice_hash(sums, u, v + length) + (a - u).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return grams[a], context, u, v, a


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the intervals of each document; touching ones become one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    base = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])]) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + base)
    new = np.concatenate([[True], start[1:] + base[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], (reach - base)[last]


_ROWS = "akey long, ctx long, doc_id long, u int, w int"


def _settle(akey, ctx, doc, u, v, a, length):
    """Splits rows into first ones of their key and context and the intervals that later ones make superfluous."""
    order = np.lexsort((u, doc, ctx, akey))
    akey, ctx, doc, u, v, a = (x[order] for x in (akey, ctx, doc, u, v, a))
    first = np.concatenate([[True], (akey[1:] != akey[:-1]) | (ctx[1:] != ctx[:-1])])
    leader = np.flatnonzero(first)[np.cumsum(first) - 1]
    later = ~first & ((doc != doc[leader]) | (u != u[leader]))
    return (akey[first], ctx[first], doc[first], u[first], v[first], a[first]), _merged(doc[later], u[later].astype(np.int64), v[later].astype(np.int64) + length)


def _anchor_rows(length: int, gram: int):
    def rows(batches):
        forget()
        held: list[tuple] = []

        def flush():
            firsts, gone = _settle(*(np.concatenate(x) for x in zip(*held)), length)
            akey, ctx, doc, u, v, a = firsts
            held.clear()
            yield _batch(akey.view(np.int64), ctx.view(np.int64), doc, u, (v - u) << 8 | (a - u))
            if len(gone[0]):
                yield _batch(mix(gone[0].astype(np.uint64) * np.uint64(31) + gone[1].astype(np.uint64)).view(np.int64), np.zeros(len(gone[0]), np.int64), gone[0], gone[1], gone[1] - gone[2])

        n = 0
        for batch in batches:
            raw, at = text_bytes(batch.column(1))
            for doc, s, e in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                for p in range(s, max(s, e - length + 1), PART):
                    akey, ctx, u, v, a = anchors(raw[p : min(e, p + PART + length - 1)], length, gram)
                    held.append((akey, ctx, np.full(len(u), doc), u + (p - s), v + (p - s), a + (p - s)))
                    n += len(u)
            if n >= FLUSH:
                yield from flush()
                n = 0
            trim()
        if held:
            yield from flush()

    return rows


def _batch(akey, ctx, doc, u, w):
    return pa.RecordBatch.from_arrays([pa.array(akey), pa.array(ctx), pa.array(doc), pa.array(u.astype(np.int32)), pa.array(w.astype(np.int32))], names=["akey", "ctx", "doc_id", "u", "w"])


def _grouped_rows(length: int):
    """All rows of a partition: later rows of a context give intervals; contexts of a key that has several are asked for."""

    def rows(batches):
        forget()
        parts = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.concat_tables(parts)
        akey, ctx, doc, u, w = (table[c].to_numpy() for c in ("akey", "ctx", "doc_id", "u", "w"))
        u, w = u.astype(np.int64), w.astype(np.int64)
        gone, row = w < 0, w >= 0
        akey, ctx, doc_, u_, w_ = akey[row], ctx[row], doc[row], u[row], w[row]
        (akey, ctx, fd, fu, fv, fa), (d, s, e) = _settle(akey, ctx, doc_, u_, u_ + (w_ >> 8), u_ + (w_ & 255), length)
        d, s, e = _merged(np.concatenate([d, doc[gone]]), np.concatenate([s, u[gone]]), np.concatenate([e, u[gone] - w[gone]]))
        several = np.zeros(len(akey), bool)
        several[1:] |= akey[1:] == akey[:-1]
        several[:-1] |= akey[1:] == akey[:-1]
        none = np.zeros(len(d), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([d, fd[several]])), pa.array(np.concatenate([s, fu[several]])), pa.array(np.concatenate([e, fv[several] + length])), pa.array(np.concatenate([none - 1, fa[several]])), pa.array(np.concatenate([none, akey[several]]))],
            names=["doc_id", "start", "end", "anchor", "akey"],
        )

    return rows


def _context_rows(batches):
    for batch in batches:
        raw, at = text_bytes(batch.column("text"))
        asked = batch.column("asked")
        flat = asked.flatten()
        many = np.diff(np.asarray(asked.offsets))
        row = np.repeat(np.arange(batch.num_rows), many)
        start, end, anchor, akey = (np.asarray(flat.field(k)) for k in range(4))
        low, high = at[row] + start, np.minimum(at[row] + end, at[row + 1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(akey), batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(anchor - start), pa.array([raw[x:y].tobytes() for x, y in zip(low.tolist(), high.tolist())], pa.binary())],
            names=["akey", "doc_id", "start", "anchor", "data"],
        )


def _settled_contexts(length: int):
    """Intervals of strings that occur in an earlier context of the same anchor.

    A string that equals the one at the same place in the anchor's first context is settled by its hash and then, in runs of
    such strings, by its bytes. Of the others, those whose hash occurs again go to the suffix array, which decides.
    """

    def rows(batches):
        forget()
        parts = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.concat_tables(parts)
        akey, doc, start, anchor = (table[c].to_numpy() for c in ("akey", "doc_id", "start", "anchor"))
        order = np.lexsort((start, doc, akey))
        akey, doc, start, anchor = (x[order] for x in (akey, doc, start, anchor))
        data = table["data"].combine_chunks()
        data = (data if not isinstance(data, pa.ChunkedArray) else pa.concat_arrays(data.chunks)).take(pa.array(order))
        bytes_, edge = text_bytes(data.cast(pa.large_binary()).view(pa.large_string()))
        key_at = np.append(np.flatnonzero(np.concatenate([[True], akey[1:] != akey[:-1]])), len(akey))
        i = 0
        while i + 1 < len(key_at):  # whole keys, about BLOCK bytes of them at a time
            j = max(i + 1, int(np.searchsorted(edge[key_at], edge[key_at[i]] + BLOCK, "right")) - 1)
            a, b = int(key_at[i]), int(key_at[j])
            yield settle(akey[a:b], doc[a:b], start[a:b], anchor[a:b], bytes_[edge[a] : edge[b]], edge[a : b + 1] - edge[a])
            i = j
            trim()

    def settle(akey, doc, start, anchor, raw, at):
        size = np.maximum(np.diff(at) - length + 1, 0)
        sums = prefix_hash(TABLE[raw])
        own = np.repeat(np.arange(len(akey)), size)
        spot = ranges(at[:-1], size)
        hashes = slice_hash(sums, spot, spot + length)
        place = spot - at[own] - anchor[own]  # relative to the anchor
        new = np.concatenate([[True], akey[1:] != akey[:-1]])
        leader = np.flatnonzero(new)[np.cumsum(new) - 1]
        head = np.cumsum(size) - size
        twin = place + anchor[leader[own]]  # the string at the same place in the first context
        inside = (twin >= 0) & (twin < size[leader[own]]) & (own != leader[own])
        mate = head[leader[own]] + np.where(inside, twin, 0)
        mate = np.minimum(mate, max(len(hashes) - 1, 0))
        equal = inside & (hashes[mate] == hashes)
        equal = _same_bytes(raw, spot, spot[mate], own, equal, length)
        gone = [(doc[own[equal]], start[own[equal]] + spot[equal] - at[own[equal]])]
        rest = np.flatnonzero(~equal & (own != leader[own]))
        if len(rest):
            by = rest[np.argsort(hashes[rest], kind="stable")]
            same = hashes[by[1:]] == hashes[by[:-1]]
            again = np.zeros(len(by), bool)
            again[1:] |= same
            again[:-1] |= same
            left = np.sort(by[again])
            gone += _by_suffix_array(raw, akey, doc, start, at, own, spot, left, length)
        doc_, at_ = (np.concatenate(x) for x in zip(*gone))
        d, s, e = _merged(doc_, at_, at_ + length)
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array(e)], names=["doc_id", "start", "end"])

    return rows


def _same_bytes(raw: np.ndarray, spot: np.ndarray, mate: np.ndarray, own: np.ndarray, equal: np.ndarray, length: int) -> np.ndarray:
    """`equal` without strings whose bytes differ from their mates'; runs of strings next to each other are compared as one."""
    at = np.flatnonzero(equal)
    if not len(at):
        return equal
    new = np.concatenate([[True], (np.diff(spot[at]) != 1) | (np.diff(mate[at]) != 1) | (own[at[1:]] != own[at[:-1]])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    for f, e, s, m in zip(first.tolist(), last.tolist(), spot[at[first]].tolist(), mate[at[first]].tolist()):
        n = e - f + length
        if raw[s : s + n].tobytes() != raw[m : m + n].tobytes():
            for k in range(f, e + 1):
                equal[at[k]] = raw[s + k - f : s + k - f + length].tobytes() == raw[m + k - f : m + k - f + length].tobytes()
    return equal


def _by_suffix_array(raw, akey, doc, start, at, own, spot, left, length):
    """Runs of strings in `left` become pieces; the suffix array of each anchor's pieces finds the repeated ones."""
    if not len(left):
        return []
    new = np.concatenate([[True], (np.diff(left) != 1) | (own[left[1:]] != own[left[:-1]])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(left)) - 1
    low, high, owner = spot[left[first]], spot[left[last]] + length, own[left[first]]
    out = []
    edges = np.flatnonzero(np.concatenate([[True], akey[owner[1:]] != akey[owner[:-1]], [True]]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a < 2 and high[a] - low[a] == length:
            continue
        pieces = [raw[x:y].tobytes() for x, y in zip(low[a:b].tolist(), high[a:b].tolist())]
        found = repeated_strings(pieces, length)
        if found:
            k = np.array([f[0] for f in found]) + a
            o = np.array([f[1] for f in found])
            out.append((doc[owner[k]], start[owner[k]] + low[k] + o - at[owner[k]]))
    return out


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, start, end: bytes covered by a string of `length` bytes that also starts earlier; intervals may overlap. Each doc_id is one row of docs.

    Three shuffles carry what has to meet: 36 bytes for every run of about forty strings, texts once to cut out the
    contexts of anchors that stand in different ones, and those contexts. A task settles what repeats within its own
    rows before it sends any, so that thousands of copies shrink to one row for each task.
    """
    spark = docs.sparkSession
    texts, n = id_text(docs), shuffles(spark)
    rows = texts.mapInArrow(_anchor_rows(length, gram), _ROWS)
    shared, _ = materialize(rows.repartition(n, "akey").mapInArrow(_grouped_rows(length), "doc_id long, start long, end long, anchor long, akey long"), "runs")
    _free(spark)
    asked = shared.filter("anchor >= 0").groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "anchor", "akey")).alias("asked"))
    contexts = texts.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(_context_rows, "akey long, doc_id long, start long, anchor long, data binary")
    settled, _ = materialize(contexts.repartition(n, "akey").mapInArrow(_settled_contexts(length), "doc_id long, start long, end long"), "settled")
    _free(spark)
    return shared.filter("anchor < 0").select("doc_id", "start", "end").unionByName(settled)


def _free(spark) -> None:
    """Lets Spark drop shuffle files that no plan refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, extra: tuple[str, ...] = (), mend: bool = False) -> DataFrame:
    """Each document without the bytes of strings that start earlier: doc_id, n_bytes, n_removed, n_spans, kept (binary), and extra columns of docs.
    With mend, what is kept loses the bytes of characters that a cut has split.

    Order is by doc_id, then by place. Strings are judged on the input. A null or empty text, or one of fewer
    than `length` bytes, is kept. Rows that repeat a doc_id are documents of their own, in the order of their texts' hashes; so are rows
    without doc_id, which come first. An empty table gives an empty result.
    """
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(F.col(c).alias(f"_extra_{i}") for i, c in enumerate(extra))]
    rows = numbered(docs.select(*columns))
    small_batches(docs.sparkSession)
    found = repeats(rows.select(F.col("row").alias("doc_id"), "text"), length, gram).groupBy(F.col("doc_id").alias("row")).agg(F.collect_list(F.struct("start", "end")).alias("gone"))
    both = rows.join(found, "row", "left")
    carried = [f"_extra_{i}" for i in range(len(extra))]
    kinds = "".join(f", {c} {both.schema[c].dataType.simpleString()}" for c in carried)

    def cut(batches):
        for batch in batches:
            raw, at = text_bytes(batch.column("text"))
            counts, kept = np.zeros((3, batch.num_rows), np.int64), []
            for k, gone in enumerate(batch.column("gone")):
                data = raw[at[k] : at[k + 1]]
                counts[0, k] = len(data)
                if gone.is_valid and len(gone):
                    start, end = np.asarray(gone.values.field(0)), np.asarray(gone.values.field(1))
                    _, start, end = _merged(np.zeros(len(start), np.int64), start, np.minimum(end, len(data)))
                    keep = np.ones(len(data), bool)
                    for s, e in zip(start.tolist(), end.tolist()):
                        keep[s:e] = False
                    counts[1:, k] = (~keep).sum(), len(start)
                    data = data[keep]
                data = data.tobytes()
                kept.append(data.decode("utf-8", "ignore").encode() if mend and counts[1, k] else data)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in counts), pa.array(kept, pa.binary()), *(batch.column(c) for c in carried)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *carried])
            trim()

    out = both.select("doc_id", "text", "gone", *carried).mapInArrow(cut, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept binary{kinds}")
    for i, c in enumerate(extra):
        out = out.withColumnRenamed(f"_extra_{i}", c)
    return out

