"""Benchmark decontamination: random walks turn word edits into differing places, keys sampled from them find windows, hits are verified by edit distance.

The CGK embedding of a window is a walk: each step writes the word under the pointer and, as a random bit of the step and the word says,
moves the pointer or leaves it. Windows that differ by a few edits are in step again soon after each edit, so that most places of
their walks agree. A table samples a few places of the walk; windows with equal samples are candidates. Tables with walks and samples of their own
are added until copies with all the edits allowed, embedded in other words, are found at the target rate, for items of every size.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import id_text, mix, ranges, text_blocks
from stepweave.llm.licenses import alnum_words, words_of

SIMILARITY = 0.8  # of an item's words; the rest may be substituted, inserted or deleted
BLOCK_BYTES = 8 << 20  # benchmark text that one broadcast index may hold (16 bytes a word and table); more text makes more indexes
STEPS, PICKED, LEAST = 8, 4, 3  # of a walk; of these in a sample; different words in a sample
RECALL = 0.999  # share of trial copies that tables must find, for each group of item sizes
TRIALS, AROUND, MOST_TABLES = 2000, 12, 64  # copies for each group, words on both sides of a copy, tables at most: beyond, an error is raised
CELLS = 1 << 20  # hits, words or cells of edit distances that are worked on at a time


def _runs(cost: np.ndarray):
    """(first, last) of runs that cost about CELLS; a dearer one is a run of its own."""
    total = np.concatenate([[0], np.cumsum(cost)])
    i = 0
    while i < len(cost):
        j = max(i + 1, int(np.searchsorted(total, total[i] + CELLS, "right")) - 1)
        yield i, j
        i = j


class Walk:
    """One table's walk and sample, and the samples of the items' windows by the windows' size."""

    def __init__(self, rng: np.random.Generator):
        self.turns = rng.integers(0, 1 << 63, STEPS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.picked = np.sort(rng.choice(STEPS, PICKED, replace=False)).tolist()
        self.windows: dict[int, tuple] = {}

    def samples(self, words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each picked step, the words under the pointers of walks from every place, and how far they have come."""
        padded = np.concatenate([words, np.zeros(STEPS, np.uint64)])
        base = np.arange(len(words))
        at, word, out = base, words, []
        for step in range(self.picked[-1] + 1):
            if step in self.picked:
                out.append((word, at - base))
            at = at + ((word * self.turns[step]) >> np.uint64(63)).astype(np.int64)
            word = padded[at]
        return out

    @staticmethod
    def keys(samples: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
        """Keys of windows of `size` words: a walk that has left its window writes nothing."""
        key = np.full(len(samples[0][0]), size, np.uint64)
        for word, far in samples:
            key = key * np.uint64(0x9E3779B97F4A7C15) + (word if size >= STEPS else np.where(far < size, word, np.uint64(0)))
        return mix(key)

    def add(self, words: np.ndarray, first: np.ndarray, item: np.ndarray, offset: np.ndarray, size: np.ndarray) -> None:
        """Takes the windows (item, offset, size) whose sample holds LEAST different places, or as many as the window has."""
        found = self.samples(words)
        place = first[item] + offset
        for n in np.unique(size).tolist():
            own = np.flatnonzero(size == n)
            far = np.sort(np.stack([np.minimum(f[place[own]], n) for _, f in found]), axis=0)
            own = own[1 + (far[1:] != far[:-1]).sum(axis=0) >= min(LEAST, n)]
            key = self.keys([(w[place[own]], f[place[own]]) for w, f in found], n)
            sieve = np.zeros(1 << 20, bool)
            sieve[(key >> np.uint64(44)).astype(np.int64)] = True
            order = np.argsort(key, kind="stable")
            self.windows[n] = (sieve, key[order], item[own][order].astype(np.int32), offset[own][order].astype(np.int32))

    def hits(self, words: np.ndarray):
        """Blocks of (place, item, offset): windows of the words that have the key of an item's window."""
        samples = self.samples(words)
        for n, (sieve, keys, items, offset) in self.windows.items():
            key = self.keys(samples, n)
            at = np.flatnonzero(sieve[(key >> np.uint64(44)).astype(np.int64)])
            key = key[at]
            low = np.searchsorted(keys, key, "left")
            many = np.searchsorted(keys, key, "right") - low
            for i, j in _runs(many):
                row = ranges(low[i:j], many[i:j])
                yield np.repeat(at[i:j], many[i:j]), items[row].astype(np.int64), offset[row].astype(np.int64)


class Index:
    """Tables of all items' windows.

    An item's windows are of its own size, or of STEPS words, as far as a walk goes, at each of its places where it has more; an item that
    may have edits but has fewer words also has the windows from each place to its end.
    """

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY, recall: float = RECALL):
        if not 0 < similarity <= 1:
            raise ValueError(f"similarity must be over 0 and at most 1, not {similarity}")
        rows = [(i, np.array(words_of(t), np.uint64)) for i, t in items]
        rows = [r for r in rows if len(r[1])]
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.size = np.array([len(r[1]) for r in rows], np.int64)
        self.words = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0, np.uint64)
        self.first = np.cumsum(self.size) - self.size
        self.edits = np.minimum(np.floor((1 - similarity) * self.size + 1e-9).astype(np.int64), self.size - 1)
        self.step = self.edits + 1
        self.tables: list[Walk] = []
        self.recall: dict[int, float] = {}
        if rows:
            self._fill(recall)

    def _fill(self, target: float) -> None:
        """Adds tables until trial copies of each group of sizes are found at the target rate."""
        rng = np.random.default_rng(17)
        many = np.where(self.size >= STEPS, self.size - STEPS + 1, np.where(self.edits > 0, np.maximum(self.size - 1, 1), 1))
        item = np.repeat(np.arange(len(self.ids)), many)
        offset = ranges(np.zeros(len(self.ids), np.int64), many)
        size = np.minimum(self.size[item] - offset, STEPS)
        words, copy, at, of, group = self._trials(rng)
        found, held = np.zeros(len(of), bool), np.zeros(len(self.ids), bool)
        while True:
            walk = Walk(rng)
            walk.add(self.words, self.first, item, offset, size)
            self.tables.append(walk)
            for _, _, items, _ in walk.windows.values():
                held[items] = True
            for place, hit, off in walk.hits(words):
                c = copy[place]
                ok = (hit == of[c]) & (np.abs(place - off - at[c]) <= self.edits[hit])
                found[c[ok]] = True
            self.recall = {int(g): float(found[group == g].mean()) for g in np.unique(group)}
            if min(self.recall.values()) >= target and held.all():  # an exact copy has all keys of its item
                return
            if len(self.tables) >= MOST_TABLES:
                raise ValueError(f"{MOST_TABLES} tables find copies at {self.recall} (by least size) and not at {target}")

    def _trials(self, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        """Words of TRIALS copies for each group of item sizes, with all the edits allowed and other words around them.

        Also the copy of each word, and each copy's beginning, item and group.
        """
        group = np.where(self.size < STEPS, self.size, 1 << np.floor(np.log2(self.size)).astype(np.int64))
        parts, of, at, groups, total = [], [], [], [], 0
        other = lambda n: rng.integers(1, 1 << 63, n, dtype=np.uint64)
        for g in np.unique(group).tolist():
            for i in rng.choice(np.flatnonzero(group == g), TRIALS).tolist():
                w = self.words[self.first[i] : self.first[i] + self.size[i]].tolist()
                for p, kind in zip(rng.integers(0, 1 << 30, self.edits[i]).tolist(), rng.integers(0, 3, self.edits[i]).tolist()):
                    p %= len(w) + (kind == 1)
                    w[p : p + (kind != 1)] = [] if kind == 2 else other(1).tolist()
                parts.append(np.concatenate([other(AROUND), np.array(w, np.uint64), other(AROUND)]))
                of.append(i)
                at.append(total + AROUND)
                groups.append(g)
                total += len(parts[-1])
        return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts]), np.array(at), np.array(of), np.array(groups)

    def candidates(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, item and slot of all windows that share a key with the item and hold enough of its words.

        A slot is edits + 1 supposed beginnings in a row; they are verified together, in one window that holds all of them.
        """
        pad = int(self.size.max(initial=0)) + 1
        span, out = len(words) + 2 * pad, [np.zeros(0, np.int64)]
        for walk in self.tables:
            for place, item, offset in walk.hits(words):
                text = np.searchsorted(first, place, "right") - 1
                slot = np.floor_divide(place - offset - first[text], self.step[item])
                out.append(np.unique((text * len(self.ids) + item) * span + slot + pad))
        code = np.unique(np.concatenate(out))
        return self._decoded(code[self._enough(words, first, *self._decoded(code, span, pad))], span, pad)

    def _decoded(self, code: np.ndarray, span: int, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pair, slot = np.divmod(code, span)
        return pair // len(self.ids), pair % len(self.ids), slot - pad

    def _window(self, first: np.ndarray, text: np.ndarray, item: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word (in the text) and number of words of the windows of slots; they may end after the text."""
        return np.maximum((slot - 1) * self.step[item], 0), self.size[item] + 4 * self.step[item]

    def _enough(self, words: np.ndarray, first: np.ndarray, text: np.ndarray, item: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Whether the window holds all of the item's words but for its edits, in any order."""
        low, width = self._window(first, text, item, slot)
        start = first[text] + low
        width = np.maximum(np.minimum(width, first[text + 1] - start), 0)
        ok = np.zeros(len(text), bool)
        for i, j in _runs(self.size[item] + width):
            salt = mix(np.arange(1, j - i + 1, dtype=np.uint64))
            own = self.words[ranges(self.first[item[i:j]], self.size[item[i:j]])] ^ np.repeat(salt, self.size[item[i:j]])
            there = words[ranges(start[i:j], width[i:j])] ^ np.repeat(salt, width[i:j])
            found = np.bincount(np.repeat(np.arange(j - i), self.size[item[i:j]]), weights=np.isin(own, there), minlength=j - i)
            ok[i:j] = found >= (self.size - self.edits)[item[i:j]]
        return ok

    def verify(self, words: np.ndarray, first: np.ndarray, text: np.ndarray, item: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, ...]:
        """Text, item, least edit distance and last word of the best hit of each pair that is near enough.

        Sellers' recurrence, for many windows of about the same width at once.
        """
        low, width = self._window(first, text, item, slot)
        kind = np.ceil(np.log2(width)).astype(np.int64)
        out = []
        for c in np.unique(kind).tolist():
            alike = np.flatnonzero(kind == c)
            for k in range(0, len(alike), max(1, CELLS >> c)):
                one = alike[k : k + max(1, CELLS >> c)]
                t, i, begin, most = text[one], item[one], low[one], int(width[one].max())
                at = (first[t] + begin)[:, None] + np.arange(most)
                window = np.where(at < first[t + 1][:, None], words[np.minimum(at, len(words) - 1)], np.uint64(0))
                ramp = np.arange(most + 1, dtype=np.int32)
                row = np.zeros((len(t), most + 1), np.int32)
                best = np.full(len(t), 1 << 20)
                where = np.zeros(len(t), np.int64)
                for p in range(int(self.size[i].max())):
                    word = self.words[np.minimum(self.first[i] + p, len(self.words) - 1)]
                    new = np.empty_like(row)
                    new[:, 0] = p + 1
                    new[:, 1:] = np.minimum(row[:, :-1] + (window != word[:, None]), row[:, 1:] + 1)
                    row = np.minimum.accumulate(new - ramp, axis=1) + ramp
                    ended = np.flatnonzero(self.size[i] == p + 1)
                    if len(ended):
                        where[ended] = row[ended].argmin(axis=1)
                        best[ended] = row[ended, where[ended]]
                ok = best <= self.edits[i]
                out.append(np.stack([t[ok], i[ok], best[ok], (begin + where - 1)[ok]]))
        both = np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)
        order = np.lexsort((both[3], both[2], both[1], both[0]))
        both = both[:, order]
        new = np.ones(both.shape[1], bool)
        new[1:] = (both[0, 1:] != both[0, :-1]) | (both[1, 1:] != both[1, :-1])
        return tuple(both[:, new])


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document and benchmark item of which it holds a copy: doc_id, item_id, distance, similarity, end_byte.

    An item is found where a stretch of the document is within (1 - similarity) x the item's words of it, in word edits, and
    shares a key with it: that holds for all exact copies, and for a share of RECALL or more of copies with as many random edits
    as are allowed, whatever stands around them. Words are runs of ASCII letters, digits and bytes over 127, in lower case. distance is the least
    one, end_byte the end of its first stretch in the UTF-8 text. Items without words, null texts and empty
    texts match nothing; repeated items or documents give repeated rows; equally near stretches count once.
    Only the benchmark's index is broadcast, in blocks of at most BLOCK_BYTES of text each; documents
    are scanned where they lie, whole, and nothing is shuffled.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + int(total) // BLOCK_BYTES
    schema = "doc_id long, item_id long, distance long, similarity double, end_byte long"

    def searched(block: int) -> DataFrame:
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        index = Index(sorted((-1 if r[0] is None else r[0], r[1]) for r in rows), similarity)
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def scan(batches):
            index = shared.value
            for batch in batches:
                for i, j, raw, at in text_blocks(batch.column(1)):
                    words, _, end, first = alnum_words(raw, at)
                    if not len(words) or not len(index.ids):
                        continue
                    text, item, distance, last = index.verify(words, first, *index.candidates(words, first))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(text + i)), pa.array(index.ids[item]), pa.array(distance), pa.array(1 - distance / index.size[item]), pa.array(end[first[text] + last] - at[text])],
                        names=["doc_id", "item_id", "distance", "similarity", "end_byte"],
                    )

        return id_text(docs).mapInArrow(scan, schema)

    return reduce(DataFrame.unionByName, [searched(b) for b in range(blocks)])
