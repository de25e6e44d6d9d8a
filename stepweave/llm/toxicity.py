"""Toxicity: bags of subword embeddings, averaged and fed to a linear softmax, all trained together in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from stepweave.llm.common import _LOWER, TABLE, HashCache, mix, prefix_hash, ranges, slice_hash, trim, words
from stepweave.llm.learn import calibrate, fold, joined, labelled_sample, score_all

BITS, LEAST, MOST = 18, 3, 6
SPAN = 24  # words averaged at a time; a text's margin is that of its most toxic span


def subwords(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character n-grams of <word>, n from LEAST to MOST, and of the word itself; and how many each word has."""
    size = end - start + 2
    edge = np.cumsum(size)
    text = np.full(int(edge[-1]) if len(edge) else 0, ord("<"), np.uint8)
    head = edge - size
    text[ranges(head + 1, size - 2)] = _LOWER[raw[ranges(start, size - 2)]]
    text[edge - 1] = ord(">")
    sums = prefix_hash(TABLE[text])
    per = np.array([np.maximum(size - n + 1, 0) for n in range(LEAST, MOST + 1)] + [np.ones(len(size), np.int64)])
    total = per.sum(axis=0)
    out = np.zeros(int(total.sum()), np.int64)
    at = np.cumsum(total) - total
    for n, count in zip([*range(LEAST, MOST + 1), 0], per):
        first = ranges(head, count)
        last = first + n if n else edge
        out[ranges(at, count)] = (mix(slice_hash(sums, first, last) + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64)
        at = at + count
    return out, total


def _all_words(raw: np.ndarray, at: np.ndarray, most: int = 1 << 19) -> tuple[np.ndarray, ...]:
    """words() of many texts, worked out for about `most` bytes at a time: hashes take much more room than texts."""
    parts, count, i = [], 0, 0
    first = [np.zeros(1, np.int64)]
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        hashes, start, end, own = words(raw[at[i] : at[j]], at[i : j + 1] - at[i])
        parts.append((hashes, start + at[i], end + at[i]))
        first.append(own[1:] + count)
        count += len(hashes)
        i = j
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return *(np.concatenate(x) for x in zip(none, *parts)), np.concatenate(first)


def _spread(rows: np.ndarray, columns: np.ndarray, n_columns: int):
    """Sums by column of values given by row, for a fixed sparse pattern."""
    order = np.argsort(columns, kind="stable").astype(np.int32)
    rows, sorted_ = rows.astype(np.int32)[order], columns.astype(np.int32)[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    at = sorted_[first]

    def apply(values: np.ndarray) -> np.ndarray:
        out = np.zeros((n_columns, values.shape[1]), np.float32)
        out[at] = np.add.reduceat(values[rows], first, axis=0)
        return out

    return apply


def train(texts: list[str], y: np.ndarray, dim: int = 4, rounds: int = 64, rate: float = 0.15, prior: float = 0.02, decay: float = 1e-5, seed: int = 7) -> tuple[np.ndarray, tuple[float, float]]:
    """One number for each bucket (its embedding times the difference of the softmax's rows) and the calibration.

    Every subword that was seen shares its vector with misspellings that hold it, but counts by evidence: one of n texts by n / (n + prior x all texts),
    as what was seen once or twice tells more of its text than of toxicity. Spans of SPAN words bear their document's label. Again and again,
    spans of toxic documents that look clean are left out, but for the worst of each document. A fourth of the sample serves calibration alone.
    """
    fit = np.arange(len(texts)) % 4 != 3
    raw, at = joined([t for t, f in zip(texts, fit) if f])
    hashes, start, end, first = _all_words(raw, at)
    if not len(hashes) or len(set(y[fit].tolist())) < 2:
        return np.zeros(1 << BITS, np.float32), (1.0, -5.0)
    _, sample, word = np.unique(hashes, return_index=True, return_inverse=True)
    bucket, per = subwords(raw, start[sample], end[sample])
    in_docs = np.unique(np.stack([np.repeat(np.arange(len(first) - 1), np.diff(first)), word]), axis=1)[1]
    seen = np.bincount(bucket, weights=np.repeat(np.bincount(in_docs, minlength=len(per)), per), minlength=1 << BITS)
    used = np.flatnonzero(seen)
    number = np.full(1 << BITS, len(used))
    number[used] = np.arange(len(used))
    bucket = number[bucket].astype(np.int32)
    trust = (seen[used] / (seen[used] + prior * fit.sum()))[:, None].astype(np.float32)
    n_words = np.diff(first)
    spans = -(-n_words // SPAN)
    doc = np.repeat(np.arange(len(n_words)), spans)
    head = first[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(spans) - spans, spans)) * SPAN
    size = np.minimum(SPAN, first[doc + 1] - head)
    span = np.repeat(np.arange(len(doc)), size)
    word = word[ranges(head, size)]
    pair = np.unique(span * len(per) + word)  # in a span, a word counts once
    span, word = pair // len(per), pair % len(per)
    label = y[fit][doc].astype(np.float32)

    sub_at, span_at = np.cumsum(per) - per, np.searchsorted(span, np.arange(len(doc)))
    to_word = _spread(span, word, len(per))
    to_bucket = _spread(np.repeat(np.arange(len(per), dtype=np.int32), per), bucket, len(used))
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.1, (len(used), dim)).astype(np.float32)
    softmax = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (embedding, softmax, bias)]
    weight = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum())).astype(np.float32)
    full = weight
    for t in range(1, rounds + 1):
        by_word = np.add.reduceat((trust * embedding)[bucket], sub_at, axis=0) / per[:, None].astype(np.float32)
        by_span = np.add.reduceat(by_word[word], span_at, axis=0) * np.float32(SPAN) / size[:, None].astype(np.float32)
        logits = by_span @ softmax + bias
        margin = logits[:, 1] - logits[:, 0]
        if t >= rounds // 3 and t % (rounds // 6) == 0:
            worst = np.full(len(n_words), -np.inf, np.float32)
            np.maximum.at(worst, doc, margin)
            keep = (label == 0) | (margin > 0) | (margin >= worst[doc])
            weight = np.where(keep, full, 0)
            weight[label == 1] *= 0.5 / max(1e-9, weight[label == 1].sum())
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        g = (weight * (p - label))[:, None] * np.array([[-1.0, 1.0]], np.float32)
        g_span = (g @ softmax.T) * np.float32(SPAN) / size[:, None].astype(np.float32)
        g_word = to_word(g_span) / per[:, None].astype(np.float32)
        for p_, m, grad in zip((embedding, softmax, bias), moments, (trust * to_bucket(g_word) + decay * embedding, by_span.T @ g, g.sum(axis=0))):
            m[0] += 0.1 * (grad - m[0])
            m[1] += 0.01 * (grad * grad - m[1])
            p_ -= rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.99**t)) + 1e-10)
    table = np.zeros(1 << BITS, np.float32)
    table[used] = (trust * embedding) @ (softmax[:, 1] - softmax[:, 0])
    del to_bucket, to_word, by_word, by_span, bucket, moments
    trim()
    rest = Scorer(table)(*joined([t for t, f in zip(texts, fit) if not f]))
    return table, calibrate(rest, y[~fit]) if len(set(y[~fit].tolist())) == 2 else (1.0, 0.0)


class Scorer:
    """Margins of whole texts: each distinct word's average once, then the greatest mean over SPAN words in a row."""

    def __init__(self, table: np.ndarray):
        self.table, self.cache = table, None

    def __getstate__(self):
        return {"table": self.table, "cache": None}

    def __call__(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        self.cache = self.cache or HashCache(19, np.float32)
        out = np.zeros(len(at) - 1)
        hashes, start, end, first = words(raw, at)
        if not len(hashes):
            return out

        def compute(k):
            bucket, per = subwords(raw, start[k], end[k])
            return [(np.add.reduceat(self.table[bucket], np.cumsum(per) - per) / per).astype(np.float32)]

        (value,) = self.cache.look_up(hashes, compute)
        order = np.argsort(hashes, kind="stable")
        text = np.repeat(np.arange(len(at) - 1), np.diff(first))[order]
        near = (hashes[order[1:]] == hashes[order[:-1]]) & (order[1:] - order[:-1] < SPAN) & (text[1:] == text[:-1])
        value[order[1:][near]] = 0  # the word has counted in this span
        sums = np.concatenate([[0], np.cumsum(value, dtype=np.float64)])
        some = np.flatnonzero(np.diff(first) > 0)
        n = np.minimum(SPAN, np.diff(first)[some])
        starts = np.diff(first)[some] - n + 1
        head = ranges(first[some], starts)
        width = np.repeat(n, starts)
        means = (sums[head + width] - sums[head]) / width * SPAN
        out[some] = np.maximum.reduceat(means, np.cumsum(starts) - starts)
        return out


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, carry: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents, and the columns to carry along; learns from labels outside the held-out fold.

    A text without words, null texts among them, has margin 0. Repeated rows are scored alike; null
    labels are not learned from; an empty table of documents gives an empty result, and without labels
    of both classes every score is low. Other columns than doc_id and text are not read.
    """
    table, curve = train(*labelled_sample(docs, labels, "toxic", fold(modulus) != held))
    trim()  # what the training has freed: later stages of a pipeline need the driver's room
    return score_all(docs, Scorer(table), curve, fold(modulus) == held, carry=carry)
