"""Quality: a linear support vector machine over indicators of word and shape n-grams, scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from stepweave.llm.common import HashCache, mix, prefix_hash, slice_hash, words
from stepweave.llm.learn import calibrate, fold, joined, labelled_sample, score_all

BITS = 18  # of all buckets; n-grams of shapes have the first fourth, n-grams of words the rest
SHAPES = 1 << (BITS - 2)

_CLASS = np.arange(256, dtype=np.uint64) + np.uint64(16)  # each sign is a class of its own
_CLASS[[*range(97, 123), *range(128, 192)]] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[194:] = 0  # lead bytes: their continuation bytes count


def _shapes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word's shape: its runs of small letters, capitals, digits and signs."""
    size = end - start
    edge = np.cumsum(size)
    at = np.arange(int(edge[-1])) + np.repeat(start - (edge - size), size)
    kind = _CLASS[raw[at]].copy()
    before = raw[np.maximum(at - 1, 0)]
    kind[(before == 0xC3) & (raw[at] >= 0x80) & (raw[at] < 0x9F)] = 2
    owner = np.repeat(np.arange(len(size)), size)
    keep = kind > 0
    kind, owner = kind[keep], owner[keep]
    new = np.ones(len(kind), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (owner[1:] != owner[:-1])
    kind, owner = kind[new], owner[new]
    cut = np.searchsorted(owner, np.arange(len(size) + 1))
    return slice_hash(prefix_hash(mix(kind)), cut[:-1], cut[1:])


class Features:
    """Indicators of each text's n-grams: of its words in lower case, n 1 and 2, and of its words' shapes, n from 1 to 3; there a word that repeats the one before it is marked."""

    def __init__(self):
        self.cache = None

    def __getstate__(self):
        return {"cache": None}

    def __call__(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text number and bucket of each indicator that is 1, ascending."""
        self.cache = self.cache or HashCache(19, np.uint64)
        hashes, start, end, first = words(raw, at, lower=False)
        if not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        (shape,) = self.cache.look_up(hashes, lambda k: [_shapes(raw, start[k], end[k])])
        text = np.repeat(np.arange(len(at) - 1), np.diff(first))
        follows = np.concatenate([[False], text[1:] == text[:-1]])
        again = follows & np.concatenate([[False], hashes[1:] == hashes[:-1]])
        gram = np.where(again, mix(shape + np.uint64(1)), shape)
        found, current, ok = [], gram, np.ones(len(gram), bool)
        for n in (1, 2, 3):
            if n > 1:
                ok = ok & np.concatenate([np.zeros(n - 1, bool), text[n - 1 :] == text[: len(text) - n + 1]])[: len(text)]
                current = mix(current * np.uint64(0x9E3779B97F4A7C15) + np.concatenate([np.zeros(n - 1, np.uint64), gram])[: len(gram)])
            found.append((text[ok] << BITS) | (current[ok] % np.uint64(SHAPES)).astype(np.int64))
        plain = words(raw, at)[0]
        pairs = mix(plain[:-1] * np.uint64(0x9E3779B97F4A7C15) + plain[1:])[text[1:] == text[:-1]]
        for own, gram in ((text, plain), (text[1:][text[1:] == text[:-1]], pairs)):
            found.append((own << BITS) | (SHAPES + (gram % np.uint64((1 << BITS) - SHAPES)).astype(np.int64)))
        both = np.concatenate(found)
        both.sort()
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
        return both >> BITS, both & ((1 << BITS) - 1)


def fit(rows: np.ndarray, columns: np.ndarray, y: np.ndarray, cost: float = 1.0, sweeps: int = 30, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias: log-count ratios times the hinge-loss solution found by dual coordinate descent."""
    n = len(y)
    good = np.bincount(columns[y[rows] == 1], minlength=1 << BITS) + 1.0
    bad = np.bincount(columns[y[rows] == 0], minlength=1 << BITS) + 1.0
    ratio = np.log((good / good.sum()) / (bad / bad.sum()))
    cut = np.searchsorted(rows, np.arange(n + 1))
    sign = np.where(y == 1, 1.0, -1.0)
    value = ratio[columns]
    norm = np.array([np.dot(value[a:b], value[a:b]) + 1.0 for a, b in zip(cut[:-1], cut[1:])])
    weight, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(n)
    most = cost * n / np.where(y == 1, 2 * max(1, (y == 1).sum()), 2 * max(1, (y == 0).sum()))
    rng = np.random.default_rng(seed)
    for _ in range(sweeps):
        moved = 0.0
        for i in rng.permutation(n):
            own, v = columns[cut[i] : cut[i + 1]], value[cut[i] : cut[i + 1]]
            g = sign[i] * (weight[own] @ v + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), most[i])
            if (d := (new - alpha[i]) * sign[i]) != 0:
                weight[own] += d * v
                bias += d
                moved = max(moved, abs(d))
                alpha[i] = new
        if moved < 1e-4:
            break
    return weight * ratio, bias


class Scorer:
    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias, self.features = weight.astype(np.float32), bias, Features()

    def __call__(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        rows, columns = self.features(raw, at)
        return np.bincount(rows, weights=self.weight[columns], minlength=len(at) - 1) + self.bias


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents; learns from labels outside the held-out fold.

    A text without words, null texts among them, has no indicator and the bias as its margin.
    Repeated rows are scored alike; null labels are not learned from; without labels of both classes
    the margin is 0. An empty table gives an empty result. Other columns than doc_id and text are not read.
    """
    texts, y = labelled_sample(docs, labels, "quality", fold(modulus) != held)
    part = np.arange(len(texts)) % 4 != 3
    if len(set(y[part].tolist())) < 2 or len(set(y[~part].tolist())) < 2:
        return score_all(docs, Scorer(np.zeros(1 << BITS), 0.0), (1.0, 0.0), fold(modulus) == held)
    raw, at = joined([t for t, p in zip(texts, part) if p])
    scorer = Scorer(*fit(*Features()(raw, at), y[part]))
    curve = calibrate(scorer(*joined([t for t, p in zip(texts, part) if not p])), y[~part])
    return score_all(docs, scorer, curve, fold(modulus) == held)
