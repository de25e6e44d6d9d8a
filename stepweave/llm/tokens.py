"""Exact ids of public tokenizers, with each distinct stretch between safe spaces encoded once."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stepweave.llm.common import CACHES, TABLE, HashCache, id_text, mix, prefix_hash, ranges, slice_hash, text_blocks

_GRAPH = np.zeros(256, bool)
_GRAPH[0x21:0x7F] = True
_AFTER = _GRAPH.copy()  # bytes that begin a character which is surely not white space
_AFTER[0xC3:0xE1] = True
_AFTER[0xE4:0xEF] = True
_AFTER[0xF0:0xF5] = True


def ends_solid(raw: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether the character whose last byte is at `last` is surely not white space."""
    two = (raw[last] >= 0x80) & (raw[last] < 0xC0) & (raw[np.maximum(last - 1, 0)] >= 0xC3) & (raw[np.maximum(last - 1, 0)] < 0xE0)
    return _GRAPH[raw[last]] | two


def safe_spaces(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions of single spaces between two characters that are no white space, inside a text.

    No pre-token or piece of the public tokenizers reaches over the front of such a space,
    so the text before it and the text from it on are encoded independently.
    """
    spot = np.flatnonzero(raw == 32)
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    spot = spot[~edge[spot]]
    spot = spot[~edge[spot + 1]]
    return spot[ends_solid(raw, spot - 1) & _AFTER[raw[spot + 1]]]


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[list(b",.;:!?%&#$*()")] = True  # not the bar: special tokens hold it


def sign_fronts(raw: np.ndarray) -> np.ndarray:
    """Positions of signs, no apostrophes, right after an ASCII letter: the pre-tokenizers of both .json files end a token there."""
    spot = np.flatnonzero(_SIGN[raw])
    spot = spot[spot > 0]
    return spot[_LETTER[raw[spot - 1]]]


CACHED = 256  # bytes of a unit that may be found by its hash; polynomial hashes of longer ones can be made to agree


class IdEncoder:
    """Token ids of whole texts by a tokenizers .json file; the same ids as encode(text, add_special_tokens=False).

    lossless: a byte-level BPE, in which a token stands for its own bytes. Otherwise the
    tokenizer must drop white space; units are then told apart by a control character.
    """

    def __init__(self, path: str, lossless: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.lossless = Tokenizer.from_file(path), lossless
        if lossless:
            n = self.tokenizer.get_vocab_size(with_added_tokens=True)
            self.width = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(n)], np.int64)
        else:
            (self.mark,) = self.tokenizer.encode("\x01", add_special_tokens=False).ids
        self._reset()

    def _reset(self) -> None:
        self.serial = 1
        self.cache, self.pool, self.used = HashCache(20 if self.lossless else 21, np.int64, np.int32), np.zeros(1 << 20, np.uint32), 0

    def _put(self, ids: np.ndarray) -> int:
        need = self.used + len(ids)
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(need, 2 * len(self.pool)) - len(self.pool), np.uint32)])
        self.pool[self.used : need] = ids
        at, self.used = self.used, need
        return at

    def _encode(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Ids of distinct units go to the pool; returns offset and count of each."""
        offset, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int32)
        piece = [raw[s:e].tobytes() for s, e in zip(start.tolist(), end.tolist())]
        if self.lossless:
            joint = (raw[start] == 32) & ends_solid(raw, end - 1) & (end - start > 1)
            joint &= _AFTER[raw[np.minimum(start + 1, len(raw) - 1)]]
        else:
            joint = np.array([b"\x01" not in p for p in piece], bool)
        together = np.flatnonzero(joint)
        if len(together):
            step = 512
            parts = [together[i : i + step] for i in range(0, len(together), step)]
            glue = b"" if self.lossless else b" \x01 "
            coded = self.tokenizer.encode_batch_fast([glue.join(piece[k] for k in p).decode() for p in parts], add_special_tokens=False)
            for p, c in zip(parts, coded, strict=True):
                ids = np.array(c.ids, np.uint32)
                if self.lossless:
                    ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(end[p] - start[p])) + 1
                    begins = np.concatenate([[0], ends[:-1]])
                else:
                    cuts = np.flatnonzero(ids == self.mark)
                    begins, ends = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(ids)]])
                offset[p] = self._put(ids) + begins
                count[p] = ends - begins
        for k in np.flatnonzero(~joint).tolist():
            ids = np.array(self.tokenizer.encode(piece[k].decode(), add_special_tokens=False).ids, np.uint32)
            offset[k], count[k] = self._put(ids), len(ids)
        return [offset, count]

    def __call__(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts laid end to end, and the n + 1 offsets by text."""
        if self.used > (8 << 20 if self.lossless else 12 << 20):
            self._reset()
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        cut = np.zeros(len(raw), bool)
        cut[safe_spaces(raw, at)] = True
        cut[sign_fronts(raw)] = True
        cut[at[:-1][at[:-1] < at[1:]]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(raw))
        keys = slice_hash(prefix_hash(TABLE[raw]), start, end)
        long_ = np.flatnonzero(end - start > CACHED)
        keys[long_] = mix(np.arange(self.serial, self.serial + len(long_), dtype=np.uint64))  # numbers of their own: never found again
        self.serial += len(long_)
        offset, count = self.cache.look_up(keys, lambda k: self._encode(raw, start[k], end[k]))
        ids = self.pool[ranges(offset, count.astype(np.int64))]
        total = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        return ids, total[np.searchsorted(start, at)]


def encoder(path: str, lossless: bool) -> IdEncoder:
    """One encoder for each worker process, so that later tasks find a filled cache."""
    if (path, lossless) not in CACHES:
        CACHES[path, lossless] = IdEncoder(path, lossless)
    return CACHES[path, lossless]


def with_end(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends end_id to the ids of each text."""
    new = at + np.arange(len(at))
    out = np.full(int(new[-1]), end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[new[1:] - 1] = False
    out[keep] = ids
    return out, new


def token_counts(docs: DataFrame, model: str, limit: int = 4096, batch_bytes: int = 1 << 20, split_bytes: int = 1 << 16) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of whole texts under a sentencepiece model.

    Texts reach the library in batches of about batch_bytes; a text longer than split_bytes is
    cut at safe spaces, and the lengths of its parts are added up. Only lengths leave the workers.
    A null or empty text has 0 bytes and 0 tokens; repeated rows give repeated results; an empty
    table gives an empty result; other columns are not read. doc_id may be null and is passed on.
    """

    def count(batches):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in batches:
            n_bytes, n_tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, j, raw, at in text_blocks(batch.column(1), batch_bytes):
                n_bytes[i:j] = np.diff(at)
                long = np.flatnonzero(np.diff(at) > split_bytes)
                cuts = np.zeros(0, np.int64)
                if len(long):
                    spots = safe_spaces(raw, at)
                    inside = np.searchsorted(at, spots, "right") - 1
                    spots = spots[np.isin(inside, long)]
                    slab = spots // split_bytes
                    cuts = spots[np.concatenate([[True], slab[1:] != slab[:-1]])] if len(spots) else spots
                start = np.sort(np.concatenate([at[:-1], cuts]))
                end = np.append(start[1:], len(raw))
                owner = np.searchsorted(at[:-1], start, "right") - 1
                drop = np.isin(start, cuts)
                data = raw.tobytes()
                parts = [data[s:e].decode() for s, e in zip((start + drop).tolist(), end.tolist())]
                lengths = [len(x) for x in library.encode(parts, num_threads=1)]
                np.add.at(n_tokens[i:j], owner, lengths)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_text(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
