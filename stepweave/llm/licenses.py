"""License scans: patience alignment of texts with license templates, scored by coverage."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stepweave.llm.common import TABLE, id_text, prefix_hash, slice_hash, text_blocks

# Wording of public license notices.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT": "Released under the MIT License",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "all-rights-reserved": "All rights reserved",
}

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def alnum_words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end of runs of ASCII letters, digits and bytes over 127, A-Z in lower case; first word by text."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(at), np.int64)
    inside = _WORD[raw]
    head, tail = inside.copy(), inside.copy()
    head[1:] &= ~inside[:-1]
    tail[:-1] &= ~inside[1:]
    some = at[:-1] < at[1:]
    head[at[:-1][some]], tail[at[1:][some] - 1] = inside[at[:-1][some]], inside[at[1:][some] - 1]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return slice_hash(prefix_hash(TABLE[_LOWER[raw]]), start, end), start, end, np.searchsorted(start, at)


def words_of(text: str) -> list[int]:
    raw = np.frombuffer(text.encode(), np.uint8)
    return alnum_words(raw, np.array([0, len(raw)]))[0].tolist()


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of one longest strictly increasing subsequence, by patience piles; the last card of each pile backtracks."""
    tops, cards, back = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect.bisect_left(tops, v)
        back[i] = cards[pile - 1] if pile else -1
        tops[pile : pile + 1], cards[pile : pile + 1] = [v], [i]
    out, i = [], cards[-1] if cards else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(text: list, template: list) -> list[tuple[int, int]]:
    """Aligned positions (text, template): anchors are items found once in both; gaps between them are aligned in turn.

    Where a gap has no such item, equal items at its two ends are aligned and the rest is left.
    """
    out: list[tuple[int, int]] = []
    stack = [(0, len(text), 0, len(template))]
    while stack:
        a, b, c, d = stack.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        once: dict = {}
        for j in range(c, d):
            once[template[j]] = -1 if template[j] in once else j
        seen: dict = {}
        for i in range(a, b):
            if text[i] in once:
                seen[text[i]] = -1 if text[i] in seen else i
        pairs = sorted((i, once[w]) for w, i in seen.items() if i >= 0 and once[w] >= 0)
        anchors = [pairs[k] for k in longest_increasing([j for _, j in pairs])]
        if not anchors:
            continue
        out += anchors
        ends = [*anchors, (b, d)]
        for i, j in ends:
            stack.append((a, i, c, j))
            a, c = i + 1, j + 1
    return sorted(out)


class Scanner:
    """Finds stretches of a text that may hold a template, aligns them, and keeps the best coverage for each template.

    A word's weight is 1; a stretch begins at any word of the template from which, within twice the
    template's length (and at least 8 words), enough of its distinct words are seen to reach the least
    coverage. That test misses no alignment of a window of that size: coverage counts distinct matched positions,
    and a text position matches only an equal word.
    """

    def __init__(self, templates: dict[str, str], least: float):
        self.names = sorted(templates)
        self.words = [words_of(templates[n]) for n in self.names]
        self.least = least
        vocabulary = np.unique(np.array([w for ws in self.words for w in ws], np.uint64))
        self.vocabulary = vocabulary
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(vocabulary >> np.uint64(48)).astype(np.int64)] = True
        self.index = [np.isin(vocabulary, np.array(ws, np.uint64)) for ws in self.words]
        rare = np.sum(self.index, axis=0)
        self.rare = rare

    def __call__(self, raw: np.ndarray, at: np.ndarray) -> list[tuple[int, int, float, int, int, int]]:
        """(text, template, coverage, matched words, first byte, last byte) for each text and template that is covered enough."""
        hashes, start, end, first = alnum_words(raw, at)
        hit = np.flatnonzero(self.sieve[(hashes >> np.uint64(48)).astype(np.int64)])
        place = np.searchsorted(self.vocabulary, hashes[hit])
        ok = self.vocabulary[np.minimum(place, len(self.vocabulary) - 1)] == hashes[hit]
        hit, place = hit[ok], place[ok]
        text = np.searchsorted(first, hit, "right") - 1
        out = []
        for t, ws in enumerate(self.words):
            need, span = int(np.ceil(self.least * len(ws) - 1e-9)), max(8, 2 * len(ws))
            own = self.index[t][place]
            spot, owner = hit[own], text[own]
            if len(spot) < need:
                continue
            # enough template words within the span, in the same text
            far = spot[need - 1 :]
            near = spot[: len(far)]
            good = (far - near < span) & (owner[need - 1 :] == owner[: len(far)])
            best: dict[int, tuple] = {}
            done = -1
            for s, o in zip(near[good].tolist(), owner[: len(far)][good].tolist()):
                stop = min(s + span, int(first[o + 1]))
                window = hashes[s:stop].tolist()
                if len(set(window) & set(ws)) < min(need, len(set(ws))) * 0.999 and len(set(ws)) == len(ws):
                    continue
                if s < done:
                    continue
                pairs = patience(window, ws)
                if len(pairs) >= need:
                    found = (len(pairs), -s, int(start[s + pairs[0][0]] - at[o]), int(end[s + pairs[-1][0]] - at[o]))
                    if o not in best or found > best[o]:
                        best[o] = found
                    done = s + pairs[-1][0] if len(pairs) == len(ws) else done
            out += [(o, t, f[0] / len(ws), f[0], f[2], f[3]) for o, f in best.items()]
        return out


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """One row for each document: its best covered template, or nulls where none reaches the least coverage.

    doc_id, license, coverage, n_matched, start, end (bytes), licenses (all templates reached, by name).
    Ties go to more matched words, then to the name. A null or empty text has no license; repeated rows
    give repeated results; an empty table gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(templates, least))
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("n_matched", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("licenses", pa.list_(pa.string()))])

    def scan(batches):
        scanner = shared.value
        for batch in batches:
            for i, j, raw, at in text_blocks(batch.column(1)):
                rows: list[list] = [[None, 0.0, 0, None, None, []] for _ in range(j - i)]
                for o, t, coverage, n, s, e in sorted(scanner(raw, at), key=lambda r: (r[0], -r[2], -r[3], r[1])):
                    if rows[o][0] is None:
                        rows[o][:5] = scanner.names[t], coverage, n, s, e
                    rows[o][5].append(scanner.names[t])
                columns = [pa.array([r[k] for r in rows], schema.field(k + 1).type) for k in range(6)]
                columns[5] = pa.array([sorted(r[5]) for r in rows], schema.field(6).type)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], schema=schema)

    return id_text(docs).mapInArrow(scan, "doc_id long, license string, coverage double, n_matched long, start long, end long, licenses array<string>")
