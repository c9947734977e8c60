"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans."""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsight.llm.words import WordHashes, gram_hashes

GRAM = 4
#: Of so many neighbouring fingerprints of a template one, the smallest, enters the index.
WINNOW = 3
#: Words that an alignment may drift from its diagonal, and beyond which two matches are two places.
BAND = 8
#: Share of a template's words that a report needs.
LEAST = 0.6
WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")

_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source "
    "code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_GNU = "it under the terms of the GNU {} License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."

# fixed values: notices and short licenses as they are worded; the long ones are the files of license_texts
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify " + _GNU.format("Affero General Public", ",", "3"),
    "BSD-2-Clause": _BSD + _DISCLAIMER,
    "BSD-3-Clause": _BSD
    + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
    + _DISCLAIMER,
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify " + _GNU.format("General Public", ";", "2"),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
    'notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND '
    "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
    "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify " + _GNU.format("Lesser General Public", ";", "2.1"),
    "LGPL-3.0-header": "This library is free software: you can redistribute it and/or modify " + _GNU.format("Lesser General Public", ",", "3"),
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without '
    "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR '
    "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def whole_texts() -> dict[str, str]:
    """Names and texts of the long licenses."""
    return {f.stem: f.read_text(encoding="utf-8") for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def winnowed(grams: np.ndarray) -> np.ndarray:
    """The smallest of every WINNOW neighbouring hashes; all of a template with fewer."""
    if len(grams) < WINNOW:
        return np.unique(grams)
    return np.unique(np.lib.stride_tricks.sliding_window_view(grams, WINNOW).min(axis=1))


def _words(text: str) -> tuple[list[bytes], list[tuple[int, int]]]:
    found = list(WORD.finditer(text))
    return [m.group().encode().lower() for m in found], [m.span() for m in found]


def aligned(template: np.ndarray, words: np.ndarray, shift: int) -> tuple[int, int, int]:
    """(template words matched, first word, word past the last) of the best alignment of the template within the band.

    Cell (i, j) pairs template word i with text word ``shift + i + j - BAND``. A pair of equal words gains 2, an unequal
    pair or a word left out on either side costs 1; the alignment may start and end at any word.
    """
    m, width = len(template), 2 * BAND + 1
    score = np.zeros((m + 1, width + 2), np.int64)
    matched = np.zeros((m + 1, width + 2), np.int64)
    start = np.zeros((m + 1, width + 2), np.int64)
    best = (0, 0, 0, 0)
    for i in range(1, m + 1):
        for j in range(1, width + 1):
            at = shift + i - 1 + j - 1 - BAND
            if not 0 <= at < len(words):
                continue
            equal = bool(template[i - 1] == words[at])
            options = (
                (score[i - 1, j] + (2 if equal else -1), matched[i - 1, j] + equal, start[i - 1, j] if score[i - 1, j] else at),
                (score[i, j - 1] - 1, matched[i, j - 1], start[i, j - 1]),
                (score[i - 1, j + 1] - 1, matched[i - 1, j + 1], start[i - 1, j + 1]),
            )
            s, c, a = max(options, key=lambda o: o[0])
            if s > 0:
                score[i, j], matched[i, j], start[i, j] = s, c, a
                if s > best[0] and equal:
                    best = (int(s), int(c), int(a), at + 1)
    return best[1:]


def reachable(template: np.ndarray, words: np.ndarray, shift: int) -> int:
    """Template words with an equal text word within the band: no alignment matches more."""
    m = len(template)
    a, b = max(0, shift - BAND), min(len(words), shift + m + BAND)
    if b - a < LEAST * m:
        return 0
    near = np.zeros(m + 2 * BAND, words.dtype)
    near[a - shift + BAND : b - shift + BAND] = words[a:b]
    return int((np.lib.stride_tricks.sliding_window_view(near, 2 * BAND + 1)[:m] == template[:, None]).any(axis=1).sum())


class Index:
    """Fingerprints of all templates: hash -> (template, place)."""

    def __init__(self, templates: list[tuple[str, str]]):
        hashes = WordHashes()
        self.names = [n for n, _ in templates]
        self.words = [hashes.of(_words(t)[0]) for _, t in templates]
        keys, owner, place = [], [], []
        for k, w in enumerate(self.words):
            grams = gram_hashes(w, GRAM)
            at = np.flatnonzero(np.isin(grams, winnowed(grams)))
            keys.append(grams[at])
            owner.append(np.full(len(at), k))
            place.append(at)
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[order]
        self.owner = np.concatenate(owner)[order] if keys else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if keys else np.zeros(0, np.int64)

    def candidates(self, words: np.ndarray) -> list[tuple[int, int]]:
        """(template, text word that its first word falls on) of each distinct place; close ones count once."""
        grams = gram_hashes(words, GRAM)
        lo, hi = np.searchsorted(self.keys, grams, "left"), np.searchsorted(self.keys, grams, "right")
        out, seen = [], set()
        for g in np.flatnonzero(hi > lo):
            for f in range(lo[g], hi[g]):
                t, shift = int(self.owner[f]), int(g - self.place[f])
                if (t, shift) not in seen:
                    out.append((t, shift))
                    seen.update((t, near) for near in range(shift - BAND, shift + BAND + 1))
        return out

    def matches(self, text: str, hashes: WordHashes) -> list[tuple[str, float, int, int]]:
        """(template, coverage, start, end in code points) of the reported places, by place."""
        words, spans = _words(text)
        h = hashes.of(words)
        found = set()
        for t, shift in self.candidates(h):
            m = len(self.words[t])
            if reachable(self.words[t], h, shift) < LEAST * m:
                continue
            exact = 0 <= shift <= len(h) - m and (h[shift : shift + m] == self.words[t]).all()
            matched, a, b = (m, shift, shift + m) if exact else aligned(self.words[t], h, shift)
            if matched / m >= LEAST:
                found.add((2 * matched - m, matched / m, a, b, t))
        kept: list[tuple] = []
        for one in sorted(found, key=lambda f: (-f[0], -f[1], f[2:])):  # of a place the one with most words found and fewest missed
            _, _, a, b, _ = one
            if all(2 * (min(b, y) - max(a, x)) < min(b - a, y - x) for _, _, x, y, _ in kept):
                kept.append(one)
        return sorted(((self.names[t], c, spans[a][0], spans[b - 1][1]) for _, c, a, b, t in kept), key=lambda r: (r[2], r[3], r[0]))


_MATCH = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])


def _scanned(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            made = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for name, coverage, a, b in index.matches(text.as_py() or "", hashes):
                    made.append({"doc_id": doc_id, "license": name, "coverage": coverage, "start": a, "end": b})
            yield pa.RecordBatch.from_pylist(made, schema=_MATCH)

    return run


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ``license``, ``coverage`` of the template's words, ``start``, ``end`` in code points), a row per place.

    ``templates`` (name, text) default to common notices and whole licenses; of those that fit a place the best is reported. They are a stated list, so its index travels with the tasks.
    Null and empty texts and templates have no matches, repeated rows report repeatedly, extra columns are ignored.
    """
    known = [(n, t) for n, t in (templates if templates is not None else (TEMPLATES | whole_texts()).items()) if t and WORD.search(t)]
    mine = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return mine.mapInArrow(_scanned(Index(known)), "doc_id long, license string, coverage double, start int, end int")
