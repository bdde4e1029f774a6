"""License scans: word bigrams of normalised text against license templates, by Dice coefficient.

A license may stand anywhere in a text, so templates are compared with stretches of it. A
stretch that reaches the similarity holds two thirds of a template's bigrams at least and is
at most half as long again (both follow from Dice >= 0.8); only templates whose bigrams stand
that close together somewhere are compared exactly, the others are ruled out by counts alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

SIMILARITY = 0.8

# The wording of public licenses and their usual notices.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    ),
    "MIT": (
        "Released under the MIT License",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
        permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
        notice and this permission notice shall be included in all copies or substantial portions of the Software. THE
        SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details.""",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
        version.""",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3",),
    "MPL-2.0": (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    "BSD-2-Clause": (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
    ),
    "ISC": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    ),
    "Zlib": (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software.""",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain",),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0"),
    "CC-BY-NC-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0"),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",),
    "Proprietary": ("All rights reserved",),
}

_WORD = re.compile(r"[A-Za-z0-9]+(?:\.[0-9]+)*")


def normalised(text: str) -> list[str]:
    """Lower-cased words: letters and digits, versions as one word; everything else parts words."""
    return [w.lower() for w in _WORD.findall(text)]


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in an ordered array."""
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]] | None = None, similarity: float = SIMILARITY) -> None:
        self.similarity = similarity
        self.code: dict[str, int] = {}
        self.templates: list[tuple[str, Counter, int, np.ndarray]] = []
        for name, texts in (templates or TEMPLATES).items():
            for text in texts:
                words = [self.code.setdefault(w, len(self.code) + 1) for w in normalised(text)]
                grams = Counter(zip(words, words[1:], strict=False))
                if grams:
                    self.templates.append((name, grams, sum(grams.values()), np.empty(0)))
        self.base = len(self.code) + 1
        self.templates = [(n, g, m, np.array(sorted(x * self.base + y for x, y in g))) for n, g, m, _ in self.templates]
        #: All templates' bigrams, sorted: memory grows with their words, whatever their number.
        self.member = np.unique(np.concatenate([keys for *_, keys in self.templates])) if self.templates else np.empty(0, np.int64)

    def bounds(self, m: int) -> tuple[int, int]:
        """Least and most bigrams of a stretch that can reach the similarity with a template of ``m``."""
        s = self.similarity
        return int(np.ceil(s / (2 - s) * m - 1e-9)), int(np.floor((2 - s) / s * m + 1e-9))

    def scan(self, text: str) -> list[tuple[int, int, str, float]]:
        """``start, end, license, dice`` of the best stretches, in code points; they don't overlap."""
        ids = np.fromiter(map(lambda w: self.code.get(w, 0), normalised(text)), dtype=np.int64)
        if len(ids) < 2:
            return []
        grams = np.where((ids[:-1] > 0) & (ids[1:] > 0), ids[:-1] * self.base + ids[1:], 0)
        at = np.flatnonzero((grams > 0) & _among(grams, self.member))
        if not len(at):
            return []
        found, keys = [], grams[at]
        for name, wanted, m, own in self.templates:
            least, most = self.bounds(m)
            hits = at[_among(keys, own)]
            # Two thirds of the template's bigrams within one stretch of the greatest length, or it is ruled out.
            if len(hits) < least or not ((hits[least - 1 :] - hits[: len(hits) - least + 1]) < most).any():
                continue
            found += self._stretches(grams, hits, name, wanted, m, least, most)
        if not found:
            return []
        places = [w.span() for w in _WORD.finditer(text)]
        out, taken = [], np.zeros(len(ids), dtype=bool)
        for dice, first, last, name in sorted(found, key=lambda f: (-f[0], f[1] - f[2], f[1], f[3])):
            if not taken[first : last + 2].any():
                taken[first : last + 2] = True
                out.append((places[first][0], places[last + 1][1], name, dice))
        return sorted(out)

    def _stretches(self, grams: np.ndarray, hits: np.ndarray, name: str, wanted: Counter, m: int, least: int, most: int) -> list[tuple[float, int, int, str]]:
        """The best stretch from each hit: those of the greatest coefficient start and end with a hit."""
        pairs = [divmod(int(g), self.base) for g in grams[hits]]
        out = []
        for i, start in enumerate(hits.tolist()):
            if i + least > len(hits) or hits[i + least - 1] - start >= most:
                continue
            have: Counter = Counter()
            both, best = 0, (0.0, 0)
            for j in range(i, len(hits)):
                size = int(hits[j]) - start + 1
                if size > most:
                    break
                have[pairs[j]] += 1
                both += have[pairs[j]] <= wanted[pairs[j]]
                best = max(best, (2 * both / (size + m), -j))
            if best[0] >= self.similarity - 1e-12:
                out.append((best[0], start, int(hits[-best[1]]), name))
        return out


def scan_licenses(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with ``n_licenses`` (long), ``licenses`` and ``stretches``.

    ``licenses`` has the names found, sorted, comma-joined; ``stretches`` name:start:end:dice by
    start. A null text counts as empty and has none (empty strings). Each row is scanned by
    itself. Other columns pass; those of the new names are replaced.
    """
    new = {"n_licenses": "long", "licenses": "string", "stretches": "string"}
    kept = docs.select(*[c for c in docs.columns if c not in new])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"{k} {v}" for k, v in new.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(similarity=similarity)
        for batch in batches:
            found = [scanner.scan(t.as_py() or "") for t in batch.column(batch.schema.get_field_index(text))]
            arrays = [
                pa.array(map(len, found), pa.int64()),
                pa.array([",".join(sorted({n for _, _, n, _ in f})) for f in found], pa.string()),
                pa.array([",".join(f"{n}:{x}:{y}:{d:.4f}" for x, y, n, d in f) for f in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *new])

    return kept.mapInArrow(run, schema)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
