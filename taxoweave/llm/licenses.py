"""License scans: MinHash bands over overlapping windows of words retrieve templates, containment decides."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .inputs import filled, spread, unfilled
from .words import Rolling, WordHashes, mixed, split

WIDTH = 5
CONTAINED = 0.8
#: A window that holds 0.8 of a template has a Jaccard similarity of 0.5 or more with it (see
#: Templates), so that some band agrees with a probability of 1 - (1 - 0.5**2)**48 > 0.999998.
BANDS, ROWS = 48, 2

#: Notices and license texts as their publishers give them. Lower case and
#: punctuation at the ends of words don't matter.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies.",
    ),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version "
        "3 of the License, or (at your option) any later version.",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
)


def normal_words(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z) without ASCII punctuation at their ends; a word of nothing else stays."""
    return [w.strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") or w for w in (w.lower() for w in split(text))]


def _seeds(n: int) -> np.ndarray:
    return np.random.default_rng(23).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


class Templates:
    """The templates' shingles and the bands of their MinHash signatures, by length of window.

    For a template of L words the windows are L + s words long and begin every s = max(1, L // 4)
    words, so any run of L words lies in one. A window that holds 0.8 of the template's n shingles
    shares 0.8 n with it of at most n + s + 0.2 n, and s is at most n / 4 + 1: for the lengths in use
    a similarity of 0.5 or more.
    """

    def __init__(self, templates: Sequence[tuple[str, str]]):
        self.names, self.lengths, self.grams = [], [], []
        known, roll, hashes = WordHashes(), Rolling(WIDTH), []
        self.bands: dict[int, dict[tuple[int, int, int], list[int]]] = {}
        seeds = _seeds(BANDS * ROWS)
        for name, text in templates:
            words = normal_words(text)
            if len(words) < WIDTH:
                raise ValueError(f"a template needs {WIDTH} words: {text!r}")
            t = len(self.names)
            own = roll.of(known.of(words))
            hashes.append(own)
            self.names.append(name)
            self.lengths.append(len(words))
            self.grams.append({tuple(words[i : i + WIDTH]) for i in range(len(words) - WIDTH + 1)})
            index = self.bands.setdefault(len(words), {})
            sign = signature(own, seeds)
            for b in range(BANDS):
                index.setdefault((b, *(int(x) for x in sign[b * ROWS : (b + 1) * ROWS])), []).append(t)
        self.any = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        self.seeds = seeds


def signature(hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    return mixed(hashes[None, :] ^ seeds[:, None]).min(axis=1)


def scan(words: list[bytes], hashes: np.ndarray, to: Templates) -> list[tuple[str, int, int, float]]:
    """(license, first word, end, containment) of each place that holds 0.8 or more of a template."""
    if not len(hashes) or not len(to.any):
        return []
    at = np.searchsorted(to.any, hashes)
    # a window without a shingle of any template agrees with no template in any band
    known = np.flatnonzero(to.any[np.minimum(at, len(to.any) - 1)] == hashes)
    if not len(known):
        return []
    found = []
    for length, index in to.bands.items():
        step = max(1, length // 4)
        shingles_in = length + step - WIDTH + 1 if length > WIDTH else 1
        starts = np.unique(np.concatenate([np.arange(max(0, -(-(k - shingles_in + 1) // step)), k // step + 1) for k in known])) * step
        best: dict[int, list[tuple[int, int, float]]] = {}
        for start in starts:
            part = hashes[start : start + shingles_in]
            sign = signature(part, to.seeds)
            hit = {t for b in range(BANDS) for t in index.get((b, *(int(x) for x in sign[b * ROWS : (b + 1) * ROWS])), ())}
            for t in hit:
                grams = [tuple(words[i : i + WIDTH]) for i in range(start, start + len(part))]
                places = [i for i, g in enumerate(grams) if g in to.grams[t]]
                share = len({grams[i] for i in places}) / len(to.grams[t])
                if share >= CONTAINED:
                    best.setdefault(t, []).append((int(start + places[0]), int(start + places[-1] + WIDTH), share))
        for t, places in best.items():
            # windows overlap: of places that do too, the fullest and then the first is the match
            kept: list[tuple[int, int, float]] = []
            for p in sorted(places, key=lambda p: (-p[2], p[0], p[1])):
                if all(p[1] <= k[0] or p[0] >= k[1] for k in kept):
                    kept.append(p)
            found += [(to.names[t], *p) for p in kept]
    # templates of one license may match in one place: the longest stands for it
    out: list[tuple[str, int, int, float]] = []
    for m in sorted(found, key=lambda m: (m[1] - m[2], -m[3], m[1], m[0])):
        if all(m[0] != k[0] or m[2] <= k[1] or m[1] >= k[2] for k in out):
            out.append(m)
    return sorted(out, key=lambda m: (m[1], m[0]))


def _scan(batches: Iterable[pd.DataFrame], templates: Sequence[tuple[str, str]]) -> Iterator[pd.DataFrame]:
    to, known, roll = Templates(templates), WordHashes(), Rolling(WIDTH)
    columns = ["doc_id", "__no_id", "license", "start", "end", "containment"]
    for pdf in batches:
        rows = []
        for doc_id, no_id, text in zip(pdf["doc_id"], pdf["__no_id"], pdf["text"], strict=True):
            words = normal_words(text)
            rows += [(doc_id, no_id, *m) for m in scan(words, roll.of(known.of(words)), to)]
        yield pd.DataFrame(rows, columns=columns)


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, license, start, end, containment: a row for each place in docs that holds a template.

    A place counts when it holds 0.8 or more of the template's distinct five-word shingles; start
    and end are word numbers. Overlapping places of one license count once (the longest, then the
    fullest, then the first). Every word of every text is scanned. Null, empty and shorter texts
    hold none; rows without a doc_id are reported with none; repeated rows each report. Each task
    builds the templates' bands from the list, whose size is the caller's and not the data's.
    """
    texts = filled(spread(docs.select("doc_id", "text")))
    return unfilled(texts.mapInPandas(partial(_scan, templates=tuple(templates)), "doc_id long, __no_id boolean, license string, start long, end long, containment double"))


def op10_license_scans(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
