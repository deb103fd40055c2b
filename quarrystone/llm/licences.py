"""Licence scans: a trained paragraph classifier, confirmed by templates.

Paragraphs (lines, and blocks of lines between those without words; long ones in
overlapping windows) are scored by a softmax
regression over hashed word n-grams, with a class for each licence family and
one for text of no known licence. It is learnt from short notices of each
family, varied by rule, and from a bounded sample of the corpus' own
paragraphs as the unknown class; a temperature fitted on held-out ones
calibrates it. A prediction counts where it is confident and one of the
family's templates shares enough word n-grams with the paragraph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.words import ALNUM, Words, grams, pieces
from quarrystone.sources.tables import table

#: Notices by which works name their licence, and sentences of the licences' own texts, by family.
TEMPLATES: dict[str, list[str]] = {
    "agpl": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Licensed under the MIT license. See the LICENSE file for details.",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Released under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "public-domain": [
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "This work has been released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "reserved": [
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without permission.",
    ],
}
#: The short forms in which people name a licence, with and without versions, by family.
SHORT: dict[str, list[str]] = {
    "agpl": ["Licensed under the AGPLv3", "AGPLv3 or later", "the GNU AGPL v3", "under the terms of the GNU AGPL"],
    "apache": ["is Apache 2.0 licensed", "the Apache License 2.0", "under the Apache 2.0 license", "under the terms of the Apache License"],
    "bsd": ["is BSD licensed", "the BSD 3-Clause License", "the BSD 2-Clause License", "under the terms of the BSD license"],
    "cc-by": ["under CC BY 3.0", "under the Creative Commons Attribution License", "Creative Commons Attribution 3.0 Unported"],
    "cc-by-nc": ["under CC BY-NC 3.0", "under the Creative Commons Attribution-NonCommercial License", "Creative Commons Attribution-NonCommercial 3.0 Unported"],
    "cc-by-nc-nd": ["under CC BY-NC-ND 3.0", "under CC BY-NC-ND 4.0", "under the Creative Commons Attribution-NonCommercial-NoDerivatives License", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "cc-by-nc-sa": ["under CC BY-NC-SA 3.0", "under CC BY-NC-SA 4.0", "under the Creative Commons Attribution-NonCommercial-ShareAlike License", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "cc-by-nd": ["under CC BY-ND 3.0", "under CC BY-ND 4.0", "under the Creative Commons Attribution-NoDerivatives License", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc-by-sa": ["under CC BY-SA 3.0", "under the Creative Commons Attribution-ShareAlike License", "Creative Commons Attribution-ShareAlike 3.0 Unported"],
    "gpl": ["Licensed under GPLv2", "Licensed under the GPLv3", "GPLv2 or later", "GPLv3 or later", "the GNU GPL v3", "the GNU GPL version 2", "under the terms of the GNU GPL", "under the terms of the GPL"],
    "lgpl": ["Licensed under the LGPLv3", "LGPLv2.1 or later", "the GNU LGPL v3", "under the terms of the GNU LGPL"],
    "mit": ["is MIT licensed", "the MIT License", "under the terms of the MIT license"],
    "mpl": ["is MPL 2.0 licensed", "under the MPL 2.0", "the Mozilla Public License 2.0", "under the terms of the Mozilla Public License"],
    "public-domain": ["placed in the public domain", "in the public domain under CC0", "under CC0 1.0", "donated to the public domain"],
}
#: Words of the short forms that name no licence.
ORDINARY = ["under", "the", "terms", "of", "is", "or", "later", "in", "to", "licensed", "license", "version"]
for _family, _forms in SHORT.items():
    TEMPLATES[_family] = TEMPLATES.get(_family, []) + _forms
#: Text that speaks of licences, rights and works but grants none.
OTHER = [
    "A driving licence must be renewed every ten years at the general office.",
    "The public library is free and open to all on Sundays.",
    "The author released a new version of the work under a different title.",
    "All rights of way must be kept clear.",
    "Permission to enter the building is granted by the person at the desk.",
    "The Apache helicopter and its general crew were public news.",
    "Students of MIT released a study of the source of the river.",
    "The committee reserved all seats for members of the public.",
    "The terms of the agreement were published by the foundation.",
    "Creative work in common rooms is welcome.",
    "Under the terms of the treaty the general may license the sale.",
    "The licensed driver of MIT was under the age of twenty or later.",
    "Available under the counter, version 2.0 of the game is distributed by a clause of the contract.",
    "The attribution of the painting to the Mozilla of his time is uncommon.",
]
FAMILIES = sorted(TEMPLATES)
WINDOW, STEP = 64, 32
LAST = (1 << 16) - 1
SEEDS = [np.uint64(0xA24BAED4963EE407 * (i + 1) % 2**64) for i in range(3)]


def words_of(text: str) -> Words:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return Words(raw, np.array([0, len(raw)]), ALNUM)


def gram_features(h: np.ndarray) -> list[np.ndarray]:
    """Feature numbers of the runs of one, two and three words that start at each word."""
    return [((grams(h, k) ^ s) & np.uint64(LAST)).astype(np.int64) for k, s in zip((1, 2, 3), SEEDS, strict=True)]


def units(w: Words, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of each paragraph with words, or of its windows."""
    if not len(w):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return windows(w, lines(w, raw), 0)


def blocks(w: Words, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of each run of lines with words, or of its windows; those within a line are left to ``units``."""
    if not len(w):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    line = lines(w, raw)
    starts, ends = windows(w, line, 1)
    several = line[starts] < line[ends - 1]
    return starts[several], ends[several]


def lines(w: Words, raw: np.ndarray) -> np.ndarray:
    """The line of each word."""
    return np.searchsorted(np.flatnonzero(raw == 10), w.starts)


def windows(w: Words, line: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """The words cut where lines are more than ``apart`` from each other and at texts' ends, long parts in windows."""
    cuts = np.concatenate([[0], np.flatnonzero((np.diff(line) > apart) | (np.diff(w.doc()) > 0)) + 1, [len(w)]])
    starts, ends = cuts[:-1], cuts[1:]
    long = np.flatnonzero(ends - starts > WINDOW)
    if len(long):
        more = [np.arange(starts[i], max(starts[i] + 1, ends[i] - STEP), STEP) for i in long]
        more_ends = [np.minimum(m + WINDOW, ends[i]) for m, i in zip(more, long, strict=True)]
        short = np.setdiff1d(np.arange(len(starts)), long)
        starts, ends = np.concatenate([starts[short], *more]), np.concatenate([ends[short], *more_ends])
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
    return starts, ends


def unit_scores(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mean weights of the features of each unit, by class."""
    out = np.zeros((len(starts), weights.shape[1]))
    if not len(starts):
        return out
    for k, f in enumerate(gram_features(h), 1):
        # Running sums over the words, so that overlapping windows cost no more.
        sums = np.zeros((len(h) + 1, weights.shape[1]))
        np.cumsum(weights[f], axis=0, out=sums[1 : len(f) + 1])
        sums[len(f) + 1 :] = sums[len(f)]
        stop = np.maximum(starts, ends - k + 1)
        out += (sums[stop] - sums[starts]) / np.sqrt(np.maximum(1, stop - starts))[:, None]
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def variants(text: str, filler: list[str], rng: np.random.Generator) -> Iterator[str]:
    """A notice as it may stand: alone, cut, with words changed, or within other text."""
    own = text.split(" ")
    yield text
    for _ in range(12 if len(own) > 8 else 8):
        w = list(own)
        if len(w) > 6 and rng.random() < 0.5:
            w[int(rng.integers(len(w)))] = str(rng.choice(filler))
        if len(w) > 9 and rng.random() < 0.3:
            w = w[: len(w) - int(rng.integers(1, 3))]
        most = 50 if rng.random() < 0.3 else 9  # as in a long paragraph's window
        before, after = (list(rng.choice(filler, int(rng.integers(0, most)))) for _ in range(2))
        yield " ".join([*before, *w, *after])


class Licences:
    """Weights, temperature and templates."""

    def __init__(self, sample: list[str], rounds: int = 60, seed: int = 1):
        rng = np.random.default_rng(seed)
        filler = [w for t in sample for w in t.split()[:40]][:4000] or ["the", "of", "work"]
        texts, classes, apart = [], [], []
        for c, family in enumerate(FAMILIES):
            for i, t in enumerate(TEMPLATES[family]):
                made = list(variants(t, filler, rng))
                texts += made
                classes += [c] * len(made)
                apart += [i % 3 == 2] * len(made)  # whole templates
        plain = [t for text in OTHER for t in variants(text, filler, rng)]
        plain += [t for t in sample if t.strip() and not self.resembles(t)]
        texts += plain
        classes += [len(FAMILIES)] * len(plain)
        apart += [i % 3 == 2 for i in range(len(plain))]
        rows = [words_of(t) for t in texts]
        h = np.concatenate([w.hashes() for w in rows])
        ends = np.cumsum([len(w) for w in rows])
        starts = ends - np.array([len(w) for w in rows])
        y, held = np.eye(len(FAMILIES) + 1)[classes], np.array(apart)
        weight = 1 / np.bincount(classes, minlength=len(FAMILIES) + 1)[classes]
        weight *= len(texts) / weight.sum()
        # Features in use, by unit, for descent on the weights (AdaGrad).
        unit, number, value = [], [], []
        for k, f in enumerate(gram_features(h), 1):
            for i, (a, b) in enumerate(zip(starts.tolist(), np.maximum(starts, ends - k + 1).tolist(), strict=True)):
                part = f[a:b]
                unit.append(np.full(len(part), i))
                number.append(part)
                value.append(np.full(len(part), 1 / np.sqrt(max(1, b - a))))
        unit, number, value = np.concatenate(unit), np.concatenate(number), np.concatenate(value)
        used, number = np.unique(number, return_inverse=True)
        order = np.argsort(number, kind="stable")
        first = np.searchsorted(number[order], np.arange(len(used)))
        unit_order = np.argsort(unit, kind="stable")
        by_unit = np.concatenate([[0], np.flatnonzero(np.diff(unit[unit_order])) + 1])
        has = np.unique(unit)
        y, weight, value = (x.astype(np.float32) for x in (y, weight, value))
        numbers, values = number[unit_order], value[unit_order, None]
        units_by_number, values_by_number = unit[order], value[order, None]

        def scored(w: np.ndarray) -> np.ndarray:
            scores = np.zeros_like(y)
            scores[has] = np.add.reduceat(w[numbers] * values, by_unit, axis=0)
            return scores

        def learnt(rows: np.ndarray) -> np.ndarray:
            w, square = np.zeros((len(used), y.shape[1]), np.float32), np.full((len(used), y.shape[1]), 1e-8, np.float32)
            for _ in range(rounds):
                miss = (softmax(scored(w)) - y) * (rows * weight)[:, None]
                slope = np.add.reduceat(miss[units_by_number] * values_by_number, first, axis=0) + np.float32(1e-3) * w
                square += slope**2
                w -= np.float32(0.3) * slope / np.sqrt(square)
            return w

        # The temperature is set on templates that its weights have not seen; the weights in use are of all.
        scores = scored(learnt(~held))[held]
        loss = lambda t: -(np.log(np.maximum(1e-12, softmax(scores * t))) * y[held]).sum(axis=1) @ weight[held]
        self.heat = min((float(t) for t in np.geomspace(0.2, 5, 40)), key=loss)
        self.weights = np.zeros((LAST + 1, y.shape[1]), dtype=np.float32)
        self.weights[used] = learnt(np.ones(len(y), dtype=bool))

    @staticmethod
    def resembles(text: str) -> bool:
        return max(agreement(words_of(text).hashes(), f) for f in FAMILIES) >= 0.3


_templates: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}


def pairs_of(family: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each template of a family its distinct word pairs, and of a short form those of them that name the licence: not of ordinary words alone, nor with a version's number."""
    if family not in _templates:
        ordinary = np.concatenate([words_of(w).hashes() for w in ORDINARY])
        made = []
        for text in TEMPLATES[family]:
            h = words_of(text).hashes()
            pairs = grams(h, min(2, len(h)))
            numbers = np.isin(h, np.concatenate([words_of(str(n)).hashes() for n in range(10)]))
            plain = np.isin(h, ordinary)
            names = ~(plain[:-1] & plain[1:] | numbers[:-1] | numbers[1:]) & (text in SHORT.get(family, ()))
            made.append((np.unique(pairs), np.unique(pairs[: len(names)][names])))
        _templates[family] = made
    return _templates[family]


def agreement(h: np.ndarray, family: str) -> float:
    """Share of a template's word pairs that a paragraph has, and no more than its share of those that name the licence, for the best of the family's templates."""
    own = np.unique(grams(h, 2))

    def share(pairs: np.ndarray) -> float:
        return len(np.intersect1d(own, pairs, assume_unique=True)) / len(pairs) if len(pairs) else 1.0

    return max(min(share(pairs), share(names)) for pairs, names in pairs_of(family))


def fewest(confirmed: float) -> tuple[np.ndarray, int]:
    """All word pairs of templates, sorted, and how many of them a paragraph must have to confirm any template."""
    every = [pairs for f in FAMILIES for pairs, _ in pairs_of(f)]
    return np.unique(np.concatenate(every)), min(int(np.ceil(confirmed * len(t))) for t in every)


SPANS = pa.list_(pa.struct([("family", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64()), ("agreement", pa.float64())]))


def scan(docs: DataFrame, model: Licences, threshold: float = 0.15, confirmed: float = 0.6, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, n_paragraphs and the licences found.

    n_paragraphs: lines with words. licences: family,
    start and end (bytes of the UTF-8 text), probability, and agreement with
    the family's nearest template, by place. Probabilities are calibrated on
    templates not learnt from, and so low for known ones: where a
    family reaches ``threshold``, of those of a hundredth or more the one
    whose template agrees most counts, if it confirms. A block of lines counts where it
    has a notice beside those that single lines hold. Null and empty
    texts have none. Own columns of these names give way. An empty table gives
    no rows. Each text is scanned whole and alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.heat))
    docs = docs.drop("n_paragraphs", "licences")
    at_text = docs.columns.index(text_col)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, heat = shared.value
        pairs, least = fewest(confirmed)
        for batch in batches:
            n, found = np.zeros(batch.num_rows, dtype=np.int64), [[] for _ in range(batch.num_rows)]
            for lo, _, raw, at in pieces(batch.column(at_text), 1 << 18):
                w = Words(raw, at, ALNUM)
                h = w.hashes()
                starts, ends = units(w, raw)
                if len(w):
                    doc, line = w.doc(), lines(w, raw)
                    new = np.concatenate([[True], (np.diff(doc) > 0) | (np.diff(line) > 0)])
                    n[lo : lo + len(at) - 1] += np.bincount(doc[new], minlength=len(at) - 1)
                # Pairs of templates before each word, so that windows without enough of them need no comparison.
                known = np.concatenate([[0], np.cumsum(np.isin(grams(h, 2), pairs)), [0]])
                covered = {}  # by family, the words of notices within one line
                hits: list[tuple[int, dict]] = []
                for block, (starts, ends) in enumerate(((starts, ends), blocks(w, raw))):
                    if not len(starts):
                        continue
                    chance = softmax(unit_scores(h, starts, ends, weights) * heat)
                    enough = known[np.maximum(starts, ends - 1)] - known[starts] >= least
                    for i in np.flatnonzero(enough & (chance[:, :-1].max(axis=1) >= threshold)).tolist():
                        a, b = int(starts[i]), int(ends[i])
                        same, _, best = max((agreement(h[a:b], FAMILIES[c]), chance[i, c], c) for c in np.flatnonzero(chance[i, :-1] >= 0.01).tolist())
                        if same < confirmed:
                            continue
                        family = FAMILIES[best]
                        own = covered.setdefault(family, np.zeros(len(h), dtype=bool))
                        if not block:
                            own[a:b] = True
                        elif own[a:b].any() and (same := agreement(h[a:b][~own[a:b]], family)) < confirmed:
                            continue
                        doc = int(np.searchsorted(w.first, a, side="right")) - 1
                        hits.append((lo + doc, {"family": family, "start": int(w.starts[a] - at[doc]), "end": int(w.ends[b - 1] - at[doc]), "probability": float(chance[i, best]), "agreement": float(same)}))
                for doc, hit in sorted(hits, key=lambda x: (x[0], x[1]["start"], x[1]["end"])):
                    found[doc].append(hit)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array(found, SPANS)], names=[*batch.schema.names, "n_paragraphs", "licences"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(find, f"{kinds}, n_paragraphs long, licences array<struct<family:string,start:long,end:long,probability:double,agreement:double>>")


def paragraph_sample(docs: DataFrame, documents: int = 400, each: int = 3, longest: int = 2_000) -> list[str]:
    """Some paragraphs of the documents that come first by hash: a bounded sample of the unknown class.

    A cutoff of the hash, from the number of rows, lets about twice as many
    different texts through; equal texts count once. So the driver gets no more
    from a larger table.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: F.char_length(x).between(1, longest))
    cutoff = int(min(1.0, 2 * documents / max(1, docs.count())) * 2**63)
    place = F.col("place")
    some = docs.where("text IS NOT NULL").select(F.xxhash64("text").bitwiseAND(2**63 - 1).alias("place"), "text").where(place <= min(cutoff, 2**63 - 1))
    first = some.groupBy("place").agg(F.min(F.slice(lines, 1, each)).alias("lines")).orderBy("place").limit(documents)
    return [line for r in first.collect() for line in r["lines"]]


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that every document names."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, Licences(paragraph_sample(docs)))
    return found.select("doc_id", "n_paragraphs", F.size("licences").cast("long").alias("n_licences"), F.array_join(F.array_sort(F.array_distinct("licences.family")), ",").alias("families"), "licences")
