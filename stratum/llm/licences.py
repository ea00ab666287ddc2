"""License scans: a trained paragraph classifier whose predictions templates confirm.

A paragraph is a run of lines without a blank line between. Letters A-Z count as lower
case and ASCII signs other than letters and digits as spaces. Features are word 1- and
2-grams hashed into 2**BITS buckets, weighted 1 / sqrt(number of words). A multinomial
logistic regression with an L1 penalty (few weights stay) is fitted on labelled sentences
that this module makes, none of them from the corpus: cut, thinned and padded versions of
the template sentences of every family, its NAMES in usual FORMS, and for the class
`unknown` made-up words, made-up names in the same forms, near-miss sentences and
shuffled template words. A temperature and an offset of the unknown class are chosen on
held-out rows, so the model is the same for every corpus.

A family predicted for a paragraph with a probability of LEAST or more counts if at least
CONFIRM of the paragraph's word 3-grams (of the whole paragraph if it has fewer words)
occur in that family's templates, or if a window of the paragraph as long as a template
sentence holds that share of the sentence's 3-grams.

As the words around a sentence dilute a paragraph's score, windows are scored too: those
as long as a template sentence that hold CONFIRM of its 3-grams, and those that are a
name in one of the forms, or a name of several words, word by word. Of windows whose
matched words overlap, the longest counts; each that is left gives its family if the
classifier predicts it with LEAST or more, so a line with two licenses gives both.

scan() gives every document: family (of the most probable confirmed paragraph, "none"
without one), families (all confirmed, sorted), paragraph (its number from 0), its
probability and containment, and how many predictions weren't confirmed.

Defined results: null, empty and blank texts have no paragraphs. Texts are read whole,
however long. Ties go to the first paragraph. Repeated rows are scanned each; an empty
table gives an empty table. doc_id may be null. Other columns take no part and may have
any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._io import mapped

BITS = 17
LEAST, CONFIRM = 0.5, 0.6
UNKNOWN = "unknown"

TEMPLATES = {
    "mit": (
        "Released under the MIT License.", "Licensed under the MIT license.", "This project is distributed under the MIT License.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 2.", "Released under the GPL, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 3.", "Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ),
    "agpl": (
        "This work is licensed under the GNU Affero General Public License, version 3.", "Released under the AGPL, version 3.", "SPDX-License-Identifier: AGPL-3.0-only",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "mpl": (
        "Released under the Mozilla Public License, version 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "isc": (
        "Released under the ISC License.", "Licensed under the ISC license.", "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Available under the Creative Commons Attribution License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Available under the Creative Commons Attribution-NonCommercial License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "cc0": ("Released under CC0 1.0.", "Dedicated to the public domain under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "SPDX-License-Identifier: CC0-1.0"),
    "unlicense": ("Released under the Unlicense.", "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0"),
    "cc-by-nd": ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "SPDX-License-Identifier: CC-BY-ND-4.0"),
    "cc-by-nc-sa": ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-SA-4.0"),
    "cc-by-nc-nd": ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-ND-4.0"),
    "boost": ("Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"),
    "zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "SPDX-License-Identifier: Zlib"),
    "artistic": ("This library is free software; you may redistribute it under the terms of the Artistic License 2.0.", "SPDX-License-Identifier: Artistic-2.0"),
    "cddl": ("The contents of this file are subject to the terms of the Common Development and Distribution License.", "SPDX-License-Identifier: CDDL-1.0"),
    "eupl": ("Licensed under the European Union Public Licence, version 1.2.", "SPDX-License-Identifier: EUPL-1.2"),
    "wtfpl": ("Do what the fuck you want to public license.", "SPDX-License-Identifier: WTFPL"),
    "proprietary": ("All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.", "This document is confidential and proprietary. Unauthorized copying is strictly prohibited.", "Copyright by the author. All rights reserved."),
}
NEAR_MISSES = (
    "He lost his driving license and had to take the test again.", "The software is free for students and costs a fee for others.",
    "The license of the restaurant was revoked by the city.", "Version 2.0 of the program was released in spring.", "The public library is open to any person.",
    "The general assembly granted permission to build the road.", "Under the new law the work is done by the state.", "A copy of the book was distributed in the school.",
    "She studied at the university under a famous chemist.", "The fishing license is valid for one year.", "The Apache helicopter was released under fire.",
    "Version 3 of the report was released under pressure.", "Mozilla was founded as a community.", "The creative commons of the town is a meadow.",
    "Students of MIT released their robots.", "All rights of the people shall be protected by law.", "A general public discussion of the GNU was held at the zoo.",
)
#: Of each family, names as they are written after folding.
NAMES = {
    "mit": "mit|mit license|mit licence|expat license", "apache": "apache license|apache 2 0|apache license 2 0|apache license version 2 0|apache software license|apache v2|apache 2",
    "bsd": "bsd|bsd license|bsd style license|bsd 3 clause|bsd 2 clause|3 clause bsd|2 clause bsd|3 clause bsd license|2 clause bsd license|bsd 3 clause license|bsd 2 clause license|new bsd license|simplified bsd license|modified bsd license",
    "gpl": "gpl|gnu gpl|gplv2|gplv3|gpl v2|gpl v3|gpl 2|gpl 3|gpl version 2|gpl version 3|gpl 2 0|gpl 3 0|gnu gpl v2|gnu gpl v3|gnu gplv2|gnu gplv3|gnu general public license|gnu general public license v2|gnu general public license v3|gnu general public license version 2|gnu general public license version 3",
    "lgpl": "lgpl|gnu lgpl|lgplv2|lgplv3|lgpl v2 1|lgpl v3|lgpl 2 1|lgpl 3 0|gnu lesser general public license|lesser general public license|gnu library general public license", "agpl": "agpl|gnu agpl|agplv3|agpl v3|agpl 3 0|gnu affero general public license|affero general public license",
    "mpl": "mpl|mpl 2 0|mpl 1 1|mozilla public license|mozilla public license 2 0|mozilla public license version 2 0", "isc": "isc|isc license", "epl": "epl|epl 2 0|epl 1 0|eclipse public license|eclipse public license 2 0|eclipse public license v 2 0|eclipse public license version 2 0|eclipse public license v2 0",
    "cc-by": "cc by|cc by 4 0|cc by 3 0|creative commons attribution|creative commons attribution license|creative commons attribution 4 0|creative commons attribution 4 0 international|creative commons attribution 3 0", "cc-by-sa": "cc by sa|cc by sa 4 0|cc by sa 3 0|creative commons attribution sharealike|creative commons attribution share alike|creative commons attribution sharealike 4 0",
    "cc-by-nc": "cc by nc|cc by nc 4 0|cc by nc 3 0|creative commons attribution noncommercial|creative commons attribution non commercial|creative commons attribution noncommercial 4 0", "cc-by-nd": "cc by nd|cc by nd 4 0|creative commons attribution noderivatives|creative commons attribution no derivatives",
    "cc-by-nc-sa": "cc by nc sa|cc by nc sa 4 0|creative commons attribution noncommercial sharealike", "cc-by-nc-nd": "cc by nc nd|cc by nc nd 4 0|creative commons attribution noncommercial noderivatives", "cc0": "cc0|cc0 1 0|cc0 1 0 universal|creative commons zero", "unlicense": "unlicense|the unlicense",
    "boost": "boost software license|boost license|bsl 1 0", "zlib": "zlib license|zlib libpng license", "artistic": "artistic license|artistic license 2 0|perl artistic license", "cddl": "cddl|cddl 1 0|common development and distribution license", "eupl": "eupl|eupl 1 2|european union public licence", "wtfpl": "wtfpl",
}
FORMS = (
    "licensed under {}", "licensed under the {}", "released under {}", "released under the {}", "distributed under {}", "distributed under the {}", "available under {}", "available under the {}", "published under the {}",
    "under the terms of {}", "under the terms of the {}", "license {}", "licence {}", "license identifier {}", "licensed {}", "{} licensed", "is {} licensed", "covered by the {}", "governed by the {}", "subject to the {}", "use is subject to the {}",
)
FAMILIES = (*TEMPLATES, UNKNOWN)


def forms(family: str) -> dict[str, str]:
    """Names in forms as they are matched, word by word, and a sentence with each to fit on."""
    out = {}
    for name in filter(None, NAMES.get(family, "").split("|")):
        for form in FORMS:
            out[form.format(name)] = form.format(name)
        if " " in name:
            out[name] = name
    return out


class Words:
    """The words of the paragraphs of a string array: hashes, paragraph of each word, document of each paragraph."""

    def __init__(self, column: pa.Array):
        raw, offsets = T.buffers(column)
        raw = T.FOLD[raw]
        edges = np.union1d(offsets[:-1], np.flatnonzero(raw == 10) + 1) if len(raw) else np.zeros(0, np.int64)
        edges = edges[edges < len(raw)]
        starts, ends, line = T.words(raw, np.r_[edges, len(raw)])
        self.hashes = T.span_hashes(raw, starts, ends)
        new = np.r_[True, line[1:] != line[:-1]] if len(line) else np.zeros(0, bool)  # blank lines hold no words
        document = np.searchsorted(offsets, edges[line[new]], "right") - 1
        apart = np.r_[True, (np.diff(line[new]) > 1) | (np.diff(document) > 0)] if len(document) else np.zeros(0, bool)
        self.paragraph = np.repeat(np.cumsum(apart) - 1, np.diff(np.r_[np.flatnonzero(new), len(line)]))
        self.document = document[apart]
        self.counts = np.bincount(self.paragraph, minlength=len(self.document))

    @classmethod
    def spans(cls, words: Words, starts: np.ndarray, ends: np.ndarray) -> Words:
        """Spans of words as paragraphs, of the document of their first word."""
        out = cls.__new__(cls)
        out.counts = ends - starts
        out.paragraph = np.repeat(np.arange(len(starts)), out.counts)
        out.hashes = words.hashes[np.arange(out.counts.sum()) + np.repeat(starts - np.cumsum(out.counts) + out.counts, out.counts)]
        out.document = words.document[words.paragraph[starts]]
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and paragraph of every word and every pair of neighbours."""
        h, of = self.hashes, self.paragraph
        same = of[1:] == of[:-1] if len(of) else np.zeros(0, bool)
        two = T.mix(h[:-1] * np.uint64(0x9FB21C651E98DF25) + h[1:] * np.uint64(0xD6E8FEB86659FD93))[same]
        return (np.r_[T.mix(h), two] >> np.uint64(64 - BITS)).astype(np.int64), np.r_[of, of[:-1][same]]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Model:
    """Sparse weights: place maps a bucket to a row of `weights`, or to the last, a row of zeros."""

    def __init__(self):
        self.place, self.weights, self.bias, self.temperature = np.zeros(1 << BITS, np.int32), np.zeros((1, len(FAMILIES)), np.float32), np.zeros(len(FAMILIES)), 1.0
        self.sentences: list[tuple[int, np.ndarray, int]] = []
        self.grams: dict[int, np.ndarray] = {}
        #: family, 3-grams (or the one 2-gram), words, and whether all of them must be there
        self.patterns: list[tuple[int, np.ndarray, int, bool]] = []
        for k, family in enumerate(TEMPLATES):
            words = Words(pa.array(TEMPLATES[family]))
            grams, owner = T.ngrams(words.hashes, words.paragraph, 3)
            self.grams[k] = np.unique(grams)
            for i in range(len(TEMPLATES[family])):
                self.sentences.append((k, np.unique(grams[owner == i]), int(words.counts[i])))
            for texts, exact in ((sorted({x for t in TEMPLATES[family] for x in (t, *t.split(". "))}), False), (sorted(forms(family)), True)):
                if not texts:
                    continue
                parts = Words(pa.array(texts))
                for n in (2, 3):
                    grams, owner = T.ngrams(parts.hashes, parts.paragraph, n)
                    self.patterns += [(k, np.unique(grams[owner == i]), int(c), exact) for i, c in enumerate(parts.counts) if (c == 2 if n == 2 else c >= 3)]
        self.known = [np.unique(np.concatenate([g for _, g, c, _ in self.patterns if (c == 2) == (n == 2)])) for n in (2, 3)]

    def logits(self, words: Words) -> np.ndarray:
        bucket, of = words.pairs()
        row = self.place[bucket]
        some = row < len(self.weights) - 1
        row, of = row[some], of[some]
        n = len(words.counts)
        out = np.stack([np.bincount(of, weights=self.weights[row, k], minlength=n) for k in range(len(FAMILIES))], axis=1) if n else np.zeros((0, len(FAMILIES)))
        return out / np.sqrt(np.maximum(words.counts, 1))[:, None] + self.bias

    def probabilities(self, words: Words) -> np.ndarray:
        return _softmax(self.logits(words) / self.temperature)

    def fit(self, words: Words, classes: np.ndarray, epochs: int = 80, rate: float = 0.1, penalty: float = 3e-5) -> Model:
        """By proximal full-batch steps (Adam, then soft thresholding); a fifth of the rows is held out for calibration."""
        held = np.arange(len(classes)) % 5 == 4
        bucket, of = words.pairs()
        key, times = np.unique(of << BITS | bucket, return_counts=True)
        of, bucket = key >> BITS, key & ((1 << BITS) - 1)
        used, place = np.unique(bucket, return_inverse=True)
        value = times / np.sqrt(np.maximum(words.counts, 1))[of]
        train = ~held[of]
        row, col, x = of[train], place[train], value[train]
        n, k = len(classes), len(FAMILIES)
        w, b = np.zeros((len(used), k)), np.zeros(k)
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros(k), np.zeros(k)
        want, size = np.eye(k)[classes], max(int((~held).sum()), 1)
        for step in range(1, epochs + 1):
            scores = np.stack([np.bincount(row, weights=w[col, j] * x, minlength=n) for j in range(k)], axis=1) + b
            off = np.where(held[:, None], 0, _softmax(scores) - want) / size
            grad = np.stack([np.bincount(col, weights=off[row, j] * x, minlength=len(used)) for j in range(k)], axis=1)
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            scale = rate / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
            w = w - scale * m / (1 - 0.9**step)
            w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(scale * penalty, rate), 0)
            gb = off.sum(axis=0)
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            b = b - rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
        some = np.flatnonzero(np.abs(w).max(axis=1, initial=0) > 0)
        self.weights = np.r_[w[some], np.zeros((1, k))].astype(np.float32)
        self.place = np.full(1 << BITS, len(some), np.int32)
        self.place[used[some]] = np.arange(len(some))
        self.bias = b
        z, t = self.logits(words)[held], classes[held]
        if len(t):
            best = (np.inf, 1.0, 0.0)
            for temperature in np.geomspace(0.1, 4, 25):
                for offset in np.linspace(-3, 3, 13):
                    moved = z + offset * (np.arange(k) == k - 1)
                    p = _softmax(moved / temperature)[np.arange(len(t)), t]
                    best = min(best, (float(-np.log(np.maximum(p, 1e-12)).mean()), float(temperature), float(offset)))
            self.temperature = best[1]
            self.bias = b + best[2] * (np.arange(k) == k - 1)
        return self

    def containment(self, hashes: np.ndarray, k: int) -> float:
        """The share of the paragraph's 3-grams in the family's templates, or of a sentence's in the best window of its length."""
        grams, _ = T.ngrams(hashes, np.zeros(len(hashes), np.int64), 3)
        share = float(np.isin(grams, self.grams[k]).mean()) if len(grams) else 0.0
        if len(hashes) >= 3:
            for family, sentence, n in self.sentences:
                if family == k and n <= len(hashes) and n >= 5:
                    hit = np.isin(grams, sentence).astype(np.int64)
                    total = np.r_[0, np.cumsum(hit)]
                    width = min(n - 2, len(grams))
                    share = max(share, min(1.0, float((total[width:] - total[:-width]).max()) / len(sentence)))
        return share


    def windows(self, words: Words) -> list[tuple[int, int, float, float]]:
        """Paragraph of the first word, family, probability and containment of every confirmed window."""
        found = []
        for size, known in zip((2, 3), self.known, strict=True):
            of = words.paragraph
            if len(of) < size:
                continue
            grams, _ = T.ngrams(words.hashes, np.zeros(len(of), np.int64), size)
            at = np.flatnonzero(of[size - 1 :] == of[: len(of) - size + 1])  # the first word of every gram
            grams = grams[at]
            hit = np.isin(grams, known)
            grams, at = grams[hit], at[hit]
            if not len(at):
                continue
            order = np.argsort(grams, kind="stable")
            by, first = np.unique(grams[order], return_index=True)
            close = np.searchsorted(of, of[at], "right")  # where the paragraph ends
            for k, sentence, n, exact in self.patterns:
                if (n == 2) != (size == 2):
                    continue
                places = np.searchsorted(by, sentence)
                places = places[(places < len(by)) & (by[np.minimum(places, len(by) - 1)] == sentence)]
                share = 1.0 if exact else CONFIRM
                if len(places) < share * len(sentence):
                    continue
                own = np.sort(np.concatenate([order[first[i] : first[i + 1] if i + 1 < len(by) else len(order)] for i in places]))
                g, start, end = grams[own], at[own], close[own]
                to = np.searchsorted(start, np.minimum(start + n, end) - size, "right")
                for i in np.flatnonzero(to - np.arange(len(g)) >= share * len(sentence)):
                    matched = len(np.unique(g[i : to[i]]))
                    if matched >= share * len(sentence):
                        last = int(start[to[i] - 1]) + size
                        found.append((int(start[i]) - last, -matched / len(sentence), int(start[i]), last, int(min(start[i] + n, end[i])), k))
        taken, kept = np.zeros(len(words.hashes), bool), []
        for x in sorted(found):
            if not taken[x[2] : x[3]].any():
                taken[x[2] : x[3]] = True
                kept.append(x)
        if not kept:
            return []
        _, share, start, core, end, family = (np.array(x) for x in zip(*kept, strict=True))
        n = len(start)
        p = self.probabilities(Words.spans(words, np.r_[start, start], np.r_[core, end]))
        p = np.where(p.argmax(axis=1) == np.r_[family, family], p[np.arange(2 * n), np.r_[family, family]], 0).reshape(2, n).max(axis=0)
        return [(int(words.paragraph[start[i]]), int(family[i]), float(p[i]), float(-share[i])) for i in np.flatnonzero(p >= LEAST)]


def _made_up(r: np.random.Generator, n: int) -> list[str]:
    """Words of random letters."""
    return ["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), int(r.integers(3, 10)))) for _ in range(n)]


def examples(seed: int = 5, each: int = 16) -> tuple[list[str], list[int]]:
    """Sentences and classes to fit on; the same ones every time."""
    r = np.random.default_rng(seed)
    common = [w for t in NEAR_MISSES for w in t.split()]
    filler = [*_made_up(r, 4000), *common * 5]
    pick = lambda words, n: [words[i] for i in r.integers(0, len(words), n)]
    texts, classes = [], []
    for k, family in enumerate(TEMPLATES):
        for sentence in TEMPLATES[family]:
            words = sentence.split()
            for i in range(each):
                part = words
                if i % 4 == 1 and len(words) > 10:  # a contiguous piece
                    n = int(r.integers(max(8, len(words) // 2), len(words) + 1))
                    low = int(r.integers(0, len(words) - n + 1))
                    part = words[low : low + n]
                if i % 4 == 2 and len(words) > 8:  # thinned
                    part = [w for w in words if r.random() > 0.08]
                if i % 4 == 3:  # within other words
                    before, after = r.integers(0, 12, 2)
                    part = [*pick(filler, before), *words, *pick(filler, after)]
                texts.append(" ".join(part))
                classes.append(k)
            words = [w for s in TEMPLATES[family] for w in s.split()]
            for _ in range(2):
                texts.append(" ".join(r.choice(words, min(len(words), int(r.integers(4, 12))))))
                classes.append(len(FAMILIES) - 1)
        for sentence in forms(family):  # twice, as a fifth of all is held out
            texts += [sentence, sentence]
            classes += [k, k]
    texts += [f.format(" ".join(pick(filler, int(r.integers(1, 4))) + ["license"] * int(r.integers(0, 2)))) for f in FORMS for _ in range(30)]
    texts += NEAR_MISSES * 4
    texts += [" ".join(pick(filler, int(r.integers(1, 60)))) for _ in range(1500)]
    classes += [len(FAMILIES) - 1] * (len(texts) - len(classes))
    order = r.permutation(len(texts))
    return [texts[i] for i in order], [classes[i] for i in order]


@lru_cache(1)
def train() -> Model:
    texts, classes = examples()
    words = Words(pa.array([t.replace("\n", " ") for t in texts]))
    return Model().fit(words, np.array(classes)[words.document])


_OUT = "n_paragraphs long, family string, families array<string>, paragraph long, probability double, containment double, unconfirmed long"


def scanned(column: pa.Array, model: Model) -> list[tuple]:
    """n_paragraphs, family, families, paragraph, probability, containment, unconfirmed of every text."""
    words = Words(column)
    per = np.bincount(words.document, minlength=len(column))
    out: list[list] = [[int(n), "none", [], None, None, None, 0] for n in per]
    if len(words.counts):
        p = model.probabilities(words)
        best = p[:, :-1].argmax(axis=1)
        top = p[np.arange(len(p)), best]
        first = np.cumsum(per) - per
        edges = np.r_[0, np.cumsum(words.counts)]
        found = model.windows(words)
        for i in np.flatnonzero(top >= LEAST):
            share = model.containment(words.hashes[edges[i] : edges[i + 1]], int(best[i]))
            if share < CONFIRM:
                out[int(words.document[i])][6] += 1
            else:
                found.append((int(i), int(best[i]), float(top[i]), share))
        for i, k, chance, share in sorted(found):
            d = int(words.document[i])
            row = out[d]
            row[2] = sorted({*row[2], FAMILIES[k]})
            if row[4] is None or chance > row[4]:
                row[1], row[3], row[4], row[5] = FAMILIES[k], int(i - first[d]), chance, share
    return [tuple(x) for x in out]


def _scanner(model):
    kinds = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
    names = ["doc_id", "n_paragraphs", "family", "families", "paragraph", "probability", "containment", "unconfirmed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in T.slices(batch.column(1)):
                rows = scanned(batch.column(1).slice(a, b - a), model.value)
                yield pa.record_batch([batch.column(0).slice(a, b - a), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    return run


def scan(docs: DataFrame) -> DataFrame:
    """A row for every document; see the module's text."""
    model = docs.sparkSession.sparkContext.broadcast(train())
    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), _scanner(model), f"doc_id {kind}, {_OUT}")
