"""Licence notices by the Dice coefficient of word bigrams.

Texts and templates are normalised alike: lower case, words of letters, digits and characters beyond ASCII.  A
window of a text matches a template if twice their common bigrams (with multiplicity), over the bigrams of both, is
at least ``DICE``.  That bounds the window's size to DICE / (2 - DICE) up to (2 - DICE) / DICE times the template's, and a
window of the best coefficient begins and ends at bigrams of the template, so from each such bigram all others within the
greatest size are taken as ends, the common bigrams counted on the way.  A begin is left out where too few bigrams of
the template follow to reach the coefficient.

Defined results: null and empty texts match nothing; a text of one word has no bigram and matches nothing; of windows
with the same coefficient the first counts; of all overlapping windows the better one, then the best of a licence; a repeated document is reported once per row; null ids are carried;
further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect
from collections import Counter, defaultdict
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptloom.llm.common import whole_text
from conceptloom.llm.decontamination import Text, _rolled

DICE = 0.8
_FOUND = "array<struct<license: string, dice: double, start: bigint, n_words: bigint>>"

# Public notices by SPDX identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
                "this work."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
                "option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
                 "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
                 "(at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
                 "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
                 "(at your option) any later version."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions: The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS "
            "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
            "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
            "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
            "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                  "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
                  "binary, for any purpose, commercial or non-commercial, and by any means."),
)


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:], strict=False))


def dice(a: Counter, b: Counter) -> float:
    total = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / total if total else 0.0


class Templates:
    def __init__(self, templates, least: float):
        self.least, self.names = least, [n for n, _ in templates]
        texts = [Text(t) for _, t in templates]
        self.grams = [bigrams(t.words()) for t in texts]
        self.by_hash = defaultdict(set)
        for j, t in enumerate(texts):
            for h in _rolled(t.hashes, 2).tolist():
                self.by_hash[h].add(j)
        hashes = np.array(list(self.by_hash), np.uint64)
        self.table = np.bincount((hashes >> np.uint64(44)).astype(np.int64), minlength=1 << 20) > 0

    def search(self, text: str) -> list[dict]:
        words, places = Text(text), defaultdict(list)
        h = _rolled(words.hashes, 2)
        at = np.flatnonzero(self.table[(h >> np.uint64(44)).astype(np.int64)])
        for p, x in zip(at.tolist(), h[at].tolist(), strict=True):
            for j in self.by_hash.get(x, ()):
                places[j].append(p)
        pairs: dict[int, tuple] = {}  # bigrams by place

        def offer(j: int, i: int, limit: float = np.inf) -> None:
            if (w := self._window(j, places[j], i, limit, words, pairs)) is not None:
                heappush(heap, (*w, self.names[j], j, i))

        heap: list[tuple] = []
        for j, found in places.items():
            for i in self._begins(j, np.array(found)):
                offer(j, int(i))
        taken: list[tuple] = []  # begins and ends of kept windows, in order; they don't overlap
        best: dict[str, tuple] = {}
        while heap:
            d, s, z, n, j, i = heappop(heap)
            k = bisect(taken, (s, s + z))
            if k and taken[k - 1][1] >= s:
                continue
            if k < len(taken) and taken[k][0] <= s + z:  # the best window from here that ends before
                offer(j, i, taken[k][0])
                continue
            taken.insert(k, (s, s + z))
            best.setdefault(n, (d, s, z))
        return [{"license": n, "dice": -d, "start": s, "n_words": z + 1} for n, (d, s, z) in sorted(best.items())]

    def _sizes(self, j: int) -> tuple[int, int]:
        """Bigrams of the smallest window, all of them common, and of the greatest."""
        whole, most = sum(self.grams[j].values()), (2 - self.least) / self.least
        return max(1, int(np.ceil(whole / most - 1e-9))), int(whole * most + 1e-9)

    def _begins(self, j: int, at: np.ndarray) -> np.ndarray:
        need, widest = self._sizes(j)
        return np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] < widest) if len(at) >= need else at[:0]

    def _window(self, j: int, found: list[int], i: int, limit: float, words: Text, pairs: dict) -> tuple | None:
        """(-coefficient, begin, bigrams) of the best window over the threshold from bigram ``i`` of those found on,
        whose last word comes before ``limit``; of equal ones the smallest."""
        grams, whole, begin, (_, widest) = self.grams[j], sum(self.grams[j].values()), found[i], self._sizes(j)
        common, seen, best = 0, Counter(), None
        for q in range(i, len(found)):
            p = found[q]
            size = p - begin + 1
            if size > widest or begin + size >= limit:
                break
            if p not in pairs:
                pairs[p] = tuple(words.words(p, p + 2))
            pair = pairs[p]
            if seen[pair] < grams[pair]:
                seen[pair] += 1
                common += 1
                key = (-2 * common / (size + whole), begin, size)
                if -key[0] >= self.least and (best is None or key < best):
                    best = key
        return best


def scan(docs: DataFrame, templates=TEMPLATES, least: float = DICE) -> DataFrame:
    """doc_id, license, dice, start (word), n_words: the best window of each document and licence found in it."""
    made: list[Templates] = []

    @F.pandas_udf(_FOUND)
    def find(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(Templates(templates, least))
        return pd.Series([made[0].search(t) for t in texts], dtype=object)

    return docs.select("doc_id", F.explode(find(whole_text())).alias("_m")).select("doc_id", "_m.*")
