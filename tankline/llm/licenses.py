"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

WORDS = 5
CONTAINMENT = 0.8
#: A template that is there must meet its window in a band with at least this probability.
COLLISION = 0.9999
#: Shingles of a text that are looked at together; windows that a piece's border would cut are whole in the next.
PIECE = 65_536

# Public license notices, word for word.
NOTICES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "gpl-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "bsd-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nd-4.0-line": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-4.0-international-line": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-nd-4.0-line": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "lgpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "mit-0": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "0bsd": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "bsl-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}

_WORD = re.compile(r"[^\W_]+")


def word_hashes(text: str, seen: dict[str, int]) -> np.ndarray:
    """The hashes of a text's words, runs of letters and digits in lower case. seen remembers words."""
    hashes = []
    for w in _WORD.findall(text.lower()):
        h = seen.get(w)
        if h is None:
            if len(seen) > 500_000:
                seen.clear()
            h = seen[w] = xxhash.xxh64_intdigest(w)
        hashes.append(h)
    return np.array(hashes, np.uint64)


def shingle_hashes(words: np.ndarray, width: int = WORDS) -> np.ndarray:
    """The hash of each run of width words."""
    out = np.full(max(0, len(words) - width + 1), width, np.uint64)
    for i in range(width):
        out = (out ^ words[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i)
        out ^= out >> np.uint64(29)
    return out


def _runs(words: list[str], width: int) -> dict[tuple[str, ...], int]:
    """The runs of width words, numbered in the order in which they first stand."""
    return {run: i for i, run in enumerate(dict.fromkeys(tuple(words[i : i + width]) for i in range(len(words) - width + 1)))}


class Templates:
    """Templates by size; those of fewer than five words have one shingle, all their words. Those of up to m shingles and over m / 2 share windows of m + m/2 shingles, every m/2 of the
    text, so a template's place lies whole in a window, except for the last ones, which end with the text. With
    containment c a window of w shingles then has a Jaccard similarity j of at least c n / (w + (1 - c) n). Bands are
    of one row, which suits so low a j, and there are enough of them that 1 - (1 - j)^bands reaches the collision
    probability that is asked for.
    """

    def __init__(self, texts: dict[str, str], containment: float = CONTAINMENT, collision: float = COLLISION, width: int = WORDS):
        self.containment = containment
        self.names, self.words, self.sets, self.runs, self.widths, classes = [], [], [], [], [], {}
        for name, text in sorted(texts.items()):
            words = word_hashes(text or "", {})
            own_width = min(width, len(words))
            found = np.unique(shingle_hashes(words, own_width)) if own_width else words
            if len(found):
                classes.setdefault((own_width, max(2, 1 << (len(found) - 1).bit_length())), []).append(len(self.names))
                self.names.append(name)
                self.sets.append(found)
                self.words.append(_WORD.findall(text.lower()))
                self.runs.append(_runs(self.words[-1], own_width))
                self.widths.append(own_width)
        self.all = {w: np.unique(np.concatenate([self.sets[i] for key, members in classes.items() if key[0] == w for i in members])) for w, _ in classes}
        self.classes = []
        for (own_width, m), members in sorted(classes.items()):
            window = m + m // 2
            least = min(containment * len(self.sets[i]) / (window + (1 - containment) * len(self.sets[i])) for i in members)
            bands = math.ceil(math.log(1 - collision) / math.log(1 - min(least, 0.999)))
            seeds = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            table = [{} for _ in range(bands)]
            for i in members:
                for band, least_hash in enumerate(self.mixed(self.sets[i], seeds).min(axis=1).tolist()):
                    table[band].setdefault(least_hash, []).append(i)
            self.classes.append((own_width, m, window, seeds, table))

    @staticmethod
    def mixed(hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        x = (hashes[None, :] ^ seeds[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))

    def find(self, text: str, seen: dict[str, int]) -> list[tuple[str, int, int, float]]:
        """(name, start, end, containment), in words, by start: the places of a text where a template is. Retrieved windows are
        judged by the words themselves and cut to one copy of the template each, see _copies. Where places overlap by over half
        of one, a place by over half with all others, or those of one template at all, the better fitting template stays: that with most shingles there, less those it lacks, and of
        equal ones that with most words in their places."""
        hashes, met = word_hashes(text, seen), set()
        for width, known in self.all.items():
            own = shingle_hashes(hashes, width)
            ours = np.isin(own, known)
            if ours.any():  # a window without a template's shingle has no band in common with it
                for own_width, *rest in self.classes:
                    if own_width == width:
                        met |= self._meet(own, ours, *rest)
        words = _WORD.findall(text.lower()) if met else []
        found, reach = [], {}
        for i, a, b in sorted(met):
            if reach.get(i, [[0, -1]])[-1][1] >= a:
                reach[i][-1][1] = max(reach[i][-1][1], b)
            else:
                reach.setdefault(i, []).append([a, b])
        for i, parts in reach.items():
            for a, b in parts:
                for start, end, n in self._copies(i, words, a, b):
                    in_place = sum(x == y for x, y in zip(words[start:end], self.words[i]))
                    found.append((2 * n - len(self.runs[i]), in_place, self.names[i], start, end, n / len(self.runs[i])))
        kept: list[tuple[str, int, int, float]] = []
        near: dict[int, list[tuple[str, int, int]]] = {}  # places that are kept, by each 64 words that they touch
        for _, _, name, a, b, share in sorted(found, key=lambda f: (-f[0], -f[1], f[4] - f[3], f[2], f[3])):
            cells = range(a >> 6, (b - 1 >> 6) + 1)
            met_places = {place for cell in cells for place in near.get(cell, ())}
            shared = [(n, both, d - c) for n, c, d in met_places if (both := min(b, d) - max(a, c)) > 0]
            if all(n != name and 2 * both <= size for n, both, size in shared) and 2 * sum(both for _, both, _ in shared) <= b - a:
                kept.append((name, a, b, share))
                for cell in cells:
                    near.setdefault(cell, []).append((name, a, b))
        return sorted(kept, key=lambda f: (f[1], f[0]))

    def _copies(self, i: int, words: list[str], a: int, b: int) -> Iterator[tuple[int, int, int]]:
        """(start, end, distinct shingles) of the places from a to b that may be a copy of template i. A copy begins at a shingle of
        the template that doesn't go on from the one before, and ends where its distinct shingles, counted twice, exceed its
        length most, once they are enough; so a copy doesn't reach into the next one for the sake of a word that it lacks."""
        width, runs, longest = self.widths[i], self.runs[i], 3 * len(self.runs[i])
        there = [(k, code) for k in range(a, min(b, len(words) - width + 1)) if (code := runs.get(tuple(words[k : k + width]))) is not None]
        need, before = self.containment * len(runs) - 1e-9, (-2, -2)
        for first, (k, code) in enumerate(there):
            if (k - 1, code - 1) != before:
                seen, best = set(), None
                for at in range(first, len(there)):
                    if there[at][0] - k >= longest or len(seen) == len(runs):
                        break
                    if there[at][1] not in seen:
                        seen.add(there[at][1])
                        if len(seen) >= need:
                            best = max(best or (-longest,), (2 * len(seen) - (there[at][0] - k + 1), there[at][0] + width, len(seen)), key=lambda x: x[0])
                if best:
                    yield k, best[1], best[2]
            before = (k, code)

    def _meet(self, hashes: np.ndarray, ours: np.ndarray, m: int, window: int, seeds: np.ndarray, table: list[dict]) -> set[tuple[int, int, int]]:
        """(template, start, end) of the windows that share a band with a template."""
        step, met = max(1, m // 2), set()
        for start in range(0, len(hashes), PIECE):
            piece = hashes[start : start + PIECE + window]
            starts = np.arange(0, min(PIECE, len(piece)), step)
            counts = np.r_[0, np.cumsum(ours[start : start + len(piece)])]
            starts = starts[counts[np.minimum(starts + window, len(piece))] > counts[starts]]
            for s in starts.tolist():
                part = piece[s : s + window]
                here = {i for band, h in enumerate(self.mixed(part, seeds).min(axis=1).tolist()) for i in table[band].get(h, ())}
                met |= {(i, start + s, start + s + len(part)) for i in here}
        return met


def read_templates(spark: SparkSession, folder: str) -> dict[str, str]:
    """Templates from a folder of license texts, one file each, by the file's name without its ending."""
    rows = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value").collect()
    return {re.sub(r"\.(txt|md|rst)$", "", r["file"]): r["value"] for r in rows}


def scan(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text", containment: float = CONTAINMENT, column: str = "licenses") -> DataFrame:
    """docs with an array of (license, start_word, end_word, containment), by place; a column of that name is replaced.

    A template is found where a window of the text holds at least that share of its distinct five-word shingles, at every
    place where it is; of templates that overlap there the best fitting one is told (see Templates.find). Templates are a
    fixed list of the caller's, by name (NOTICES if none is given; read_templates reads whole licenses from a folder), and go
    to the tasks as they are; one without a word is never found. Null and empty texts have no license. Whole texts are
    scanned where they lie, piece by piece, and repeated rows get the same. Other columns come back as they are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(Templates(NOTICES if templates is None else templates, containment))

    @F.pandas_udf("array<struct<license:string,start_word:int,end_word:int,containment:double>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen: dict[str, int] = {}
        for batch in batches:
            yield pd.Series([[{"license": n, "start_word": a, "end_word": b, "containment": c} for n, a, b, c in held.value.find(t or "", seen)] for t in batch])

    return docs.withColumn(column, found(F.col(text)))
