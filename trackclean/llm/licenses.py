"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Words are lower-cased runs of letters, digits and bytes beyond ASCII; sets are of five-word shingles. A text's windows are
WINDOW shingles long and start STRIDE apart; a template's start at every shingle. Windows are sketched by BANDS bands of
ROWS minima, and a window that agrees in a band with a template's retrieves it. Equal windows always agree, so it is
certain that a template is retrieved where RUN of its shingles in a row are left as they were. That is so in every altered
copy that still contains SHARE hundredths of a template of LONG shingles or more: a change inside it takes four shingles in
a row at least, so that changes that take a quarter in all leave a run of RUN between them. Shorter templates have windows
of one shingle, whose sketch is the shingle's hash; a template of fewer words than a shingle is one, its whole word
sequence, looked for at every word.

What is retrieved is judged by the whole text: a place contains a template if SHARE hundredths of its shingles are in a
window of TIGHT, else of wider, eighths of its length. Templates of one name, and templates that hold each other (the
headers of the GPL's versions), are one place where their words overlap: the one contained most.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import LOWER, PLACE, mix, raw, word_hashes
from .tokens import balanced

#: Public license texts and usual notices.
TEMPLATES: dict[str, str | tuple[str, ...]] = {
    "MIT": ((
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ), (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    )),
    "ISC": ((
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ), (
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
        "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE."
    )),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."
    ),
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
        "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version."
    ),
    "GPL-2.0 header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
        "version."
    ),
    "BSD-3-Clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission."
    ),
    "LGPL-2.1 header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later "
        "version."
    ),
    "LGPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version."
    ),
    "AGPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version."
    ),
    "MPL-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Apache-2.0 notice": ("Licensed under the Apache License, Version 2.0.", "Apache License 2.0", "Apache-2.0 license"),
    "GPL-3.0 notice": ("This work is licensed under the GNU General Public License, version 3.", "GPL v3", "GPLv3", "GPL-3.0"),
    "GPL-2.0 notice": ("This work is licensed under the GNU General Public License, version 2.", "GPL v2", "GPLv2", "GPL-2.0"),
    "LGPL notice": ("GNU Lesser General Public License", "LGPL v3", "LGPLv3", "LGPL-3.0", "LGPL v2.1", "LGPLv2.1", "LGPL-2.1"),
    "AGPL-3.0 notice": ("GNU Affero General Public License", "AGPL v3", "AGPLv3", "AGPL-3.0"),
    "MPL-2.0 notice": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "BSD notice": ("under the BSD License", "under the BSD licence", "BSD 3-Clause License", "BSD 2-Clause License"),
    "MIT notice": ("Released under the MIT License.", "under the MIT License", "under the MIT licence"),
    "CC-BY-NC-4.0 notice": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0"),
    "CC-BY-4.0 notice": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC BY 4.0", "Creative Commons Attribution 4.0"),
    "CC-BY-SA-4.0 notice": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0"),
    "CC-BY-ND-4.0 notice": ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0"),
    "CC-BY-NC-SA-4.0 notice": ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0"),
    "CC-BY-NC-ND-4.0 notice": ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0"),
    "CC0-1.0 notice": ("CC0 1.0 Universal", "Creative Commons Zero"),
    "BSD disclaimer": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
        "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
        "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any "
        "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
        "is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
        "original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, "
        "and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
        "Software is furnished to do so, all subject to the following:"
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Proprietary notice": "All rights reserved.",
}
WIDTH = 5
SHARE = 75
#: Shingles of a window, from one window to the next, and in a row that make it certain that one is whole.
WINDOW, STRIDE = 4, 3
RUN = WINDOW + STRIDE - 1
#: Templates of fewer shingles have windows of one.
LONG = 8
BANDS, ROWS = 2, 2
#: Lengths of the windows of verification, in eighths of the template's.
REACHES = (10, 12, 16)
#: Bytes of text whose hashes are worked out at once: they stay in a processor's cache.
CACHED = 1 << 18
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def shingled(buf: np.ndarray, offsets: np.ndarray, short: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """(shingle hashes, first shingle of each text and the end, first word of each text, words of each, and hashes of the
    shorter word sequences asked for, at every word)."""
    buf = LOWER[buf]
    word = _WORD[buf]
    start = word.copy()
    start[1:] &= ~word[:-1]
    end = word.copy()
    end[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    edge = inner[(inner > 0) & (inner < len(buf))]
    start[edge] |= word[edge]
    end[edge - 1] |= word[edge - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    hashes = word_hashes(buf, starts, ends)
    first = np.searchsorted(starts, offsets)
    n = np.diff(first)
    m = np.maximum(n - WIDTH + 1, 0)
    total = np.zeros(len(hashes), np.uint64)
    shorter = {}
    for k in range(min(WIDTH, len(hashes))):
        total[: len(hashes) - k] += hashes[k:] * PLACE[k]
        if k + 1 in short:
            shorter[k + 1] = total.copy()
    keep = np.repeat(first[:-1] - np.cumsum(m) + m, m) + np.arange(m.sum())
    return mix(total[keep]), np.append(0, np.cumsum(m)), first[:-1], n, shorter


def bands(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each window of WINDOW shingles from the starts given."""
    out = np.empty((len(starts), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(starts), b + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for r in range(ROWS):
            h = mix(values + np.uint64((b * ROWS + r + 1) * 0xD1342543DE82EF95 % (1 << 64)))
            least = h[starts]
            for k in range(1, WINDOW):
                least = np.minimum(least, h[starts + k])
            key = mix(key ^ least)
        out[:, b] = key
    return out


class Lookup:
    """Templates by keys: a sorted table, and a first test by 20 bits."""

    def __init__(self, keys: np.ndarray, owners: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], owners[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(keys & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def hits(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in keys, template) of all agreements."""
        maybe = np.flatnonzero(self.seen[(keys & np.uint64(0xFFFFF)).astype(np.int64)])
        left = np.searchsorted(self.keys, keys[maybe], "left")
        times = np.searchsorted(self.keys, keys[maybe], "right") - left
        return np.repeat(maybe, times), self.owners[np.repeat(left - np.cumsum(times) + times, times) + np.arange(times.sum())]


class Scanner:
    """The templates' windows and sets, and the search of a batch of texts for them."""

    def __init__(self, templates: dict[str, str | tuple[str, ...]]) -> None:
        wordings = [(name, t) for name, x in templates.items() for t in ((x,) if isinstance(x, str) else x)]
        self.names = [name for name, _ in wordings]
        values, bounds, first, words, shorter = shingled(*raw(pa.array([t for _, t in wordings], pa.string())), short=tuple(range(1, WIDTH)))
        if len(words) and words.min() < 1:
            raise ValueError("a template needs a word")
        self.lengths = np.diff(bounds).tolist()
        #: template: its number of words and hash, for those of fewer words than WIDTH
        self.short = {t: (int(n), shorter[int(n)][first[t]]) for t, n in enumerate(words) if n < WIDTH}
        self.sets = [np.unique(values[a:b]) for a, b in pairwise(bounds.tolist())]
        starts = [np.arange(a, b - WINDOW + 1) if b - a >= LONG else np.arange(0) for a, b in pairwise(bounds.tolist())]
        self.windows = Lookup(bands(values, np.concatenate(starts)).ravel(), np.repeat(np.arange(len(starts)), [len(x) * BANDS for x in starts]))
        single = [x if n < LONG else x[:0] for x, n in zip(self.sets, self.lengths, strict=True)]
        self.singles = Lookup(np.concatenate(single), np.repeat(np.arange(len(single)), [len(x) for x in single]))
        #: templates of one group are one place where they overlap
        self.groups = [min(u for u in range(t + 1) if self.names[u] == name or self.alike(self.sets[u], self.sets[t])) for t, name in enumerate(self.names)]

    @staticmethod
    def alike(a: np.ndarray, b: np.ndarray) -> bool:
        return len(a) > 0 and 100 * np.isin(a, b).sum() >= SHARE * max(len(a), len(b))

    def retrieved(self, values: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
        """(text, template) of which a window of the text agrees in a band with one of the template."""
        size = np.diff(bounds)
        n = np.maximum((size - WINDOW) // STRIDE + 1, 0)
        starts = np.repeat(bounds[:-1] - STRIDE * (np.cumsum(n) - n), n) + STRIDE * np.arange(n.sum())
        at, owner = self.windows.hits(bands(values, starts).ravel())
        one, other = self.singles.hits(values)
        at, owner = np.concatenate([starts[at // BANDS], one]), np.concatenate([owner, other])
        text = np.searchsorted(bounds, at, "right") - 1
        return np.unique(np.stack([text, owner], axis=1), axis=0).tolist()

    def places(self, t: int, at: np.ndarray, values: np.ndarray, reach: int) -> list[tuple[int, int, float]]:
        """(first and last shingle, containment) of one text's places of a template, from where its shingles are.

        A place is a window of reach shingles; it ends with the last shingle that it has not had before.
        """
        stops = np.searchsorted(at, at + reach)
        inside: dict[int, int] = {}
        held, share = 0, np.zeros(len(at))
        listed = values.tolist()
        for i, stop in enumerate(stops.tolist()):
            for k in listed[held:stop]:
                inside[k] = inside.get(k, 0) + 1
            held = stop
            share[i] = len(inside) / len(self.sets[t])
            inside[listed[i]] -= 1
            if not inside[listed[i]]:
                del inside[listed[i]]
        out, i = [], 0
        good = np.flatnonzero(100 * share >= SHARE)
        while i < len(good):
            near = good[i : np.searchsorted(at[good], at[good[i]] + reach)]
            best = int(near[np.argmax(share[near])])
            new = np.unique(values[best : stops[best]], return_index=True)[1]
            last = int(at[best + new.max()])
            out.append((int(at[best]), last, float(share[best])))
            i = int(np.searchsorted(at[good], last + WIDTH))
        return out

    def scan(self, column: pa.Array) -> tuple[list[tuple[int, int, int, int, float]], np.ndarray]:
        """(text number, template number, first word, words, containment) of every verified place, and the texts' words.

        Places of one group whose words overlap are one, where it is contained most (ties: the most words, the first).
        """
        values, bounds, first, words, shorter = shingled(*raw(column), short=tuple({n for n, _ in self.short.values()}))
        found: list[tuple[int, int, int, int, float]] = []
        for t, (n, key) in self.short.items():
            for k in np.flatnonzero(shorter[n] == key).tolist() if n in shorter else ():
                d = int(np.searchsorted(first, k, "right")) - 1
                if k + n <= first[d] + words[d]:
                    found.append((d, t, k - int(first[d]), n, 1.0))
        for d, t in self.retrieved(values, bounds):
            mine = values[bounds[d] : bounds[d + 1]]
            at = np.flatnonzero(np.isin(mine, self.sets[t]))
            for eighths in REACHES:
                if 100 * len(at) < SHARE * len(self.sets[t]):
                    break
                for a, b, share in self.places(t, at, mine[at], max(self.lengths[t] + 2, self.lengths[t] * eighths // 8)):
                    found.append((d, t, a, b - a + WIDTH, share))
                    at = at[(at < a) | (at > b)]
        return self.apart(found), words

    def apart(self, found: list[tuple[int, int, int, int, float]]) -> list[tuple[int, int, int, int, float]]:
        """Of the places of one text and group that overlap, the one contained most."""
        kept: dict[tuple[int, int], tuple[list[int], list]] = {}
        for x in sorted(found, key=lambda x: (-x[4], -x[3], x[2], x[1])):
            # those kept of a group are apart and in order, so only the two next to a place may overlap it
            starts, others = kept.setdefault((x[0], self.groups[x[1]]), ([], []))
            k = bisect(starts, x[2])
            if (not k or others[k - 1][2] + others[k - 1][3] <= x[2]) and (k == len(others) or x[2] + x[3] <= starts[k]):
                starts.insert(k, x[2])
                others.insert(k, x)
        return [x for _, others in kept.values() for x in others]


def license_matches(docs: DataFrame, templates: dict[str, str | tuple[str, ...]] | None = None) -> DataFrame:
    """doc_id, n_words, matches (license, first_word, n_words, containment; by place) of every row's whole text.

    Null and empty texts match nothing; equal rows match alike; other columns are ignored; templates: name to text, or to
    several wordings, of one word at least each.
    """
    scanner = Scanner(templates or TEMPLATES)
    kind = pa.list_(pa.struct([("license", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in balanced(big, "text", CACHED):
                found, words = scanner.scan(batch.column("text"))
                matches: list[list[dict]] = [[] for _ in range(batch.num_rows)]
                for d, t, first, n, share in found:
                    matches[d].append({"license": scanner.names[t], "first_word": first, "n_words": n, "containment": share})
                for m in matches:
                    m.sort(key=lambda x: (x["first_word"], x["license"]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(matches, kind)], ["doc_id", "n_words", "matches"])

    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return x.mapInArrow(run, "doc_id long, n_words long, matches array<struct<license:string,first_word:long,n_words:long,containment:double>>")


def license_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_matches, licenses (names, sorted, joined by commas), best (highest containment, 0 for none)."""
    x = license_matches(docs)
    return x.select(
        "doc_id", "n_words", F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"),
        F.coalesce(F.array_max("matches.containment"), F.lit(0.0)).alias("best"))
