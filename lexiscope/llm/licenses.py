"""Licence scan: normalised text against licence templates by Dice over word bigrams.

Templates are one-line notices, file headers, complete licence texts
(``license_texts/``) and the paragraphs of these.  Compared are a text's lines,
its blocks (lines up to a blank one), the whole text, and windows as long as a
template where enough of the template's rarest bigrams lie, so a licence within
a longer text is found too.  Of overlapping windows the one that shares most
bigrams stays; a unit that overlaps a window of another licence that shares
more bigrams is no match.  AGPL-3.0 and the CC-BY licences other than
CC-BY-SA-4.0 have notices (AGPL-3.0 its header) but no complete text.  A unit
with b distinct bigrams can reach the Dice coefficient d only with templates of
between d/(2-d) * b and (2-d)/d * b bigrams; all others are pruned by size, and
units without a bigram of any remaining template are never compared.

Defined results: null and wordless texts match nothing; of equal scores the
template first in order of name wins; overlapping units with the same licence
count once each; repeated rows are scanned one by one; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect, bisect_left
from collections import Counter
from functools import lru_cache
from itertools import pairwise, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.llm.common import ragged_arange, small_batches, table, text_slices

MIN_DICE = 0.8
#: A-Z lower-cased; letters, digits and non-ASCII bytes stay; all else parts words
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32
             for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

#: fixed values: names and versions that one-line notices are made with
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "MIT": ["MIT License"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0"],
    "ISC": ["ISC License"],
    "Unlicense": ["The Unlicense"],
    "CC0-1.0": ["CC0 1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0"],
}
#: fixed values: the notices around a name
NOTICES = ["Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Released under {}.",
           "This work is licensed under the {}.", "This work is licensed under {}.",
           "This file is licensed under the {}.", "Distributed under the {}."]
#: fixed values: texts and headers of common licences
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT
OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details. You should have received a copy of the GNU General Public License along with this program. If not, see
https://www.gnu.org/licenses/.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}
#: fixed values: the notice at the head of a file under a GNU licence
GNU_HEADER = """This {what} is free software{stop} you can redistribute it and/or modify it under the terms of the GNU {name} as
published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.
This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a
copy of the GNU {name} along with this {what}; if not, see https://www.gnu.org/licenses/."""
GNU = [("GPL-2.0", "program", "General Public License", "2"), ("LGPL-2.1", "library", "Lesser General Public License", "2.1"),
       ("LGPL-3.0", "program", "Lesser General Public License", "3"),
       ("AGPL-3.0", "program", "Affero General Public License", "3")]
#: the complete texts, one file of this name per licence; the driver reads them, executors get them with the function
FULL_TEXTS = Path(__file__).parent / "license_texts"
#: a paragraph of a complete text is a template of its own from so many words on
PARAGRAPH_WORDS = 20


def templates() -> list[tuple[str, str]]:
    """(licence, text) of every template."""
    made = [(name, notice.format(title)) for name, titles in NAMES.items() for title in titles for notice in NOTICES]
    made += [(name, GNU_HEADER.format(what=what, stop=";", name=title, version=version))
             for name, what, title, version in GNU]
    for path in sorted(FULL_TEXTS.glob("*.txt")):
        full = path.read_text()
        made.append((path.stem, full))
        made += [(path.stem, part) for part in re.split(r"\n\s*\n", full)
                 if len(part.encode().translate(FOLD).split()) >= PARAGRAPH_WORDS]
    return sorted({*made, *TEXTS.items()})


class Matcher:
    """Best template of a unit, and templates' places in a text, by Dice over distinct word bigrams."""

    def __init__(self, given: list[tuple[str, str]], min_dice: float = MIN_DICE):
        self.min_dice = min_dice
        words = [text.encode().translate(FOLD).split() for _, text in given]
        self.grams = grams = [set(pairwise(w)) for w in words]
        self.names = [name for name, _ in given]
        self.lengths = [len(w) for w in words]
        self.sizes = [len(g) for g in grams]
        self.where: dict[tuple[bytes, bytes], list[int]] = {}
        for k, g in enumerate(grams):
            for x in g:
                self.where.setdefault(x, []).append(k)
        ratio = (2 - min_dice) / min_dice
        self.least = min(self.sizes, default=0) / ratio
        self.most = max(self.sizes, default=0) * ratio
        self.ratio = ratio
        self._index(words)

    def _index(self, words: list[list[bytes]]) -> None:
        """Bigrams as sorted codes, and the places of each template's rarest bigrams (its seeds)."""
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for ws in words for w in ws}))}
        self.base = len(self.vocabulary) + 1
        code = {g: self.vocabulary[g[0]] * self.base + self.vocabulary[g[1]] for g in self.where}
        self.codes = np.array(sorted(code.values()), np.int64)
        rows, self.needed = [], np.zeros(len(words), np.int64)
        for k, ws in enumerate(words):
            m = self.sizes[k]
            # a window as long as the template shares at least so many bigrams if it reaches the coefficient
            shared = int(np.ceil(m / self.ratio - 1e-9))
            places: dict[tuple[bytes, bytes], list[int]] = {}
            for o, g in enumerate(pairwise(ws)):
                places.setdefault(g, []).append(o)
            rare = sorted(places, key=lambda g: (len(self.where[g]), len(places[g]), g))
            seeds = rare[:max(m - shared + 1, 2 * m // 3)]
            self.needed[k] = len(seeds) - (m - shared)
            rows += [(code[g], k, o) for g in seeds for o in places[g]]
        rows = np.array(sorted(rows), np.int64).reshape(-1, 3)
        gram = np.searchsorted(self.codes, rows[:, 0])
        self.seed_first = np.searchsorted(gram, np.arange(len(self.codes) + 1))
        self.seed_template, self.seed_offset = rows[:, 1], rows[:, 2]

    def best(self, words: list[bytes]) -> tuple[float, str] | None:
        found = self._best(words)
        return found and found[1:]

    def _best(self, words: list[bytes]) -> tuple[int, float, str] | None:
        """(shared bigrams, coefficient, licence) of the best template."""
        if len(words) - 1 < self.least:
            return None
        grams = set(pairwise(words))
        n = len(grams)
        if not self.least <= n <= self.most:
            return None
        known = grams & self.where.keys()
        if len(known) < n / self.ratio - 1e-9:
            return None
        shared = Counter(k for g in known for k in self.where[g]
                         if n / self.ratio <= self.sizes[k] <= n * self.ratio)
        scores = [(c, 2 * c / (n + self.sizes[k]), self.names[k]) for k, c in shared.items()]
        scores = [s for s in scores if s[1] >= self.min_dice]
        return min(scores, key=lambda s: (-s[1], s[2])) if scores else None

    def scan(self, text: bytes) -> list[dict]:
        """Matches of the lines, blocks and whole of a text and of windows in it, by place."""
        words: list[bytes] = []
        units: list[tuple[int, int, int, int]] = []  # bytes and words
        at = block_start = block_word = lines = 0
        for line in text.split(b"\n"):
            own = line.translate(FOLD).split()
            if not line.strip():
                if lines > 1:
                    units.append((block_start, at, block_word, len(words)))
                block_start, block_word, lines = at + len(line) + 1, len(words), 0
            else:
                units.append((at, at + len(line), len(words), len(words) + len(own)))
                words += own
                lines += 1
            at += len(line) + 1
        if lines > 1:
            units.append((block_start, len(text), block_word, len(words)))
        units.append((0, len(text), 0, len(words)))
        if len(words) - 1 < self.least or not self.names:
            return []
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        codes = np.where((ids[:-1] > 0) & (ids[1:] > 0), ids[:-1] * self.base + ids[1:], 0)
        gram = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        known = self.codes[gram] == codes
        before = np.concatenate([[0], np.cumsum(known)])  # known bigrams that begin before a word
        found: dict[tuple[int, int], tuple[int, float, str]] = {}
        for start, stop, a, z in units:
            if z - a > 1 and before[z - 1] - before[a] >= self.least - 1e-9 and (start, stop) not in found:
                if best := self._best(words[a:z]):
                    found[start, stop] = best
        windows = self._windows(words, np.flatnonzero(known), gram[known], before)
        if windows:
            places = [m.span() for m in _WORD.finditer(text)]
            windows = sorted((places[a][0], places[z - 1][1], *w) for a, z, *w in windows)
            firsts, ends = [w[0] for w in windows], [w[1] for w in windows]  # disjoint
            told = set()
            for (start, stop), (n, _, name) in list(found.items()):
                over = range(bisect(ends, start), bisect_left(firsts, stop))
                # what a longer match explains is not evidence of another licence
                if any(windows[i][2] > n and windows[i][4] != name for i in over):
                    del found[start, stop]
                else:
                    told.update(i for i in over if n >= windows[i][2])
            for i, (start, stop, *best) in enumerate(windows):
                if i not in told:
                    found[start, stop] = tuple(best)
        return [{"start": a, "stop": z, "license": name, "dice": dice}
                for (a, z), (_, dice, name) in sorted(found.items())]

    def _windows(self, words: list[bytes], at: np.ndarray, gram: np.ndarray, before: np.ndarray) -> list[tuple]:
        """``(first word, end, shared, dice, licence)``: windows of a template's length, none over another.

        A window is tried where a template's seeds lie as in the template; of
        windows that overlap the one that shares most bigrams stays.
        """
        count = self.seed_first[gram + 1] - self.seed_first[gram]
        row = np.repeat(self.seed_first[gram], count) + ragged_arange(count)
        place, template = np.repeat(at, count), self.seed_template[row]
        start = place - self.seed_offset[row]
        enough = np.bincount(template, minlength=len(self.names)) >= self.needed
        keep = np.flatnonzero(enough[template])
        keep = keep[np.argsort(template[keep], kind="stable")]  # places stay in order
        cut = np.flatnonzero(np.diff(template[keep], prepend=-1, append=-1))
        tried = []
        for rows in map(lambda a, z: keep[a:z], cut[:-1], cut[1:]):
            k = int(template[rows[0]])
            p, m = place[rows], self.lengths[k]
            last = np.searchsorted(p, p + m)
            dense = np.flatnonzero(last - np.arange(len(p)) >= self.needed[k])
            if not len(dense):
                continue
            inside = np.zeros(len(p) + 1, np.int64)
            np.add.at(inside, dense, 1)
            np.add.at(inside, last[dense], -1)
            starts = np.unique(np.clip(start[rows[np.cumsum(inside[:-1]) > 0]], 0, None))
            ends = np.minimum(starts + m, len(words))
            possible = before[np.maximum(ends - 1, starts)] - before[starts] >= self.sizes[k] / self.ratio - 1e-9
            for a, z in zip(starts[possible].tolist(), ends[possible].tolist()):
                own = set(pairwise(words[a:z]))
                n = len(own & self.grams[k])
                dice = 2 * n / (len(own) + self.sizes[k])
                if dice >= self.min_dice:
                    tried.append((n, dice, self.names[k], a, z))
        taken: list[tuple[int, int]] = []  # disjoint, in order
        out = []
        for n, dice, name, a, z in sorted(tried, key=lambda t: (-t[0], -t[1], t[2], t[3])):
            i = bisect(taken, (a, z))
            if (i and taken[i - 1][1] > a) or (i < len(taken) and taken[i][0] < z):
                continue
            taken.insert(i, (a, z))
            out.append((a, z, n, dice, name))
        return out


@lru_cache(maxsize=4)
def _matcher(given: tuple[tuple[str, str], ...], min_dice: float) -> Matcher:
    return Matcher(list(given), min_dice)


MATCHES = "array<struct<start:long,stop:long,license:string,dice:double>>"
_MATCHES = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("license", pa.string()),
                               ("dice", pa.float64())]))


def license_matches(text: Column, given: list[tuple[str, str]] | None = None, min_dice: float = MIN_DICE) -> Column:
    """Array of the matched units of a text: UTF-8 byte range, licence and coefficient."""
    chosen = tuple(templates() if given is None else sorted(given))

    def run(texts: pa.Array) -> pa.Array:
        matcher, out = _matcher(chosen, min_dice), []
        for part in text_slices(texts):
            out += [matcher.scan(t) for t in part]
        return pa.array(out, _MATCHES)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, MATCHES).asNondeterministic()(text.cast("string"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(doc_id, license, dice, n_matches, licenses, matches)``; the best match leads, the first of equals."""
    found = docs.select(F.col(id_col).alias("doc_id"), license_matches(F.col(text_col), **options).alias("matches"))
    # a negative coefficient sorts the best match first, then its place
    keyed = F.transform("matches", lambda m: F.struct((-m["dice"]).alias("d"), m["start"], m["license"].alias("l")))
    best = F.get(F.array_sort(keyed), 0)
    return found.select("doc_id", best["l"].alias("license"), (-best["d"]).alias("dice"),
                        F.size("matches").cast("long").alias("n_matches"),
                        F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))).alias("licenses"),
                        "matches")


@small_batches
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("matches").withColumn(
        "licenses", F.concat_ws(",", "licenses"))
