"""License scan: Dice coefficient over word bigrams between passages of a text and licence templates.

The passages of a text are its lines, its paragraphs (lines up to the next line without words) and the
whole text. Words are runs of letters and digits in lower case. With a and b bigrams on the two sides,
repeats included, Dice is twice the common ones by a + b. As no more than the smaller number can be
common, a passage can only reach the least Dice t if its bigrams are between b t/(2-t) and b (2-t)/t;
passages outside these bounds of all templates are dropped before any bigram is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsefleet.llm.common import slices, split_words
from pulsefleet.llm.license_templates import common
from pulsefleet.llm.phrase_index import WORD_BREAKS

LEAST = 0.8

# The public texts of common licences and the usual one-line statements; license_templates has the others.
TEMPLATES = common((
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0 notice",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0 notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version. This program is distributed in the hope that it will be useful, "
        "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a "
        "copy of the GNU General Public License along with this program. If not, see "
        "https://www.gnu.org/licenses/.",
    ),
    (
        "ISC text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all "
        'copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS '
        "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR "
        "BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
        "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
        '"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES '
        "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE.",
    ),
))


class Scanner:
    """Templates as counts of bigrams over their common vocabulary."""

    def __init__(self, templates: tuple[tuple[str, str], ...], least: float) -> None:
        order = sorted(templates)
        self.names = [name for name, _ in order]
        self.least = least
        words = split_words(pa.array([text for _, text in order], pa.string()), WORD_BREAKS)
        self.vocabulary, codes = words.encoded()
        rows = [codes[a:b].astype(np.int64) for a, b in zip(words.first, words.first[1:])]
        pairs = [row[:-1] * len(self.vocabulary) + row[1:] for row in rows]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.counts = np.array([np.bincount(np.searchsorted(self.pairs, p), minlength=len(self.pairs)) for p in pairs], dtype=np.int32)
        self.sizes = np.array([len(p) for p in pairs])
        self.low = np.ceil(self.sizes * least / (2 - least) - 1e-9)
        self.high = np.floor(self.sizes * (2 - least) / least + 1e-9)

    def scan(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int, float]]:
        """Text, first and last line (from 0), template, Dice: the best template of each passage that reaches the least."""
        lines = pc.split_pattern(pc.fill_null(texts.cast(pa.string()), ""), "\n")
        first_line = lines.offsets.to_numpy() - lines.offsets[0].as_py()
        words = split_words(lines.flatten(), WORD_BREAKS)
        if not len(words):
            return
        distinct, codes = words.encoded()
        known = pc.fill_null(pc.index_in(distinct, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
        pair = np.where((known[:-1] >= 0) & (known[1:] >= 0), known[:-1] * len(self.vocabulary) + known[1:], -1)
        place = np.searchsorted(self.pairs, pair)
        place[place == len(self.pairs)] = 0
        place = np.where(self.pairs[place] == pair, place, -1)
        met = np.concatenate([[0], np.cumsum(place >= 0), [0]])
        met[-1] = met[-2]
        low_line, high_line = self._passages(words.first, first_line)
        low, high = words.first[low_line], words.first[high_line + 1]
        size = high - low - 1
        shared = met[np.maximum(high - 1, low)] - met[low]
        # Passages that fit no template by the smallest bounds go first; the others meet the bounds of each.
        near = np.flatnonzero((size > 0) & (size >= self.low.min()) & (2 * shared >= self.least * (size + self.sizes.min()) - 1e-9))
        for k in range(0, len(near), 4096):
            some = near[k : k + 4096]
            n, met_n = size[some, None], shared[some, None]
            fits = (n >= self.low) & (n <= self.high) & (2 * met_n >= self.least * (n + self.sizes) - 1e-9)
            for row in np.flatnonzero(fits.any(axis=1)).tolist():
                yield from self._best(int(some[row]), fits[row], place, low, high, low_line, high_line, first_line)

    def _best(self, i, fits, place, low, high, low_line, high_line, first_line) -> Iterator[tuple[int, int, int, int, float]]:
        """The best of the templates that passage i can reach, if it reaches the least."""
        own = place[low[i] : high[i] - 1]
        met, counts = np.unique(own[own >= 0], return_counts=True)
        among = np.flatnonzero(fits)
        dice = 2.0 * np.minimum(self.counts[np.ix_(among, met)], counts).sum(axis=1) / (high[i] - low[i] - 1 + self.sizes[among])
        best = int(np.argmax(dice))
        if dice[best] >= self.least:
            text = int(np.searchsorted(first_line, low_line[i], "right")) - 1
            yield text, int(low_line[i] - first_line[text]), int(high_line[i] - first_line[text]), int(among[best]), float(dice[best])

    @staticmethod
    def _passages(first: np.ndarray, first_line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last line of all passages: lines with words, paragraphs, whole texts; equal ones once."""
        filled = np.flatnonzero(np.diff(first))
        text = np.searchsorted(first_line, filled, "right") - 1
        new_text = np.diff(text, prepend=-1) != 0
        new_part = new_text | (np.diff(filled, prepend=-2) > 1)
        parts = [(filled, filled)]
        for opens in (new_part, new_text):
            parts.append((filled[opens], filled[np.append(np.flatnonzero(opens)[1:] - 1, len(filled) - 1)]))
        both = np.unique(np.concatenate([np.stack(p, axis=1) for p in parts]), axis=0)
        return both[:, 0], both[:, 1]


def scanned(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """A row per passage that a template fits: doc_id, first_line, last_line (from 1), license, dice.

    The best template of a passage is reported (ties: the first name). Null, empty and wordless texts
    give no rows; repeated rows and null doc_ids are rows like any other; other columns are not read.
    """
    if not templates:
        return docs.select("doc_id").where("false").selectExpr("doc_id", "0L first_line", "0L last_line", "'' license", "0D dice")
    scanner = Scanner(templates, least)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                hits = list(scanner.scan(piece.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id").take(pa.array([h[0] for h in hits], pa.int64())),
                        pa.array([h[1] + 1 for h in hits], pa.int64()),
                        pa.array([h[2] + 1 for h in hits], pa.int64()),
                        pa.array([scanner.names[h[3]] for h in hits], pa.string()),
                        pa.array([h[4] for h in hits], pa.float64()),
                    ],
                    names=["doc_id", "first_line", "last_line", "license", "dice"],
                )

    schema = f"doc_id {kind}, first_line long, last_line long, license string, dice double"
    return docs.select("doc_id", F.col("text")).mapInArrow(of, schema)
