"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a run of words up to ``SPREAD`` times as long as a template. It meets the template if it holds at least
``need = ceil(threshold * n)`` of the template's n distinct words (containment). No block size is fixed, so a template
may have any length.

Tokens are the templates' words, ordered by how many documents of the whole corpus hold them, rare ones first.

* Prefix filter: ``need`` of n words cannot be reached without one of the first ``n - need + 1`` in that order, so only
  the surroundings of these words in a text are regions to look at.
* Length filter: a region with fewer than ``need`` distinct words of all templates is dropped.
* Positional filter: if the first shared word is the p-th of the template and the q-th of the region's tokens, the two
  share at most ``min(n - p, m - q)`` words (m tokens in the region); fewer than ``need`` drops the region.
* Verification: the exact count of distinct template words in every run of the region.

Overlapping runs that meet a template are one span: the run with the largest containment (ties: the first) gives its
ends. Short templates (under ``SHORT`` words) need all their words, as one word (nc, mit) tells them apart. Base
phrases are found word by word, place by place.

Templates are few and fixed by the caller, so their index travels with the tasks; counts are summed over all documents.

Defined results: null texts have no words and no labels; empty texts likewise; very long texts are scanned whole;
repeated rows are scanned each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinlab.llm.common import small_batches, table, whole_text

#: Fixed values of the query: phrase and label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further templates, (label, text): notices as they stand in works, and short references.
TEMPLATES = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
        BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
        OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE
        COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
        COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
        DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
        BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
        (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
        POSSIBILITY OF SUCH DAMAGE."""),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License."""),
    ("gpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details. You should have received a copy of the GNU General Public License along with this program. If not, see
        https://www.gnu.org/licenses/."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
        DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
        NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
)
THRESHOLD, SPREAD, SHORT = 0.8, 1.5, 20

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    """Words of digits, letters and bytes from 0x80, A-Z lower-cased."""
    return raw.translate(_WORDS).split()


class TemplateIndex:
    """Prefix words of templates in rarity order, the filters and the exact checks."""

    def __init__(self, base: dict[str, str], templates, frequency: dict[bytes, int], threshold: float = THRESHOLD):
        self.frequency = frequency
        self.base = [(label, words_of(phrase.encode())) for phrase, label in base.items()]
        self.first = defaultdict(list)
        for k, (_, ws) in enumerate(self.base):
            self.first[ws[0]].append(k)
        texts = [(label, words_of(text.encode())) for label, text in templates]
        self.vocabulary = {w for _, ws in texts for w in ws}
        self.items, self.prefix = [], defaultdict(list)
        for k, (label, ws) in enumerate(texts):
            order = sorted(set(ws), key=self.rank)
            need = len(order) if len(ws) < SHORT else max(1, math.ceil(threshold * len(order) - 1e-9))
            self.items.append((label, {w: p for p, w in enumerate(order)}, need, math.ceil(len(ws) * SPREAD)))
            for w in order[: len(order) - need + 1]:
                self.prefix[w].append(k)

    def rank(self, word: bytes) -> tuple[int, bytes]:
        return self.frequency.get(word, 0), word

    def regions(self, words: list[bytes]) -> dict[int, list[tuple[int, int]]]:
        """For each template the runs of places (start, end) that a block with one of its prefix words can cover."""
        out: dict[int, list[tuple[int, int]]] = {}
        for i, w in enumerate(words):
            for k in self.prefix.get(w, ()):
                reach, own = self.items[k][3], out.setdefault(k, [])
                lo, hi = max(0, i - reach + 1), min(len(words), i + reach)
                if own and lo <= own[-1][1]:
                    own[-1] = own[-1][0], hi
                else:
                    own.append((lo, hi))
        return out

    def passes(self, tokens: list[bytes], k: int) -> bool:
        """The length and the positional filter on a region's distinct tokens, rare first."""
        _, place, need, _ = self.items[k]
        if len(tokens) < need:
            return False
        q = next((q for q, w in enumerate(tokens) if w in place), None)
        return q is not None and min(len(place) - place[tokens[q]], len(tokens) - q) >= need

    def blocks(self, words: list[bytes], hits: list[int], k: int, lo: int, hi: int) -> list[tuple[int, int, float]]:
        """(start, end, containment) of the spans between places lo and hi that meet template k."""
        _, place, need, reach = self.items[k]
        inside = [i for i in hits[bisect_left(hits, lo) : bisect_left(hits, hi)] if words[i] in place]
        counts, first, out, until = Counter(), 0, [], -1
        for i in inside:
            counts[words[i]] += 1
            while inside[first] <= i - reach:
                gone = words[inside[first]]
                counts[gone] -= 1
                if not counts[gone]:
                    del counts[gone]
                first += 1
            if len(counts) >= need:
                found = (inside[first], i + 1, len(counts) / len(place))
                if out and found[0] < until:
                    out[-1] = max(out[-1], found, key=lambda x: x[2])  # the first of the largest
                else:
                    out.append(found)
                until = i + 1
        return out

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, float]]]:
        """(start, base phrase) of every place; (start, end, template, containment) of every span."""
        places = [(i, k) for i, w in enumerate(words) if w in self.first for k in self.first[w] if words[i : i + len(self.base[k][1])] == self.base[k][1]]
        regions = self.regions(words)
        if not regions:
            return places, []
        hits = [i for i, w in enumerate(words) if w in self.vocabulary]
        spans = []
        for k, own in regions.items():
            for lo, hi in own:
                tokens = sorted({words[i] for i in hits[bisect_left(hits, lo) : bisect_right(hits, hi - 1)]}, key=self.rank)
                if self.passes(tokens, k):
                    spans += [(a, b, k, c) for a, b, c in self.blocks(words, hits, k, lo, hi)]
        return places, sorted(spans)


def document_frequency(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Documents of the whole table that hold each word of the templates; one row a word reaches the driver."""

    def run(batches):
        total: Counter = Counter()
        for b in batches:
            for v in b.column(0):
                total.update(vocabulary.intersection(words_of(v.as_py().encode())))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    counted = docs.select("t").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in counted.collect()}


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", base=BASE, templates=TEMPLATES) -> DataFrame:
    """One row per document: key, n_words, n_base, first_word, last_word, base_labels, labels, score (the largest
    containment of a span, 1 with a base phrase, else 0) and spans: start, end, label and containment of every base place
    and of every block that meets a template."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("t"))
    vocabulary = {w for _, text in templates for w in words_of(text.encode())}
    index = TemplateIndex(base, templates, document_frequency(rows, vocabulary))

    def run(batches):
        for b in batches:
            out = []
            for v in b.column(1):
                words = words_of(v.as_py().encode())
                places, blocks = index.scan(words)
                starts = [i for i, _ in places]
                of_base = {index.base[k][0] for _, k in places}
                score = max([1.0 if places else 0.0, *(c for *_, c in blocks)])
                labels = of_base | {index.items[k][0] for _, _, k, _ in blocks}
                spans = [(i, i + len(index.base[k][1]), index.base[k][0], 1.0) for i, k in places] + [(a, b, index.items[k][0], c) for a, b, k, c in blocks]
                spans = [dict(zip(("start", "end", "label", "containment"), x, strict=True)) for x in sorted(spans)]
                out.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(of_base)), ",".join(sorted(labels)), score, spans))
            c = list(zip(*out, strict=True)) or [()] * 8
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(x), t) for x, t in zip(c, kinds, strict=True))], names=["key", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    schema = f"key {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start: long, end: long, label: string, containment: double>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text")).drop("spans")
