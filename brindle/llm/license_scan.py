"""License scans: matching statistics of whole files against a generalised suffix automaton of licence texts, chained into spans."""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases whose every place counts, and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Wordings of common licence notices, and their labels.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the software is provided as is without warranty of any kind express or implied", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by nd 4 0", "cc-by-nd-4.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("no rights reserved", "cc0"),
)

# Whole texts of short licences, without names and years, and their labels.
WHOLE_TEXTS = (
    (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
        the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
        ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
        LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "mit",
    ),
    (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
        copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
        LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
        ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        "isc",
    ),
    (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
        the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
        LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
        AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF
        SUCH DAMAGE.""",
        "bsd-2-clause",
    ),
    (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        "apache-2.0",
    ),
    (
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
        "gpl-3.0-or-later",
    ),
    (
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
        binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
        software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment
        in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT
        OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "unlicense",
    ),
    (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to
        anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
        misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2.
        Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
        "zlib",
    ),
)

#: Bytes of words: letters and digits in lower case and all of a non-ASCII character; others separate words.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


@dataclass(frozen=True)
class Span:
    label: str
    start: int
    end: int
    covered: float


class SuffixAutomaton:
    """A generalised suffix automaton of word sequences: every run of words of any sequence is a way from state 0.

    ends[state] has the (sequence, place) pairs where the state's words end.
    """

    def __init__(self, sequences: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.longest, self.ends = [-1], [0], [set()]
        for k, words in enumerate(sequences):
            last = 0
            for at, w in enumerate(words):
                last = self._extend(last, w)
                self.ends[last].add((k, at))
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.longest[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]

    def _new(self, longest: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.longest.append(longest)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        copy = self._new(self.longest[p] + 1)
        self.next[copy] = dict(self.next[q])
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.longest[q] == self.longest[last] + 1 else self._split(last, q, w)
        new, p = self._new(self.longest[last] + 1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.longest[q] == self.longest[p] + 1 else self._split(p, q, w)
        return new


@dataclass(frozen=True)
class Match:
    """Words start to end of a text that are words of a template, the last one at its place `at`; neither side can be extended."""

    template: int
    start: int
    end: int
    at: int

    @property
    def first(self) -> int:
        return self.at - (self.end - self.start)


class LicenseScanner:
    def __init__(self, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES + WHOLE_TEXTS, least_match: int = 3, gap: int = 8, least_covered: float = 0.8):
        self.phrases, self.least_match, self.gap, self.least_covered = phrases, least_match, gap, least_covered
        texts = [words_of(t) for t, _ in (*phrases, *templates)]
        self.labels = [label for _, label in (*phrases, *templates)]
        self.vocabulary: dict[bytes, int] = {}
        self.sequences = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in t] for t in texts]
        self.automaton = a = SuffixAutomaton(self.sequences)
        # The phrases that end where a state ends: (least length of the match, phrase), from the state and those its links lead to.
        own: dict[int, list[tuple[int, int]]] = {}
        for k in range(len(phrases)):
            s = 0
            for w in self.sequences[k]:
                s = a.next[s][w]
            own.setdefault(s, []).append((len(self.sequences[k]), k))
        self.ending: list[list[tuple[int, int]]] = [[] for _ in a.link]
        for s in range(1, len(a.link)):
            t = s
            while t > 0:
                self.ending[s] += own.get(t, [])
                t = a.link[t]
        self._told: dict[int, list[tuple[int, int, int]]] = {}

    def _templates(self, state: int) -> list[tuple[int, int, int]]:
        """(template, place, length at most): every place of a template where a match that has come to this state ends, with the words it shares there."""
        known = self._told.get(state)
        if known is None:
            longest: dict[tuple[int, int], int] = {}
            s, a = state, self.automaton
            while s > 0 and a.longest[s] >= self.least_match:
                for place in a.ends[s]:
                    longest.setdefault(place, a.longest[s])
                s = a.link[s]
            known = self._told[state] = sorted((k, at, n) for (k, at), n in longest.items() if k >= len(self.phrases))
        return known

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[Match]]:
        """The phrases' places (start, phrase), and the matches of least_match words or more with every place of every template."""
        a, known = self.automaton, self.vocabulary.get
        step, link, longest, ending, least = a.next, a.link, a.longest, self.ending, self.least_match
        places: list[tuple[int, int]] = []
        found: list[Match] = []
        running: dict[tuple[int, int], int] = {}  # (template, place) where a match ends at the word before: its length

        def ended(before: int, now: dict[tuple[int, int], int]) -> None:
            found.extend(Match(k, before - n + 1, before, at) for (k, at), n in sorted(running.items()) if (k, at + 1) not in now)

        state = length = 0
        before = -2
        for i, w in [(i, w) for i, w in enumerate(map(known, words)) if w is not None]:
            if i != before + 1:
                if running:
                    ended(before, {})
                    running = {}
                state = length = 0
            then = step[state].get(w)
            if then is None:
                while state and w not in step[state]:
                    state = link[state]
                length = longest[state]
                then = step[state].get(w)
            if then is not None:
                state, length = then, length + 1
                for shortest, k in ending[state]:
                    if length >= shortest:
                        places.append((i - shortest + 1, k))
            if running or length >= least:
                now = {(k, at): min(length, n) for k, at, n in self._templates(state)} if length >= least else {}
                ended(before, now)
                running = now
            before = i
        ended(before, {})
        return places, found

    def spans(self, found: list[Match]) -> tuple[list[Span], float]:
        """The best chains of matches, by template.

        A chain goes forward in text and template, with at most `gap` words of text between two matches; it covers the template's words
        that its matches have, each once. By dynamic programming every match gets the best chain that ends with it. Of the chains that cover
        least_covered of their template, the best ones that don't overlap are spans. Also the largest share that any chain covers.
        """
        out, best = [], 0.0
        by_template: dict[int, list[Match]] = {}
        for m in found:
            by_template.setdefault(m.template, []).append(m)
        for k, ms in by_template.items():
            ms.sort(key=lambda m: (m.end, m.at))
            size = len(self.sequences[k])
            covered, start = [m.end - m.start + 1 for m in ms], [m.start for m in ms]
            low = 0
            reach = max(m.end - m.start for m in ms) + self.gap + 1
            for i, m in enumerate(ms):
                while ms[low].end < m.end - reach:
                    low += 1
                for j in range(low, i):
                    p = ms[j]
                    if p.end < m.end and p.at < m.at and m.start - p.end - 1 <= self.gap:
                        total = covered[j] + min(m.end - max(p.end, m.start - 1), m.at - max(p.at, m.first - 1))
                        if (total, start[j]) > (covered[i], start[i]):
                            covered[i], start[i] = total, start[j]
            best = max(best, max(covered) / size)
            taken: list[tuple[int, int]] = []
            for i in sorted(range(len(ms)), key=lambda i: (-covered[i], ms[i].end, -start[i])):
                if covered[i] / size < self.least_covered:
                    break
                at = bisect(taken, (start[i], ms[i].end))
                if (at == 0 or taken[at - 1][1] < start[i]) and (at == len(taken) or ms[i].end < taken[at][0]):
                    taken.insert(at, (start[i], ms[i].end))
                    out.append(Span(self.labels[k], start[i], ms[i].end, covered[i] / size))
        return sorted(out, key=lambda s: (s.start, s.end, s.label)), best

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str]], list[Span], float]:
        """n_words, the phrases' places (start, label), the spans, and the score."""
        words = words_of(text)
        places, found = self.matches(words)
        spans, best = self.spans(found)
        return len(words), [(i, self.labels[k]) for i, k in places], spans, 1.0 if places else best


_SCHEMA = "doc_id long, n_words long, places array<struct<start: int, label: string>>, spans array<struct<label: string, start: int, end: int, covered: double>>, score double"


def license_scan(docs: DataFrame, scanner: LicenseScanner | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, places, spans and score of every row's whole text.

    A text is lower-cased in A-Z and read as words of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. places: where a phrase's words stand one after the other
    (start, label). spans: covered template spans, first and last word, of notices and of whole licences. score: 1 with a place, else the largest share of a
    template that a chain covers. A null or empty text has none of them and score 0. Rows are read one by one, so repeated rows
    and null ids stay; other columns are ignored.
    """
    scanner = scanner or LicenseScanner()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"places": pa.list_(pa.struct([("start", pa.int32()), ("label", pa.string())])), "spans": pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("covered", pa.float64())]))}
        for b in batches:
            got = [scanner.scan(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([g[0] for g in got], pa.int64()),
                    pa.array([[{"start": i, "label": x} for i, x in g[1]] for g in got], types["places"]),
                    pa.array([[{"label": s.label, "start": s.start, "end": s.end, "covered": s.covered} for s in g[2]] for g in got], types["spans"]),
                    pa.array([g[3] for g in got], pa.float64()),
                ],
                ["doc_id", "n_words", "places", "spans", "score"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _SCHEMA)


def report(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: the labels of license_scan's places and spans."""
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    starts, base = F.transform("places", lambda p: p["start"]), F.transform("places", lambda p: p["label"])
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.transform("spans", lambda s: s["label"]))).alias("labels"),
        "score",
    )
