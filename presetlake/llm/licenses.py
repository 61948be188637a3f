"""Licence scans with a generalised suffix automaton of licence tokens.

The automaton holds the words of all templates and phrases. Streaming a text through it gives matching statistics: for
each word, the longest match that ends there. Long matches of a template are chained, in the order of both text and
template, into spans with the share of the template that they cover; the phrases are read off the same states.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presetlake.llm.common import ship

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices by which the licences are declared, and the texts of the short ones.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
    ),
    "cc-by": (
        "This work is licensed under the Creative Commons Attribution 4.0 International License",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA",
    ),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License"),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",),
}
#: Words of a long match, words between chained matches, covered share from which a span counts.
LONG, GAP, COVERED = 4, 6, 0.6

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` in UTF-8, where all other characters have bytes over 0x7F."""
    return (text or "").encode().translate(_WORDS).split()


class Automaton:
    """Templates are texts, or several texts, by label. Phrases of one word are looked up, all others are in the automaton."""

    def __init__(self, templates: Mapping[str, str | Sequence[str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES):
        listed = [(label, text) for label, texts in templates.items() for text in ([texts] if isinstance(texts, str) else texts)]
        self.labels = [label for label, _ in listed]
        own = [words(text) for _, text in listed]
        said = [(words(p), label) for p, label in phrases.items()]
        self.lengths = [len(x) for x in own]
        self.longest = max(self.lengths, default=0)
        self.ids: dict[bytes, int] = {}
        texts = [[self.ids.setdefault(w, len(self.ids)) for w in x] for x in [*own, *(p for p, _ in said)]]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: For each state, where its substrings end in each template.
        self.ends: list[dict[int, set[int]]] = [{}]
        for k, text in enumerate(texts):
            last = 0
            for at, token in enumerate(text if k < len(own) or len(text) > 1 else ()):
                last = self._extend(last, token)
                if k < len(own):
                    self.ends[last].setdefault(k, set()).add(at + 1)
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            for k, ends in self.ends[state].items():
                self.ends[self.link[state]].setdefault(k, set()).update(ends)
        marks: dict[int, list[tuple[int, str]]] = {}
        self.alone: dict[int, list[str]] = {}
        for (phrase, label), text in zip(said, texts[len(own) :]):
            if len(text) == 1:
                self.alone.setdefault(text[0], []).append(label)
            elif text:
                state = 0
                for token in text:
                    state = self.next[state][token]
                marks.setdefault(state, []).append((len(phrase), label))
        #: For each state, the phrases that its substrings may end with.
        self.said: list[list[tuple[int, str]]] = [[] for _ in self.next]
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.said[state] = [*self.said[self.link[state]], *marks.get(state, [])]
        #: Word pairs that some template or phrase has, and those that phrases begin with, as sorted numbers.
        self.base = len(self.ids) + 1
        key = lambda pairs: np.unique(np.array([a * self.base + b for a, b in pairs], np.int64))
        self.pair = key(p for text in texts for p in zip(text, text[1:]))
        self.opens = key((text[0], text[1]) for text in texts[len(own) :] if len(text) > 1)

    def _known(self, table: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.zeros(len(left), bool)
        keys = np.where((left >= 0) & (right >= 0), left * self.base + right, -1)
        return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            q = self.next[last][token]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, token, q)
        new = self._state({}, self.length[last] + 1, 0)
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q)
        return new

    def _state(self, edges: dict[int, int], length: int, link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        copy = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        return copy

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int, float]]]:
        """Number of words; phrases' labels and starts; spans: label, first word, word after the last, covered share."""
        tokens = words(text)
        ids = np.fromiter(map(self.ids.get, tokens, repeat(-1)), np.int64, len(tokens))
        alone = [(label, at) for token, labels in self.alone.items() for at in np.flatnonzero(ids == token).tolist() for label in labels]
        left, right = ids[:-1], ids[1:]
        joined = np.flatnonzero(self._known(self.pair, left, right))
        if not len(joined):
            return len(tokens), sorted(alone, key=lambda x: x[1]), []
        # Whatever is two words or longer lies in a run of known pairs; runs too short for any result are skipped.
        breaks = np.flatnonzero(np.diff(joined) > 1) + 1
        first, last = joined[np.concatenate([[0], breaks])], joined[np.concatenate([breaks - 1, [len(joined) - 1]])]
        opened = np.concatenate([[0], np.cumsum(self._known(self.opens, left, right))])
        useful = (last - first + 2 >= LONG) | (opened[last + 1] > opened[first])
        said: list[tuple[str, int]] = alone
        matches: list[tuple[int, int, int]] = []  # start, end, state
        for begin, end in zip(first[useful].tolist(), (last[useful] + 2).tolist()):
            state = size = 0
            for at, token in enumerate(ids[begin:end].tolist(), begin):
                held = state, size
                while state and token not in self.next[state]:
                    state = self.link[state]
                    size = self.length[state]
                if token in self.next[state]:
                    state, size = self.next[state][token], size + 1
                if size <= held[1] and held[1] >= LONG:
                    matches.append((at - held[1], at, held[0]))
                said += [(label, at + 1 - n) for n, label in self.said[state] if n <= size]
            if size >= LONG:
                matches.append((end - size, end, state))
        return len(tokens), sorted(said, key=lambda x: x[1]), self._chains(matches)

    def _anchors(self, matches: list[tuple[int, int, int]]) -> dict[int, list[tuple[int, int, int]]]:
        """By template: first word and word after the last in the text, first word in the template.

        A match stands at all its places in all templates; where a template has only a shorter end of it, that counts.
        """
        out: dict[int, list[tuple[int, int, int]]] = {}
        for begin, end, state in matches:
            seen: set[int] = set()
            size = end - begin
            while state > 0 and size >= LONG:
                for k, ends in self.ends[state].items():
                    if k not in seen:
                        seen.add(k)
                        out.setdefault(k, []).extend((end - size, end, until - size) for until in ends)
                state = self.link[state]
                size = min(size, self.length[state])
        return out

    def _chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """For each template the chains of matches, in the order of text and template, that cover most of its words.

        Matches of a chain are ``GAP`` words apart in the text at most; words that two of them share count once. The
        longest chain is taken first, and then the longest of what is left.
        """
        out: list[tuple[str, int, int, float]] = []
        for k, anchors in self._anchors(matches).items():
            anchors = sorted(set(anchors))
            score, before = [], []
            for i, (begin, end, start) in enumerate(anchors):
                best, last = end - begin, -1
                for j in range(i - 1, -1, -1):
                    b, e, s = anchors[j]
                    if b + self.longest + GAP < begin:
                        break
                    shared = max(0, e - begin, s + e - b - start)
                    if begin - e <= GAP and begin > b and start > s and shared < end - begin and score[j] + end - begin - shared > best:
                        best, last = score[j] + end - begin - shared, j
                score.append(best)
                before.append(last)
            used: set[int] = set()
            for i in sorted(range(len(anchors)), key=lambda i: (-score[i], anchors[i])):
                if score[i] < COVERED * self.lengths[k]:
                    break
                chain, at = [], i
                while at >= 0 and at not in used:
                    chain.append(at)
                    at = before[at]
                if at < 0:
                    used.update(chain)
                    first, stop = anchors[chain[-1]][0], anchors[i][1]
                    if not any(x[0] == self.labels[k] and x[1] < stop and first < x[2] for x in out):
                        out.append((self.labels[k], first, stop, min(1.0, score[i] / self.lengths[k])))
        return sorted(out, key=lambda x: (x[1], x[0]))


def scan(docs: DataFrame, templates: Mapping[str, str | Sequence[str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, phrases`` (label, start) and ``spans`` (label, start, stop, covered) of each row.

    Null and empty texts have no words. Overlapping places of phrases all count. Repeated rows and null ids each give
    their own row; other columns are left out. The automaton's size is fixed by the templates.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((templates, phrases))

    @F.pandas_udf("n_words long, phrases array<struct<label:string,start:long>>, spans array<struct<label:string,start:long,stop:long,covered:double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = Automaton(*shared.value)
        for texts in batches:
            rows = []
            for text in texts:
                n, said, spans = automaton.scan(text)
                rows.append((n, [{"label": x, "start": at} for x, at in said], [{"label": x, "start": a, "stop": b, "covered": c} for x, a, b, c in spans]))
            yield pd.DataFrame(rows, columns=["n_words", "phrases", "spans"])

    return docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("s")).select("doc_id", "s.*")


def digest(scanned: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of a scan.

    The score is 1 where a phrase stands, else the largest covered share of a span, else 0.
    """
    base, spans = F.transform("phrases", lambda x: x["label"]), F.transform("spans", lambda x: x["label"])
    starts = F.transform("phrases", lambda x: x["start"])
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    share = F.coalesce(F.array_max(F.transform("spans", lambda x: x["covered"])), F.lit(0.0))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.concat(base, spans)).alias("labels"),
        F.when(F.size("phrases") > 0, 1.0).otherwise(share).alias("score"),
    )


#: DuckDB SQL for ``doc_id`` and what the phrases decide.
BASE_SQL = r"""
WITH said AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
phrase AS (
  SELECT string_split(p, ' ') AS p, label FROM (VALUES %s) t(p, label)),
place AS (
  SELECT doc_id, i, label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM said), phrase WHERE w[i] = p[1] AND list_slice(w, i, i + len(p) - 1) = p)
SELECT s.doc_id, len(any_value(w))::BIGINT AS n_words, count(i)::BIGINT AS n_base, (min(i) - 1)::BIGINT AS first_word, (max(i) - 1)::BIGINT AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM said s LEFT JOIN place USING (doc_id) GROUP BY s.doc_id
""" % ", ".join(f"('{p}', '{label}')" for p, label in PHRASES.items())
