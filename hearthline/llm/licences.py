"""Licences in texts: fixed phrases, and template spans from matching statistics.

All templates' words go into one generalised suffix automaton. A text's words
stream through it, and at each word its state and suffix links give, for every
template, the longest piece that ends there, and all places of it. Pieces of
LEAST_MATCH words or more that don't go on in their template are chained, in the
order of text and template, into spans, and a span that covers COVERED of its
template carries the template's label. Words that no template pair contains reset the
automaton, so only stretches of template pairs are streamed word by word.
Templates of up to SHORT words must stand there in full and without a gap, others
must hold the words that tell their licence apart (TELLING). Of overlapping spans
with different labels the one that covers more words stays.

Words: letters A-Z are lower-cased; ASCII signs other than letters and digits
separate. Null texts count as empty: no words, places, labels, and a score of 0.
Repeated rows stay repeated; an empty table gives an empty table; columns other
than doc_id and text are not read.
"""

from __future__ import annotations

import bisect
import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_rows

#: Phrases and the labels they stand for.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Notices and permission texts of public licences, by label.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("bsd-3-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("apache-1.1", "Licensed under the Apache License, Version 1.1"),
    ("gpl-2", "licensed under the GNU General Public License, version 2"),
    ("gpl-2", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("lgpl-2.1", "licensed under the GNU Lesser General Public License, version 2.1"),
    ("lgpl-2.1", """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""),
    ("lgpl-3", "licensed under the GNU Lesser General Public License, version 3"),
    ("lgpl-3", """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""),
    ("agpl-3", "licensed under the GNU Affero General Public License, version 3"),
    ("agpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."""),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nd", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa", "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nc-nd", "licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
)
LEAST_MATCH, COVERED, SHORT = 4, 0.6, 20

#: Words that a span of a long template must hold, by label.
TELLING = {
    "mit": ("the above copyright notice and this permission notice",),
    "apache-2": ("version 2 0",),
    "gpl-2": ("gnu general public license", "version 2 of the license"),
    "gpl-3": ("gnu general public license", "version 3 of the license"),
    "lgpl-2.1": ("gnu lesser general public license", "version 2 1 of the license"),
    "lgpl-3": ("gnu lesser general public license", "version 3 of the license"),
    "agpl-3": ("gnu affero general public license", "version 3 of the license"),
    "bsd-2-clause": ("redistributions in binary form",),
    "bsd-3-clause": ("neither the name of",),
    "isc": ("provided that the above copyright notice",),
    "mpl-2": ("license v 2 0",),
    "unlicense": ("released into the public domain",),
}

#: Upper case to lower case, and each separating ASCII sign to a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class SuffixAutomaton:
    """Of several sequences. Each state knows, for every sequence it occurs in,
    where its occurrences there end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, set[int]]] = [{}]
        for k, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].setdefault(k, set()).add(at)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            above = self.ends[self.link[s]]
            for k, at in self.ends[s].items():
                above.setdefault(k, set()).update(at)

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.link) - 1

    def _split(self, p: int, word: int) -> int:
        """The state that p reaches by word, with exactly p's length and one."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word)
        return new

    def maximal_matches(self, sequence: list[int], least: int) -> list[tuple[int, int, int, int]]:
        """(template, start, start in the template, length) of the pieces of at least
        this length that are, where they end, the longest of their template, and that
        don't go on there. A piece that a template holds several times is given for each place."""
        found, state, length = [], 0, 0
        open_: dict[int, tuple[int, set[int]]] = {}  # of each template: length and ends of its piece so far
        for at, word in enumerate([*sequence, 0]):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.next[state].get(word, 0)
            length = length + 1 if state else 0
            now: dict[int, tuple[int, set[int]]] = {}
            s, n = state, length
            while s > 0 and n >= least:
                for k, ends in self.ends[s].items():
                    now.setdefault(k, (n, ends))
                s = self.link[s]
                n = self.length[s] if s > 0 else 0
            for k, (n, ends) in open_.items():
                on = now.get(k, (0, ()))
                for there in ends:
                    if on[0] != n + 1 or there + 1 not in on[1]:
                        found.append((k, at - n, there + 1 - n, n))
            open_ = now
        return found


def _holds(sequence: list[int], words: list[int]) -> bool:
    return any(sequence[i : i + len(words)] == words for i in range(len(sequence) - len(words) + 1))


class LicenceScanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.labels = [label for label, _ in templates]
        split = [words_of(text) for _, text in templates]
        spoken = [text.encode().split() for text, _ in phrases]
        self.ids = {w: i for i, w in enumerate(sorted({w for ws in split + spoken for w in ws}), 1)}
        sequences = [[self.ids[w] for w in ws] for ws in split]
        self.phrases = [(label, np.array([self.ids[w] for w in ws])) for (_, label), ws in zip(phrases, spoken)]
        self.sizes = [len(s) for s in sequences]
        self.telling = [[] if len(s) <= SHORT else [[self.ids.get(w, -1) for w in text.encode().split()] for text in TELLING.get(label, ())] for label, s in zip(self.labels, sequences)]
        self.automaton = SuffixAutomaton(sequences)
        n = len(self.ids) + 1
        self.pair = np.zeros((n, n), bool)
        for s in [*sequences, *(p.tolist() for _, p in self.phrases)]:
            self.pair[s[:-1], s[1:]] = True

    def scan(self, text: str) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, float]]]:
        """Number of words; places (word, label) of phrases; template spans (first word, end, label, covered share)."""
        words = words_of(text)
        get = self.ids.get
        ids = np.array([get(w, 0) for w in words], np.int64)
        if len(ids) < 2:
            return len(ids), [], []
        near = np.flatnonzero(self.pair[ids[:-1], ids[1:]])
        if not len(near):
            return len(ids), [], []
        places: list[tuple[int, str]] = []
        for label, phrase in self.phrases:
            at = near[near <= len(ids) - len(phrase)]
            for k, word in enumerate(phrase.tolist()):
                at = at[ids[at + k] == word]
            places += [(p, label) for p in at.tolist()]
        breaks = np.flatnonzero(np.diff(near) > 1) + 1
        matches: dict[int, list[tuple[int, int, int]]] = {}
        for run in np.split(near, breaks):
            if len(run) + 1 >= LEAST_MATCH:
                first = int(run[0])
                for k, start, there, length in self.automaton.maximal_matches(ids[first : first + len(run) + 1].tolist(), LEAST_MATCH):
                    matches.setdefault(k, []).append((first + start, there, length))
        spans = []
        for k, found in matches.items():
            size = self.sizes[k]
            if size <= SHORT:
                chains = [(a, a + size, 1.0) for a, _, n in found if n == size]
            else:
                chains = [x for x in self._chain(found, size) if all(_holds(ids[x[0] : x[1]].tolist(), words) for words in self.telling[k])]
            spans += [(a, b, self.labels[k], c, c * size) for a, b, c in chains]
        return len(ids), sorted(places), sorted(self._best(spans))

    @staticmethod
    def _best(spans: list[tuple[int, int, str, float, float]]) -> list[tuple[int, int, str, float]]:
        """The spans without those that overlap one of another label with more covered words, or as many and a larger share."""
        kept, owner = [], {}  # the label that each word of the text belongs to
        for a, b, label, c, _ in sorted(spans, key=lambda x: (-round(x[4], 6), -x[3], x)):
            if all(owner.get(i, label) == label for i in range(a, b)):
                kept.append((a, b, label, c))
                owner.update(dict.fromkeys(range(a, b), label))
        return kept

    @classmethod
    def _chain(cls, found: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, float]]:
        """Chains matches (place in text, place in template, length) of one template
        where both go on and no more than the template's size lies between; the
        chains that cover enough, best first, without overlaps. What is left beside
        the chains that were taken is chained again."""
        out: list[tuple[int, int, float]] = []
        found = sorted(found)
        while found:
            taken: list[tuple[int, int, float]] = []  # in order, apart from each other
            for first, last, covered in cls._best_chains(found, size):
                at = bisect.bisect(taken, (first, last, 0.0))
                if (at == 0 or taken[at - 1][1] <= first) and (at == len(taken) or last <= taken[at][0]):
                    taken.insert(at, (first, last, min(1.0, covered / size)))
            out += taken
            if not taken:
                break
            kept, i = [], 0
            for m in found:
                while i < len(taken) and taken[i][1] <= m[0]:
                    i += 1
                if i == len(taken) or m[0] + m[2] <= taken[i][0]:
                    kept.append(m)
            found = kept
        return sorted(out)

    @staticmethod
    def _best_chains(found: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, int]]:
        """(first word, end, covered words) of the chain that ends best at each match and covers enough, best first."""
        best, back = [], []
        for i, (a, t, n) in enumerate(found):
            score, prior = n, -1
            j = i - 1
            while j >= 0 and a - found[j][0] <= 2 * size:
                b, u, m = found[j]
                fresh = n - max(0, b + m - a, u + m - t)  # words that the earlier match has not covered
                if a - b - m <= size and b < a and u < t and fresh > 0 and best[j] + fresh > score:
                    score, prior = best[j] + fresh, j
                j -= 1
            best.append(score)
            back.append(prior)
        out = []
        for i in sorted(range(len(found)), key=lambda i: (-best[i], i)):
            if best[i] < COVERED * size:
                break
            j = i
            while back[j] >= 0:
                j = back[j]
            out.append((found[j][0], found[i][0] + found[i][2], best[i]))
        return out


@functools.cache
def scanner() -> LicenceScanner:
    return LicenceScanner()


def scan_licences(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, places (label, word) of the fixed phrases, and spans
    (label, first word, end exclusive, covered share) of the templates."""

    def make():
        scan = scanner().scan

        def step(rows):
            found = [scan(t) for t in rows["text"]]
            return {
                "doc_id": rows["doc_id"],
                "n_words": [n for n, _, _ in found],
                "places": [[{"label": x, "word": w} for w, x in places] for _, places, _ in found],
                "spans": [[{"label": x, "first": a, "end": b, "covered": c} for a, b, x, c in spans] for _, _, spans in found],
            }

        return step

    return map_rows(id_and_text(docs), "doc_id long, n_words long, places array<struct<label:string,word:long>>, spans array<struct<label:string,first:long,end:long,covered:double>>", make)


def licence_digests(docs: DataFrame) -> DataFrame:
    """Counts and labels; the score is the best covered share, 1 where a phrase stands."""
    base, more = F.array_distinct(F.col("places.label")), F.col("spans.label")
    return scan_licences(docs).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.covered"), F.lit(0.0))).alias("score"),
    )
