"""License scans: matching statistics of a generalised suffix automaton, chained to template spans.

The automaton holds the token sequences of all templates. Texts stream through
it token by token; what comes out are the maximal runs of tokens that some
template holds. Runs of one template in order, with short gaps, are a chain;
a chain that covers enough of the template labels the text. A text has a span
for every copy of a template that it holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.tokens import NOT_ALNUM, Words, text_chunks, tidy

#: Phrases that count by themselves, wherever their words stand together.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices and license passages in common use, by label.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Licensed under the BSD License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

#: Whole texts of short licenses, and of the notices of long ones, by label.
BODIES = (
    ("mit", """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
        IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
        THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
        FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
        ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd", """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR
        A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
        LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
        (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("zlib", """
        This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation
        would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        3. This notice may not be removed or altered from any source distribution."""),
    ("boost", """
        Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display,
        distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
        The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part,
        and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."""),
    ("unlicense", """
        This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
        for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the
        public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
        present and future rights to this software under copyright law."""),
    ("apache-2.0", """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl", """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
        See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/."""),
    ("mpl-2.0", """
        This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
)

#: Shortest run of tokens that may stand in a chain, tokens that a chain may jump, and the share of a template that labels.
MIN_RUN, MAX_GAP, MIN_COVER = 3, 6, 0.8


class SuffixAutomaton:
    """Of several sequences of integers. Each state knows all places where its strings end in each sequence."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.len = [0]
        places: list[set[tuple[int, int]]] = [set()]
        self.places = places
        for which, sequence in enumerate(sequences):
            last = 0
            for at, token in enumerate(sequence):
                last = self._extend(last, token)
                places[last].add((which, at))
        for state in sorted(range(1, len(self.len)), key=lambda s: -self.len[s]):
            if self.link[state] > 0:
                places[self.link[state]] |= places[state]
        self.ends = [sorted(p) for p in places]

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.len.append(length)
        self.places.append(set())
        return len(self.len) - 1

    def _clone(self, state: int, source: int, token: int) -> int:
        copy = self._new(self.len[source] + 1)
        self.next[copy] = dict(self.next[state])
        self.link[copy] = self.link[state]
        self.link[state] = copy
        while source >= 0 and self.next[source].get(token) == state:
            self.next[source][token] = copy
            source = self.link[source]
        return copy

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:  # an earlier sequence has been here
            state = self.next[last][token]
            return state if self.len[state] == self.len[last] + 1 else self._clone(state, last, token)
        made = self._new(self.len[last] + 1)
        source = last
        while source >= 0 and token not in self.next[source]:
            self.next[source][token] = made
            source = self.link[source]
        if source >= 0:
            state = self.next[source][token]
            self.link[made] = state if self.len[state] == self.len[source] + 1 else self._clone(state, source, token)
        return made

    def matches(self, tokens: list[int], least: int) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of every run that can't be longer to the right, of ``least`` tokens or more."""
        state = length = 0
        for at, token in enumerate(tokens):
            if token not in self.next[state]:
                if length >= least:
                    yield at - 1, length, state
                while state and token not in self.next[state]:
                    state = self.link[state]
                length = self.len[state]
            if token in self.next[state]:
                state = self.next[state][token]
                length += 1
            else:
                length = 0
        if length >= least:
            yield len(tokens) - 1, length, state


class Scanner:
    """Templates and phrases, ready to scan batches of texts."""

    def __init__(self, templates=TEMPLATES + BODIES, phrases=PHRASES):
        words = Words([t for _, t in templates], NOT_ALNUM)
        h = words.hashes()
        self.labels = [label for label, _ in templates]
        self.vocabulary, ids = np.unique(h, return_inverse=True)
        self.lengths = words.count.tolist()
        self.automaton = SuffixAutomaton([ids[a:b].tolist() for a, b in zip(words.first[:-1], words.first[1:], strict=True)])
        self.likely = np.zeros(1 << 16, dtype=bool)
        self.likely[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
        said = Words(list(phrases), NOT_ALNUM)
        g = said.hashes()
        self.phrases = [(label, g[a:b]) for label, a, b in zip(phrases.values(), said.first[:-1], said.first[1:], strict=True)]

    def token_ids(self, h: np.ndarray) -> np.ndarray:
        """Each word's place in the vocabulary, -1 for others."""
        out = np.full(len(h), -1, dtype=np.int64)
        some = np.flatnonzero(self.likely[(h & np.uint64(0xFFFF)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.vocabulary, h[some]), len(self.vocabulary) - 1)
        right = self.vocabulary[place] == h[some]
        out[some[right]] = place[right]
        return out

    def chains(self, found: list[tuple[int, int, list[tuple[int, int]]]]) -> tuple[float, list[tuple[int, float, int, int]]]:
        """The largest share of a template covered, and (template, share, first word, last word) of the chains that cover MIN_COVER.

        found: (start, length, places in templates) by start. Of chains of one
        template that overlap in the text, the one that covers most stays, the
        earlier one of equals.
        """
        top, good = 0.0, []
        tails: dict[int, list[tuple[int, int, int, int]]] = {}
        for start, length, ends in found:
            fresh: dict[int, list[tuple[int, int, int, int]]] = {}
            for which, end in ends:
                lo = end - length + 1
                own = (length, start, start + length - 1, end)
                for covered, first, last, at in tails.get(which, ()):
                    overlap = max(0, at + 1 - lo, last + 1 - start)
                    if at < end and start - last - 1 <= MAX_GAP and overlap < length and covered + length - overlap > own[0]:
                        own = (covered + length - overlap, first, start + length - 1, end)
                fresh.setdefault(which, []).append(own)
                share = min(1.0, own[0] / self.lengths[which])
                top = max(top, share)
                if share >= MIN_COVER:
                    good.append((which, share, own[1], own[2]))
            # chains that are out of reach are dropped: a text may hold any number of runs
            for which, own in fresh.items():
                tails[which] = [t for t in tails.get(which, ()) if start - t[2] - 1 <= MAX_GAP] + own
        kept: list[tuple[int, float, int, int]] = []
        taken: dict[int, list[tuple[int, int]]] = {}
        for which, share, first, last in sorted(good, key=lambda g: (g[0], -g[1], g[2], g[3])):
            if all(last < a or first > b for a, b in taken.get(which, ())):
                taken.setdefault(which, []).append((first, last))
                kept.append((which, share, first, last))
        return top, kept

    def scan(self, texts: list[str | None]) -> Iterator[dict]:
        words = Words(texts, NOT_ALNUM)
        h = words.hashes()
        doc = np.repeat(np.arange(len(texts)), words.count)
        base: list[list[tuple[int, str]]] = [[] for _ in texts]
        for label, phrase in self.phrases:
            at = np.flatnonzero(h == phrase[0])
            at = at[at + len(phrase) <= len(h)]
            for j in range(1, len(phrase)):
                at = at[h[at + j] == phrase[j]]
            at = at[doc[at] == doc[at + len(phrase) - 1]]
            for x in at:
                base[doc[x]].append((int(x - words.first[doc[x]]), label))
        ids = self.token_ids(h)
        # runs of template words within one text, the only places where matches can be
        inside = ids >= 0
        fresh = np.ones(len(h) + 1, dtype=bool)
        fresh[1:-1] = (inside[1:] != inside[:-1]) | (doc[1:] != doc[:-1])
        edges = np.flatnonzero(fresh)
        lengths = np.diff(edges)
        runs: dict[int, list[tuple[int, int, list[tuple[int, int]]]]] = {}
        for lo, size in zip(edges[:-1], lengths, strict=True) if len(h) else ():
            if size >= MIN_RUN and inside[lo]:
                d = int(doc[lo])
                for end, length, state in self.automaton.matches(ids[lo : lo + size].tolist(), MIN_RUN):
                    runs.setdefault(d, []).append((int(lo - words.first[d]) + end - length + 1, length, self.automaton.ends[state]))
        for i in range(len(texts)):
            top, covered = self.chains(runs.get(i, []))
            spans = sorted({(self.labels[w], a, b, c) for w, c, a, b in covered})
            labels = {label for _, label in base[i]}
            places = [p for p, _ in base[i]]
            yield {
                "n_words": int(words.count[i]),
                "n_base": len(places),
                "first_word": min(places, default=None),
                "last_word": max(places, default=None),
                "base_labels": ",".join(sorted(labels)),
                "labels": ",".join(sorted(labels | {s[0] for s in spans})),
                "score": 1.0 if places else top,
                "spans": [{"label": a, "first": b, "last": c, "covered": d} for a, b, c, d in spans],
            }


_FIELDS = [
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.float64())]))),
]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES + BODIES, phrases=PHRASES) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts the places of the phrases; first_word and last_word are the
    smallest and largest word that one starts at, null without any. labels also
    has those of templates covered by a chain to MIN_COVER or more; spans tells
    where. score is the largest share of a template that is covered, and 1 where
    a phrase stands.

    Null and empty texts have no words and no labels. Rows are scanned one by
    one, so repeated rows agree and nothing is shuffled; other columns are ignored, and
    an empty table gives no rows. spans has every copy of a template; chains of
    one template that overlap give way to the one that covers most, then the first.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for batch in batches:
            for part, texts in text_chunks(batch.column(1)):
                rows = list(scanner.scan(texts))
                arrays = [pa.array([r[name] for r in rows], type) for name, type in _FIELDS]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, part.stop - part.start), *arrays], names=["id", *[n for n, _ in _FIELDS]])

    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,covered:double>>"
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)
