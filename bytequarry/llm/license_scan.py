"""License scans with a generalised suffix automaton of licence templates.

All templates' words go into one automaton. A text streams through it and yields its
matching statistics: for each place, the longest stretch of words ending there that
occurs in some template, and, through its suffixes, the longest one of each template.
Maximal stretches of at least ``MIN_MATCH`` words are chained in order for each template,
at every place where it has them, and the words a chain covers, as a share of the
template, are that template's score. Stretches at most ``MAX_GAP`` words apart chain;
there is no other limit on them.

Templates are notices, short licences and telling clauses of long ones, and can be given
by the caller. They are small, so the automaton travels with the task. A text takes time
linear in its words.

Defined cases: a null or empty text has no words, no labels and score 0; very long texts
are scanned whole; repeated rows are scanned each; an empty table gives an empty result;
other columns are not read, so they may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Phrases whose every place counts, with their labels.
PHRASES: tuple[tuple[str, str], ...] = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Licence notices and the operative parts of public licence texts, with their labels.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("bsl-1", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl-3", "under the terms of the GNU Affero General Public License"),
    ("epl", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("cc0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software."),
    ("unlicense", "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
)

#: Shortest stretch that counts, and the share of a template that must be covered.
MIN_MATCH = 3
COVERED = 0.7
#: A chain's next stretch starts at most so many words after the one before.
MAX_GAP = 40


def words(text: str | None) -> list[bytes]:
    """ASCII letters lower-cased; letters, digits and all other code points above ASCII make words."""
    return _WORD.findall((text or "").encode("utf-8", "replace").lower())


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of ids.

    ``ends[s]`` has every place at which state s's strings end, for each sequence that has
    any; ``longest[s]`` has, for each sequence, the longest suffix of s's longest string
    that occurs in it, and that suffix's state.
    """

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [{}]
        for k, seq in enumerate(sequences):
            last = 0
            for i, c in enumerate(seq):
                last = self._extend(last, c)
                self.ends[last].setdefault(k, set()).add(i + 1)
        by_length = sorted(range(1, len(self.link)), key=lambda s: self.length[s])
        for s in reversed(by_length):
            for k, places in self.ends[s].items():
                self.ends[self.link[s]].setdefault(k, set()).update(places)
        self.longest: list[dict[int, tuple[int, int]]] = [{} for _ in self.link]
        for s in by_length:
            self.longest[s] = self.longest[self.link[s]] | {k: (self.length[s], s) for k in self.ends[s]}

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges), self.link.append(link), self.length.append(length), self.ends.append({})
        return len(self.link) - 1

    def _split(self, p: int, c: int) -> int:
        """The state for p's longest string and c, where p has an edge c."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        self.link[new] = self._split(p, c) if p >= 0 else 0
        return new

    def stretches(self, ids: list[int | None], least: int) -> list[tuple[int, int, int, int]]:
        """(sequence, end, length, state) of every match of ``least`` ids or more that its sequence does not extend.

        The text streams through the automaton once. Where the longest match of all has
        ``least`` ids, each sequence has its own longest one: a suffix of it.
        """
        nxt, link, length, longest = self.next, self.link, self.length, self.longest
        state = run = 0
        now: dict[int, tuple[int, int]] = {}
        out = []
        for i, c in enumerate([*ids, None]):
            if c is None:
                state = run = 0
            else:
                while state and c not in nxt[state]:
                    state = link[state]
                    run = length[state]
                to = nxt[state].get(c)
                state, run = (0, 0) if to is None else (to, run + 1)
            if run < least and not now:
                continue
            before, now = now, {k: (min(n, run), s) for k, (n, s) in longest[state].items() if n >= least} if run >= least else {}
            for k, (n, s) in before.items():
                if k not in now or now[k][0] != n + 1:
                    out.append((k, i, n, s))
        return out


def chain(parts: list[tuple[int, int, int]], max_gap: int = MAX_GAP) -> tuple[int, int, int]:
    """The best chain of (text start, template start, length) in order on both sides: words covered, first and last place.

    Parts come by their ends in the text, so those before one are looked at back to the gap.
    """
    best: list[tuple[int, int]] = []
    top = (0, 0, 0)
    for i, (x, y, n) in enumerate(parts):
        covered, first = n, x
        for j in range(i - 1, -1, -1):
            px, py, pn = parts[j]
            if x - px - pn > max_gap:
                break
            over = max(0, px + pn - x, py + pn - y)
            if py < y and px < x and over < n and best[j][0] + n - over > covered:
                covered, first = best[j][0] + n - over, best[j][1]
        best.append((covered, first))
        top = max(top, (covered, first, x + n))
    return top


class Scanner:
    """All that a task needs: phrases, vocabulary, automaton."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        seqs = [words(t) for _, t in templates]
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for s in seqs for w in s))}
        self.labels, self.lengths = [x for x, _ in templates], [len(s) for s in seqs]
        self.automaton = SuffixAutomaton([[self.vocabulary[w] for w in s] for s in seqs])
        self.phrases = [(tuple(words(p)), label) for p, label in phrases]
        self.firsts = {p[0] for p, _ in self.phrases}

    def spans(self, ws: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, end, share of the template covered) for each template that some stretch belongs to."""
        ids = list(map(self.vocabulary.get, ws))
        parts: dict[int, list[tuple[int, int, int]]] = {}
        for k, end, n, state in self.automaton.stretches(ids, MIN_MATCH):
            parts.setdefault(k, []).extend((end - n, at - n, n) for at in sorted(self.automaton.ends[state][k]))
        out = []
        for k, p in parts.items():
            covered, first, end = chain(p)
            out.append((self.labels[k], first, end, min(1.0, covered / self.lengths[k])))
        return out

    def scan(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
        ws = words(text)
        starts, base = [], set()
        firsts = self.firsts
        for i in [i for i, w in enumerate(ws) if w in firsts]:
            for p, label in self.phrases:
                if ws[i] == p[0] and tuple(ws[i : i + len(p)]) == p:
                    starts.append(i)
                    base.add(label)
        spans = self.spans(ws)
        found = [s for s in spans if s[3] >= COVERED]
        labels = base | {s[0] for s in found}
        score = max([s[3] for s in spans] + [1.0 * bool(base)], default=0.0)
        return len(ws), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, found


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, first_word: long, end_word: long, covered: double>>"
)


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """One row per document with its licence labels, score and covered spans."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, phrases)
        names = [c.split()[0] for c in SCHEMA.split("spans")[0].strip(", ").split(", ")] + ["spans"]
        for pdf in batches:
            rows = [(d, *scanner.scan(t)) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True)]
            out = pd.DataFrame(rows, columns=names)
            for c in ("doc_id", "first_word", "last_word"):
                out[c] = pd.array(out[c], dtype="Int64")
            out["spans"] = [[{"label": a, "first_word": b, "end_word": c, "covered": d} for a, b, c, d in s] for s in out["spans"]]
            yield out

    return df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInPandas(run, SCHEMA)
