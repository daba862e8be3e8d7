"""Licence notices in texts, by a suffix automaton over the words of templates."""

from collections.abc import Callable, Iterator
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.batches import slices, with_results
from treeledger.llm.decontamination import plain_words

# The phrases that name a licence by themselves.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
# The wording of common notices.
TEMPLATES = (
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0.
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""),
    ("lgpl", """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""),
    ("agpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software."""),
    ("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy,
        modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
        binary, for any purpose, commercial or non-commercial, and by any means."""),
)
# Names that a notice of one line gives a licence after the words that grant it, and SPDX ids.
NAMES = (
    ("agpl", ("gnu affero general public license", "affero general public license", "gnu agpl", "agpl", "agplv3"), ("agpl",)),
    ("apache-2", ("apache license", "apache 2 0", "apache software license"), ("apache 2",)),
    ("bsd", ("bsd license", "bsd 2 clause", "bsd 3 clause", "2 clause bsd", "3 clause bsd", "new bsd", "simplified bsd",
             "modified bsd", "bsd style license"), ("bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "0bsd")),
    *((f"cc-by{kind.replace(' ', '-')}", (f"cc by{kind}", f"creative commons by{kind}", f"creative commons attribution{said}"),
       (f"cc by{kind}",)) for kind, said in
      (("", ""), (" sa", " sharealike"), (" sa", " share alike"), (" nd", " noderivatives"), (" nd", " noderivs"),
       (" nc", " noncommercial"), (" nc", " non commercial"), (" nc sa", " noncommercial sharealike"),
       (" nc sa", " non commercial share alike"), (" nc nd", " noncommercial noderivatives"), (" nc nd", " non commercial no derivatives"))),
    ("artistic", ("artistic license", "perl artistic license"), ("artistic 1 0", "artistic 2 0")),
    ("cc0", ("cc0", "creative commons zero", "creative commons cc0"), ("cc0",)),
    ("epl", ("eclipse public license",), ("epl 1 0", "epl 2 0")),
    ("gpl", ("gnu general public license", "general public license", "gnu public license", "gnu gpl", "gpl", "gplv2", "gplv3"),
     ("gpl",)),
    ("isc", ("isc license",), ("isc",)),
    ("lgpl", ("gnu lesser general public license", "gnu library general public license", "lesser general public license",
              "gnu lgpl", "lgpl", "lgplv2", "lgplv3"), ("lgpl",)),
    ("mit", ("mit license", "mit licence", "expat license"), ("mit",)),
    ("mpl-2", ("mozilla public license", "mpl 2 0", "mpl v2", "mplv2"), ("mpl 2",)),
    ("unlicense", ("unlicense",), ("unlicense",)),
)
GRANTS = ("under", "under the", "under a", "under the terms of", "under the terms of the", "under the terms and conditions of the")
# What names a licence without such a word, besides SPDX lines.
LINES = (
    *((label, f"{name} {version}") for label, name in
      (("gpl", "gnu general public license"), ("lgpl", "gnu lesser general public license"),
       ("lgpl", "gnu library general public license"), ("agpl", "gnu affero general public license"),
       ("mpl-2", "mozilla public license")) for version in ("version", "v", "v2", "v3")),
    ("mpl-2", "mozilla public license 2 0"), ("apache-2", "apache 2 0 license"), ("apache-2", "mit or apache 2 0"),
    ("mit", "apache 2 0 or mit"), ("bsd", "bsd 2 clause license"), ("bsd", "bsd 3 clause license"),
    ("bsd", "3 clause bsd license"), ("bsd", "2 clause bsd license"), ("unlicense", "released into the public domain"),
    ("bsd", "bsd 2 clause"), ("bsd", "bsd 3 clause"), ("mit", "is mit licensed"), ("mit", "code mit licensed"),
    ("epl", "eclipse public license version"), ("epl", "eclipse public license v"), ("epl", "eclipse public license 2 0"),
    ("artistic", "artistic license 2 0"), ("artistic", "artistic license version"),
)
# A notice of one line after one of these, with at most NEAR words between, grants nothing.
DENIALS, NEAR = frozenset((b"not", b"never", b"nor", b"isn", b"aren", b"cannot")), 2
NOTICES = tuple((label, line) for label, line in dict.fromkeys((
    *LINES, *((label, f"{grant} {name}") for label, names, _ in NAMES for grant in GRANTS for name in names),
    *((label, f"spdx license identifier {own}") for label, _, ids in NAMES for own in ids))) if len(line.split()) >= 3)
# Whole licences, by label and file.
FULL = (("apache-2", "apache-2"), ("bsd", "bsd"), ("cc0", "cc0"), ("gpl", "gpl-2"), ("gpl", "gpl-3"), ("lgpl", "lgpl-2.1"),
        ("lgpl", "lgpl-3"), ("mpl-2", "mpl-2"))
# A template is found where the matches hold COVERED of its words or PASSAGE words, whichever is less.
MATCH_WORDS, GAP_WORDS, COVERED, PASSAGE = 6, 20, 0.5, 150


def full_texts() -> tuple:
    folder = Path(__file__).parent / "license_texts"
    return tuple((label, (folder / f"{name}.txt").read_text()) for label, name in FULL)


class Automaton:
    """Suffix automaton of several word sequences: every path from the start spells a stretch of one of them."""

    def __init__(self, sequences: list[list[bytes]]):
        self.numbers: dict[bytes, int] = {}
        self.next, self.link, self.length = [{}], [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for which, words in enumerate(sequences):
            state = 0
            for place, word in enumerate(words):
                state = self._extend(state, self.numbers.setdefault(word, len(self.numbers) + 1))
                self.ends[state].append((which, place + 1))
        # A stretch also ends wherever a longer one with it as its end does.
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] += self.ends[state]
        self.ends = [sorted(set(found)) for found in self.ends]

    def _new(self, length: int, like: int | None = None) -> int:
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(-1 if like is None else self.link[like])
        self.length.append(length)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, state: int, word: int, child: int) -> int:
        """The state of what `state` spells plus the word, apart from the longer stretches of the child."""
        if self.length[child] == self.length[state] + 1:
            return child
        copy = self._new(self.length[state] + 1, child)
        self.link[child] = copy
        while state >= 0 and self.next[state].get(word) == child:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:  # an earlier sequence has been here
            return self._split(last, word, self.next[last][word])
        current, state = self._new(self.length[last] + 1), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = current
            state = self.link[state]
        self.link[current] = 0 if state < 0 else self._split(state, word, self.next[state][word])
        return current

    def statistics(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """Per word the state and length of the longest stretch of a sequence that ends there."""
        state = length = 0
        for word in ids:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            yield state, length


class Scanner:
    """Finds phrases, notices of one line and template spans in runs of known words."""

    def __init__(self, phrases=PHRASES, templates=TEMPLATES, match: int = MATCH_WORDS, gap: int = GAP_WORDS, notices=NOTICES):
        self.match, self.gap = match, gap
        named = [(label, plain_words(text.encode())) for label, text in (*phrases, *notices, *templates)]
        self.labels, sequences = [label for label, _ in named], [words for _, words in named]
        self.sizes, self.phrases = [len(words) for words in sequences], len(phrases)
        self.whole = self.phrases + len(notices)
        self.automaton = Automaton(sequences)
        # Phrases and notices (number, words) that a match in a state ends with, once it is that long: those
        # that the state spells itself, then those of the shorter stretches it links to.
        self.endings: list[list[tuple[int, int]]] = [[] for _ in self.automaton.link]
        for state in sorted(range(1, len(self.endings)), key=self.automaton.length.__getitem__):
            link = self.automaton.link[state]
            spelt = range(self.automaton.length[link] + 1, self.automaton.length[state] + 1)
            own = [(which, end) for which, end in self.automaton.ends[state]
                   if which < self.whole and end == self.sizes[which] and end in spelt]
            self.endings[state] = own + self.endings[link]
        self.shortest = min([match, *self.sizes[:self.whole]])

    def runs(self, texts: list[list[bytes]]) -> Iterator[tuple[int, int, list[int]]]:
        """(text, first word, word numbers) of each stretch of known words that is long enough to matter."""
        sizes = np.array([len(words) + 1 for words in texts])
        starts = np.cumsum(sizes) - sizes
        ids = np.zeros(sizes.sum(), np.int64)
        for start, own in zip(starts, texts):
            ids[start:start + len(own)] = np.fromiter(map(self.automaton.numbers.get, own, repeat(0)), np.int64, len(own))
        edges = np.flatnonzero(np.diff(np.r_[False, ids != 0, False]))
        first, last = edges[::2], edges[1::2]
        long = last - first >= self.shortest
        owner = np.searchsorted(starts, first, "right") - 1
        for which, a, b in zip(owner[long].tolist(), first[long].tolist(), last[long].tolist()):
            yield which, a - int(starts[which]), ids[a:b].tolist()

    def matches(self, first: int, ids: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Phrases and notices as (number, start), and long matches that no word extends as (state, end, words)."""
        places, long, before = [], [], (0, 0)
        for at, (state, length) in enumerate(self.automaton.statistics(ids), first):
            places += [(which, at + 1 - n) for which, n in self.endings[state] if length >= n]
            if before[1] >= self.match and length <= before[1]:
                long.append((before[0], at, before[1]))
            before = state, length
        if before[1] >= self.match:
            long.append((before[0], first + len(ids), before[1]))
        return places, long

    def chains(self, long: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
        """Spans (template, start, end, words covered, matches): matches in the order of both template and text, close together."""
        open_: dict[int, list[int]] = {}
        done = []
        for state, end, length in long:
            for which in sorted({w for w, _ in self.automaton.ends[state] if w >= self.whole}):
                ends = [e for w, e in self.automaton.ends[state] if w == which]
                chain = open_.get(which)
                # The next place in the template after what the chain has, if there is one.
                goes_on = [e for e in ends if chain and e > chain[3]] if chain and end - length - chain[1] <= self.gap else []
                if goes_on:
                    step = min(goes_on)
                    chain[2] += min(length, step - chain[3], end - chain[1])
                    chain[1], chain[3] = end, step
                    chain[4] += 1
                else:
                    if chain:
                        done.append((which, *chain[:3], chain[4]))
                    open_[which] = [end - length, end, length, min(ends), 1]
        return done + [(which, *chain[:3], chain[4]) for which, chain in open_.items()]

    def notices(self, places: list[tuple[int, int]], words: list[bytes]) -> list[tuple[int, int, int, int]]:
        """Notices of one line as (number, start, end, words), without those that the words before deny."""
        return [(which, at, at + self.sizes[which], self.sizes[which]) for which, at in places
                if which >= self.phrases and DENIALS.isdisjoint(words[max(0, at - NEAR - 1):at])]

    def chosen(self, chains: list[tuple[int, int, int, int, int]], notices: list[tuple[int, int, int, int]]
               ) -> list[tuple[int, int, int, int]]:
        """Spans (template or notice, start, end, words) in one contest between licences.

        A span loses to one of another licence with more words, or as many in fewer matches,
        that holds more than half of it; a notice only to one that holds all of it. So CC BY is
        none inside CC BY-NC, and a licence that a found one mentions is none either.
        """
        def loses(x, y):
            shared = min(x[2], y[2]) - max(x[1], y[1])
            inside = shared == x[2] - x[1] if x[0] < self.whole else 2 * shared > x[2] - x[1]
            return inside and (y[3], -y[4]) > (x[3], -x[4])

        return [span[:4] for span in self._best([*chains, *((*n, 1) for n in notices)], loses)]

    def _best(self, spans: list[tuple], loses: Callable[[tuple, tuple], bool]) -> list[tuple]:
        """Spans that lose to none of another licence, in order of their starts; only spans that overlap are compared."""
        spans = sorted(spans, key=lambda s: s[1:3])
        lost, active = set(), []
        for i, span in enumerate(spans):
            active = [j for j in active if spans[j][2] > span[1]]
            for j in active:
                if self.labels[spans[j][0]] != self.labels[span[0]]:
                    lost |= {x for x, y in ((i, j), (j, i)) if loses(spans[x], spans[y])}
            active.append(i)
        return [span for i, span in enumerate(spans) if i not in lost]

    def scan(self, texts: list[list[bytes]]) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int, int, int, int]]]]:
        places, long = [[] for _ in texts], [[] for _ in texts]
        for which, first, ids in self.runs(texts):
            found, more = self.matches(first, ids)
            places[which] += found
            long[which] += more
        return places, [self.chains(own) for own in long]


SPAN = "struct<label:string,start:long,end:long,cover:double>"


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, covered: float = COVERED,
         phrases=PHRASES, templates=None, notices=NOTICES) -> DataFrame:
    """Documents with n_words, phrases and spans, both as (label, start, end, cover) of words.

    A phrase stands whole, with cover 1, and so does a notice of one line, which is a span. Any
    other span chains long matches with one template; cover is the share of the template's words
    that it holds, at least `covered` or PASSAGE words of it. Where spans of two licences overlap
    the one with more words stays, so a licence that a found one mentions has no span; nor has a
    notice that the words before it deny. Repeated rows get equal results. closest is the best cover of any chain, also below that. A
    null text has no words. Templates (by default the notices and the whole licences) are few,
    so their automaton goes out with the tasks. Of an SPDX expression the first licence counts.
    """
    scanner = Scanner(phrases, (*TEMPLATES, *full_texts()) if templates is None else templates, notices=notices)

    def compute(texts: pa.Array):
        rows = []
        for part in slices(texts):
            words = [plain_words(raw) for raw in part]
            for own, places, chains in zip(words, *scanner.scan(words)):
                said = [{"label": scanner.labels[w], "start": at, "end": at + scanner.sizes[w], "cover": 1.0}
                        for w, at in sorted(places, key=lambda p: p[::-1]) if w < scanner.phrases]
                found = [(a, b, n, w) for w, a, b, n in scanner.chosen(
                    [c for c in chains if c[3] >= min(covered * scanner.sizes[c[0]], PASSAGE)], scanner.notices(places, own))]
                spans = [{"label": scanner.labels[w], "start": a, "end": b, "cover": min(1.0, n / scanner.sizes[w])}
                         for a, b, n, w in sorted(found)]
                closest = max([s["cover"] for s in said + spans] + [min(1.0, c[3] / scanner.sizes[c[0]]) for c in chains],
                              default=0.0)
                rows.append((len(own), said, spans, closest))
        return list(zip(*rows)) or [[]] * 4

    return with_results(docs, [text], f"n_words long, phrases array<{SPAN}>, spans array<{SPAN}>, closest double",
                        compute, keep)


def digest(found: DataFrame) -> DataFrame:
    """Counts, first and last place and label lists in place of phrases and spans."""
    def names(*spans: str):
        every = F.concat(*[F.transform(s, lambda x: x["label"]) for s in spans])
        return F.array_join(F.array_sort(F.array_distinct(every)), ",")

    starts = F.transform("phrases", lambda x: x["start"])
    return (found.withColumn("n_base", F.size("phrases").cast("bigint"))
            .withColumn("first_word", F.array_min(starts)).withColumn("last_word", F.array_max(starts))
            .withColumn("base_labels", names("phrases")).withColumn("labels", names("phrases", "spans"))
            .withColumnRenamed("closest", "score").drop("phrases", "spans"))
