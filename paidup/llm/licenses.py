"""License scan by template markup: optional and replaceable regions compiled into token automata.

A template is plain wording with two marks. ``<<optional>> ... <<end>>`` may be left out (and may be
nested); ``<<var:N>>`` stands for up to N words of any kind. Everything else must occur word for word,
in order; case, punctuation and line breaks do not matter. An automaton is started wherever the first
two words that its template allows are found, and the longest acceptance from there is the place.

Null and empty texts have no words and no labels, and score 0. Rows repeat as given.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paidup.llm.session import prepared
from paidup.llm.text import Words, blocks

# Phrases and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
    " documentation files <<optional>>the software<<end>> to deal in the software without restriction including"
    " without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of"
    " the software and to permit persons to whom the software is furnished to do so subject to the following"
    " conditions the above copyright notice and this permission notice <<optional>>including the next"
    " paragraph<<end>> shall be included in all copies or substantial portions of the software the software is"
    " provided as is without warranty of any kind express or implied including but not limited to the warranties of"
    " merchantability fitness for a particular purpose and noninfringement in no event shall <<var:12>> be liable"
    " for any claim damages or other liability whether in an action of contract tort or otherwise arising from out"
    " of or in connection with the software or the use or other dealings in the software"
)
_BSD_CONDITIONS = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that"
    " the following conditions are met <<var:1>> redistributions of source code must retain the above copyright"
    " notice this list of conditions and the following disclaimer <<var:1>> redistributions in binary form must"
    " reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"
    " and or other materials provided with the distribution"
)
_BSD_ENDORSEMENT = (
    " <<var:1>> neither the name of <<var:12>> nor the names of <<var:2>> contributors may be used to endorse or"
    " promote products derived from this software without specific prior written permission"
)
_BSD_DISCLAIMER = (
    " this software is provided by <<var:12>> as is and any express or implied warranties including but not limited to"
    " the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall"
    " <<var:12>> be liable for any direct indirect incidental special exemplary or consequential damages including but"
    " not limited to procurement of substitute goods or services loss of use data or profits or business interruption"
    " however caused and on any theory of liability whether in contract strict liability or tort including negligence"
    " or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)

#: Label and template of licenses: the whole mandatory wording, from the grant to the end of the disclaimer.
TEXTS = (
    ("mit", _MIT),
    (
        "x11",
        _MIT + " except as contained in this notice the name of <<var:12>> shall not be used in advertising or otherwise"
        " to promote the sale use or other dealings in this software without prior written authorization",
    ),
    ("bsd-2-clause", _BSD_CONDITIONS + _BSD_DISCLAIMER),
    ("bsd-3-clause", _BSD_CONDITIONS + _BSD_ENDORSEMENT + _BSD_DISCLAIMER),
)
#: Label and template of notices, which name a license or reserve rights, as they stand in files and pages.
NOTICES = (
    (
        "apache-2.0",
        "licensed under <<optional>>the terms of<<end>> the apache license <<optional>>version<<end>> 2.0"
        "<<optional>> the license<<end>>",
    ),
    (
        "gpl-3.0",
        "<<optional>>this <<var:3>> is<<end>> licensed under <<optional>>the terms of<<end>> the gnu general public"
        " license <<optional>>as published by the free software foundation<<end>> <<optional>>either<<end>> version 3"
        " <<optional>>of the license<<end>> <<optional>>or <<optional>>at your option<<end>> any later version<<end>>",
    ),
    (
        "gpl-2.0",
        "<<optional>>this <<var:3>> is<<end>> licensed under <<optional>>the terms of<<end>> the gnu general public"
        " license <<optional>>as published by the free software foundation<<end>> <<optional>>either<<end>> version 2"
        " <<optional>>of the license<<end>> <<optional>>or <<optional>>at your option<<end>> any later version<<end>>",
    ),
    (
        "gpl-3.0-or-later",
        "this <<var:3>> is free software you can redistribute it and or modify it under the terms of the gnu general"
        " public license as published by the free software foundation either version 3 of the license or"
        " <<optional>>at your option<<end>> any later version",
    ),
    ("cc-by-nc-4.0", "licensed under <<optional>>a<<end>> cc by nc 4.0 <<optional>>international license<<end>>"),
    ("cc-by-sa-4.0", "licensed under <<optional>>a<<end>> cc by sa 4.0 <<optional>>international license<<end>>"),
    ("cc-by-4.0", "licensed under <<optional>>a<<end>> cc by 4.0 <<optional>>international license<<end>>"),
    ("mit", "licensed under the mit license"),
    ("all-rights-reserved", "copyright <<optional>>c<<end>> <<var:8>> all rights reserved"),
)
#: Label, template, and whether it is the whole text of a license.
TEMPLATES = (*((*t, True) for t in TEXTS), *((*t, False) for t in NOTICES))

_MARK = re.compile(r"<<(optional|end|var:\d+)>>|[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass
class Automaton:
    """States with word edges, any-word edges and free edges; state 0 starts, ``final`` accepts."""

    label: str
    words: list[dict[str, int]] = field(default_factory=lambda: [{}])
    anything: list[int] = field(default_factory=lambda: [-1])
    free: list[list[int]] = field(default_factory=lambda: [[]])
    final: int = 0
    whole: bool = False

    def state(self) -> int:
        self.words.append({})
        self.anything.append(-1)
        self.free.append([])
        return len(self.words) - 1

    def reach(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def step(self, states: set[int], word: str) -> set[int]:
        after = {self.words[s][word] for s in states if word in self.words[s]}
        return self.reach(after | {self.anything[s] for s in states if self.anything[s] >= 0})

    def openings(self) -> set[tuple[str, str | None]]:
        """The first two words of what it accepts; None where the second may be any word or none."""
        out = set()
        for s in self.reach({0}):
            if self.anything[s] >= 0:
                raise ValueError(f"{self.label}: a template begins with a word")
            for word, to in self.words[s].items():
                after = self.reach({to})
                if self.final in after or any(self.anything[x] >= 0 for x in after):
                    out.add((word, None))
                out |= {(word, second) for x in after for second in self.words[x]}
        return out


def compiled(label: str, template: str, whole: bool = False) -> Automaton:
    a = Automaton(label, whole=whole)
    now, opened = 0, []
    for mark in _MARK.finditer(template.lower()):
        kind = mark[1]
        if kind is None:
            after = a.state()
            a.words[now][mark[0]] = after
            now = after
        elif kind == "optional":
            inner = a.state()
            a.free[now].append(inner)
            opened.append(now)
            now = inner
        elif kind == "end":
            after = a.state()
            a.free[now].append(after)
            a.free[opened.pop()].append(after)
            now = after
        else:
            chain = [now]
            for _ in range(int(kind[4:])):
                after = a.state()
                a.anything[chain[-1]] = after
                chain.append(after)
            end = a.state()
            for s in chain:
                a.free[s].append(end)
            now = end
        # a word edge needs a state of its own, so that a region's exit never meets another's entry
        if kind in ("end", "optional"):
            fresh = a.state()
            a.free[now].append(fresh)
            now = fresh
    if opened:
        raise ValueError(f"{label}: an optional region is not closed")
    a.final = now
    return a


class Scanner:
    def __init__(self, templates=TEMPLATES):
        self.automata = [compiled(*t) for t in templates]
        pairs = sorted({(w, s or "", k) for k, a in enumerate(self.automata) for w, s in a.openings()})
        names = sorted({x for w, s, _ in pairs for x in (w, s) if x} | {x for p in BASE_PHRASES for x in p.split()})
        words = Words(pa.array([" ".join(names)]))
        order = np.argsort(words.hashes)
        self.hashes, self.number = words.hashes[order], order + 1
        number = {x: i + 1 for i, x in enumerate(names)}
        self.width = len(names) + 1
        self.openings: dict[int, list[int]] = {}
        for w, s, k in pairs:
            self.openings.setdefault(number[w] * self.width + (number[s] if s else 0), []).append(k)
        self.keys = np.array(sorted(self.openings), np.int64)
        self.base = [(label, [number[x] for x in phrase.split()]) for phrase, label in BASE_PHRASES.items()]

    def symbols(self, words: Words) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, words.hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words.hashes, self.number[at], 0)

    def base_places(self, words: Words, symbols: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """Per base phrase: its label, the start words of its places, and their texts."""
        for label, phrase in self.base:
            n = len(symbols) - len(phrase) + 1
            if n <= 0:
                continue
            here = np.ones(n, bool)
            for k, x in enumerate(phrase):
                here &= symbols[k : k + n] == x
            start = np.flatnonzero(here)
            text = words.text_of(start)
            whole = start + len(phrase) <= words.bounds[text + 1]
            yield label, start[whole], text[whole]

    def template_places(self, words: Words, symbols: np.ndarray) -> Iterator[tuple[str, int, int, int, bool]]:
        """(label, text, start word, end word, whole) of every accepted place, the longest from each start.

        The text of a license may begin with that of another: of whole texts with one start the longest counts.
        """
        following = np.concatenate((symbols[1:], [0])) if len(symbols) else symbols
        first = np.flatnonzero(symbols)
        for key, tried in ((symbols[first] * self.width + following[first], True), (symbols[first] * self.width, False)):
            known = np.isin(key, self.keys)
            if tried:
                known &= following[first] > 0
            for start, k in zip(first[known].tolist(), key[known].tolist()):
                text = int(words.text_of(np.array([start]))[0])
                limit = int(words.bounds[text + 1])
                found = []
                for a in (self.automata[i] for i in self.openings[k]):
                    states, at, end = a.reach({0}), start, 0
                    while states:
                        if a.final in states:
                            end = at
                        if at == limit:
                            break
                        word = words.data[words.starts[at] : words.ends[at]].tobytes().decode()
                        states = a.step(states, word)
                        at += 1
                    if end:
                        found.append((a, end))
                longest = max((end for a, end in found if a.whole), default=0)
                for a, end in found:
                    if not a.whole or end == longest:
                        yield a.label, text, start, end, a.whole


def _scan(scanner: Scanner):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "text"):
                words = Words(batch.column("text"))
                symbols = scanner.symbols(words)
                n = len(batch)
                count = np.zeros(n, np.int64)
                low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                labels: list[set] = [set() for _ in range(n)]
                for label, start, text in scanner.base_places(words, symbols):
                    np.add.at(count, text, 1)
                    np.minimum.at(low, text, start - words.bounds[text])
                    np.maximum.at(high, text, start - words.bounds[text])
                    for t in np.unique(text).tolist():
                        labels[t].add(label)
                places: list[set] = [set() for _ in range(n)]
                for label, text, start, end, all_ in scanner.template_places(words, symbols):
                    begin = int(words.bounds[text])
                    places[text].add((start - begin, end - begin, label, all_))
                none = count == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").cast(pa.int64()),
                        pa.array(words.counts, pa.int64()),
                        pa.array(count, pa.int64()),
                        pa.array(low, pa.int64(), mask=none),
                        pa.array(high, pa.int64(), mask=none),
                        pa.array([sorted(x) for x in labels], pa.list_(pa.string())),
                        pa.array(
                            [[{"label": c, "start": a, "end": b, "whole": d} for a, b, c, d in sorted(x)] for x in places],
                            pa.list_(
                                pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("whole", pa.bool_())])
                            ),
                        ),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base", "places"],
                )

    return run


def scan_licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Per document: words, places of the base phrases, and the places that a template accepts."""
    prepared(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _scan(Scanner(templates)),
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>,"
        " places array<struct<label:string,start:long,end:long,whole:boolean>>",
    )


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    """The score is 1 where the whole text of a license is accepted, 0.75 for a notice, 0.5 for a base phrase alone, else 0."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    labels = F.array_sort(F.array_union("base", F.transform("places", lambda x: x["label"])))
    whole = F.exists("places", lambda x: x["whole"])
    score = F.when(whole, 1.0).when(F.size("places") > 0, 0.75).when(F.col("n_base") > 0, 0.5).otherwise(0.0)
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.alias("score"),
        "places",
    )
