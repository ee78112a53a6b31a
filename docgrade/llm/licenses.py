"""License scans by template markup: optional and replaceable regions compiled into token automata.

A template is plain wording with two kinds of region, in the markup of license lists:
``<<optional>> ... <<end>>`` may be absent, ``<<var:n>>`` stands for one to n words of any wording.
All else is mandatory and must match word for word. Each template becomes a small automaton over
words; a text holds the license where the automaton reaches its end.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .common import map_rows, pick

#: Fixed values of the scan: phrases, and the labels that they stand for.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Public license texts and notices as words, with their optional and replaceable regions.
MIT = """
permission is hereby granted free of charge to any person obtaining a copy of this software and <<optional>> its <<end>> associated
documentation <<optional>> files <<end>> the <<var:2>> to deal in the <<var:2>> without restriction including without limitation the
rights to use copy modify merge publish distribute sublicense and or sell copies of the <<var:2>> and to permit persons to whom the
<<var:2>> is furnished to do so subject to the following conditions the above copyright notice and this permission notice
<<optional>> including the next paragraph <<end>> shall be included in all copies or substantial portions of the <<var:2>>
"""
MIT_WARRANTY = """
the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
merchantability fitness for a particular purpose and noninfringement in no event shall <<var:8>> be liable for any claim damages or
other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use
or other dealings in the software
"""
BSD = """
redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions
are met <<optional>> 1 <<end>> redistributions of source code must retain the above copyright notice this list of conditions and the
following disclaimer <<optional>> 2 <<end>> redistributions in binary form must reproduce the above copyright notice this list of
conditions and the following disclaimer in the documentation and or other materials provided with the distribution
"""
BSD_NAMES = "neither the name of <<var:12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
ISC = """
permission to use copy modify and <<optional>> or <<end>> distribute this software for any purpose with or without fee is hereby
granted provided that the above copyright notice and this permission notice appear in all copies
"""
ZLIB = """
this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial
applications and to alter it and redistribute it freely subject to the following restrictions
"""
APACHE_NOTICE = """
licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may
obtain a copy of the license at <<var:1>> www apache org licenses license 2 0
"""
GPL_NOTICE = """
is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free
software foundation either version {} of the license or <<optional>> at your option <<end>> any later version
"""
MPL_NOTICE = """
this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this
file you can obtain one at
"""
UNLICENSE = """
this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or
distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any
means
"""
BOOST = """
permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to
prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the
following
"""
TEMPLATES = (
    ("mit", MIT),
    ("mit", MIT_WARRANTY),
    ("mit", "<<optional>> this <<end>> <<var:3>> is <<optional>> free software <<end>> licensed under the <<optional>> terms of the <<end>> mit license"),
    ("mit", "spdx license identifier mit"),
    ("apache-2", APACHE_NOTICE),
    ("apache-2", "licensed under the apache license <<optional>> version <<end>> 2 0"),
    ("apache-2", "spdx license identifier apache 2 0"),
    ("gpl-2", GPL_NOTICE.format("2")),
    ("gpl-3", GPL_NOTICE.format("3")),
    ("gpl-2", "licensed under the <<optional>> terms of the <<end>> gnu general public license <<optional>> as published by the free software foundation either <<end>> version 2"),
    ("gpl-3", "licensed under the <<optional>> terms of the <<end>> gnu general public license <<optional>> as published by the free software foundation either <<end>> version 3"),
    ("gpl-2", "spdx license identifier gpl 2 0 <<optional>> only <<end>> <<optional>> or later <<end>>"),
    ("gpl-3", "spdx license identifier gpl 3 0 <<optional>> only <<end>> <<optional>> or later <<end>>"),
    ("bsd-2", BSD),
    ("bsd-3", BSD_NAMES),
    ("isc", ISC),
    ("zlib", ZLIB),
    ("mpl-2", MPL_NOTICE),
    ("unlicense", UNLICENSE),
    ("boost", BOOST),
    ("cc-by-nc", "licensed under <<optional>> a <<end>> <<optional>> the <<end>> cc by nc <<optional>> 4 0 <<end>>"),
    ("cc-by-nc", "licensed under <<optional>> a <<end>> <<optional>> the <<end>> creative commons attribution noncommercial <<optional>> 4 0 international <<end>> license"),
)

#: Every byte that is no word's part becomes a blank; the words are what is left between blanks.
BLANKS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters (lower-cased), digits and non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(BLANKS).split()


@dataclass
class Automaton:
    """States are numbers; ``step`` by word, ``free`` by any word, ``skip`` without one."""

    label: str
    step: list[dict[bytes, int]] = field(default_factory=list)
    free: list[int | None] = field(default_factory=list)
    skip: list[list[int]] = field(default_factory=list)
    end: int = 0

    def state(self) -> int:
        self.step.append({})
        self.free.append(None)
        self.skip.append([])
        return len(self.step) - 1

    def closed(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def starts(self) -> set[bytes]:
        return {w for s in self.closed({0}) for w in self.step[s]}

    def match(self, ws: list[bytes], at: int) -> int | None:
        """The end of the shortest match that starts with word ``at``."""
        now = self.closed({0})
        for i in range(at, len(ws)):
            w = ws[i]
            after = {s.get(w) for s in (self.step[n] for n in now)} | {self.free[n] for n in now}
            after.discard(None)
            if not after:
                return None
            now = self.closed(after)
            if self.end in now:
                return i + 1
        return None


def compile_template(label: str, markup: str) -> Automaton:
    """A leading replaceable region may be left out, as may one behind optional regions alone: every place has some words before it."""
    a = Automaton(label)
    at, opened = a.state(), []
    parts = re.findall(r"<<[^>]*>>|[^\s<]+", markup)
    mandatory = False
    for p in parts:
        if p == "<<optional>>":
            opened.append(at)
        elif p == "<<end>>":
            a.skip[opened.pop()].append(at)
        elif m := re.fullmatch(r"<<var:(\d+)>>", p):
            if at == 0:
                continue
            leading, ends = not mandatory and not opened, []
            for _ in range(int(m[1])):
                after = a.state()
                a.free[at] = after
                at = after
                ends.append(after)
            for e in ends[:-1]:
                a.skip[e].append(at)
            if leading:
                a.skip[0].append(at)
        else:
            mandatory = mandatory or not opened
            after = a.state()
            a.step[at][p.encode()] = after
            at = after
    if opened:
        raise ValueError(f"unclosed region in {markup!r}")
    a.end = at
    return a


class Scanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        self.phrases = [(tuple(p.encode() for p in phrase.split()), label) for phrase, label in phrases]
        self.automata = [compile_template(label, markup) for label, markup in templates]
        self.by_start: dict[bytes, list[Automaton]] = {}
        for a in self.automata:
            for w in a.starts():
                self.by_start.setdefault(w, []).append(a)
        self.first: dict[bytes, list] = {}
        for phrase, label in self.phrases:
            self.first.setdefault(phrase[0], []).append((phrase, label))
        self.keys = set(self.by_start) | set(self.first)

    def scan(self, text: str | None) -> dict:
        ws = words(text)
        base, labels, places = set(), set(), []
        hits = self.keys.intersection(ws)
        if hits:
            for i in [i for i, w in enumerate(ws) if w in hits]:
                for phrase, label in self.first.get(ws[i], ()):
                    if tuple(ws[i : i + len(phrase)]) == phrase:
                        places.append(i)
                        base.add(label)
                for a in self.by_start.get(ws[i], ()):
                    if a.label not in labels and a.match(ws, i) is not None:
                        labels.add(a.label)
        labels |= base
        return {
            "n_words": len(ws),
            "n_base": len(places),
            "first_word": min(places, default=None),
            "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(labels)),
            # wording is accepted exactly or not at all, so there is no degree between
            "score": 1.0 if labels else 0.0,
        }


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
)


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """License findings of every row's whole text, in one pass without a shuffle.

    Null or word-free texts have no words, no places and no labels. Repeated rows repeat, an empty
    table gives none, a long text is scanned whole. score is 1 where a phrase or a template is
    accepted, else 0.
    """
    made: list[Scanner] = []

    def step(cols: dict[str, list]) -> dict[str, list]:
        if not made:
            made.append(Scanner(phrases, templates))
        got = [made[0].scan(t) for t in cols["text"]]
        return {"doc_id": cols["doc_id"]} | {k: [g[k] for g in got] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}

    return map_rows(pick(docs, "doc_id", "text"), step, SCHEMA)
