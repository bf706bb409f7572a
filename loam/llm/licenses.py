"""License scans: template markup compiled into token automata that run over whole texts.

A template is a license's wording with two kinds of regions.  ``<<beginOptional>> .. <<endOptional>>`` may be left out, and may
hold other regions.  ``<<var;name="..";match="..">>`` may be replaced: by so many words, ``.{0,20}``, or by one of several
wordings, ``(the author|the authors)``.  All other words are mandatory: a place in a text is accepted only where they stand
exactly, in order, with nothing between them but what the regions allow.  Case of A-Z and punctuation do not count.

All templates become one automaton without empty steps (Glushkov's construction: a state for each word of a template, which
follow one another).  It is run in lockstep over all places of a batch where some template may begin: a step moves every
(place, state) pair over its next word, with one table look-up each, and pairs that cannot go on drop out.  A template begins and
ends with wording, never with free words, and free words are counted, so a place is followed no further than its template is
long.  Words are identified by a 64-bit hash.

The score is 1 where a template is accepted, else (k - 1) / (m - 1) for the run that got furthest, through k of its template's m
mandatory words: a single word counts nothing.

Defined results.  Empty table: no rows.  Null and empty texts and texts without words: no matches, score 0.  Rows are scanned
each by its own text, so repeated rows and ties need no rule; of several ends for the same template and place the furthest is
given.  Very long texts are read whole, in bounded slices of rows.  Ids may have any type; other columns are not looked at,
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm import vectext as V
from loam.llm.common import freed, id_type, small_batches

#: Phrases that name a license.
PHRASES = {
    "gpl": "gnu general public license",
    "apache": "apache license",
    "cc-by": "cc by",
    "mit": "mit license",
}

_GRANT = '<<beginOptional>><<var;name="what";match="(this work|this program|this software|this file|this text|this document|this project|the code|the source code)">> <<var;name="be";match="(is|are)">><<endOptional>> <<var;name="grant";match="(licensed|released|distributed|published|available)">> under <<beginOptional>>the terms of<<endOptional>>'
_LATER = '<<beginOptional>>or <<beginOptional>>at your option<<endOptional>> any later version<<endOptional>>'
_WARRANTY = """is provided <<var;name="by";match="(as is|by the copyright holders and contributors as is|by the author and contributors as is|by the regents and contributors as is)">> and any express or implied warranties
including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall
<<var;name="holder";match=".{1,12}">> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of
substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or
tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
<<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
<<beginOptional>>2<<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
in the documentation and or other materials provided with the distribution """
_DISCLAIMER = '<<beginOptional>>this<<endOptional>> software '

#: Wordings of public licenses and of the notices that refer to them.
TEMPLATES = {
    "gpl-2.0": f'{_GRANT} the gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 2 <<beginOptional>>of the license<<endOptional>> {_LATER}',
    "gpl-3.0": f'{_GRANT} the gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3 <<beginOptional>>of the license<<endOptional>> {_LATER}',
    "gpl-header": f"""<<var;name="program";match="(this program|this software|this file|this library)">> is free software you can redistribute it and or modify it under the terms of the gnu
        <<beginOptional>><<var;name="kind";match="(lesser|affero)">><<endOptional>> general public license as published by the free software foundation either version <<var;name="version";match="(2|2 1|3)">> of the license {_LATER}""",
    "lgpl": f'{_GRANT} the gnu lesser general public license <<beginOptional>>version <<var;name="version";match="(2 1|3|3 0)">><<endOptional>>',
    "agpl-3.0": f'{_GRANT} the gnu affero general public license version 3',
    "apache-2.0": f'{_GRANT} the apache license version 2 0 <<beginOptional>>the license you may not use this file except in compliance with the license<<endOptional>>',
    "mpl-2.0": '<<beginOptional>>this source code form is subject to the terms of the<<endOptional>> mozilla public license v 2 0 <<beginOptional>>if a copy of the mpl was not distributed with this file you can obtain one at <<var;name="url";match=".{1,8}">> mpl 2 0<<endOptional>>',
    "mit": f'{_GRANT} the mit license',
    "mit-text": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software
        without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons
        to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice
        <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software the software is provided as is without
        warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall
        <<var;name="holder";match=".{1,12}">> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection
        with the software or the use or other dealings in the software""",
    "isc-text": """permission to use copy modify <<var;name="and";match="(and|and or)">> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright
        notice and this permission notice appear in all copies""",
    "bsd-2-clause": _BSD + _DISCLAIMER + _WARRANTY,
    "bsd-3-clause": _BSD + """<<beginOptional>>3<<endOptional>> neither the name of <<var;name="organisation";match=".{1,12}">> nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission """ + _DISCLAIMER + _WARRANTY,
    "zlib-text": """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
        permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely""",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc0-1.0": '<<var;name="name";match="(cc0|cc zero|creative commons zero)">> <<var;name="version";match="(1|v1)">> 0 <<beginOptional>>universal<<endOptional>>',
    **{
        f"cc-{kind}-{version}": f'{_GRANT} <<beginOptional>>a<<endOptional>> <<var;name="name";match="(cc {kind.replace("-", " ")}|creative commons {long})">> <<beginOptional>>license<<endOptional>> <<beginOptional>>version<<endOptional>> {version.replace(".", " ")}'
        for kind, long in (("by", "attribution"), ("by-sa", "attribution sharealike"), ("by-nc", "attribution noncommercial"), ("by-nd", "attribution noderivatives"), ("by-nc-sa", "attribution noncommercial sharealike"), ("by-nc-nd", "attribution noncommercial noderivatives"))
        for version in ("2.0", "3.0", "4.0")
    },
    "all-rights-reserved": "all rights reserved",
}

_SKIP = np.zeros(256, bool)
_SKIP[:48] = _SKIP[58:97] = _SKIP[123:128] = True  # of lower-cased bytes: all ASCII but digits and letters
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARK = re.compile(r"<<(beginOptional|endOptional|var)((?:;[^>]*)?)>>")
_ANY = ""  # a free word


def words_of(text: str) -> list[str]:
    return _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def parse(markup: str) -> list:
    """A template's parts: words (str), ("optional", parts), ("free", least, most), ("one", wordings)."""
    stack: list[list] = [[]]
    at = 0
    for m in _MARK.finditer(markup):
        stack[-1] += words_of(markup[at : m.start()])
        at = m.end()
        if m[1] == "beginOptional":
            stack.append([])
        elif m[1] == "endOptional":
            if len(stack) == 1:
                raise ValueError("endOptional without beginOptional")
            parts = stack.pop()
            stack[-1].append(("optional", parts))
        else:
            match = dict(re.findall(r';(\w+)="([^"]*)"', m[2])).get("match", "")
            if free := re.fullmatch(r"\.\{(\d+),(\d+)\}", match):
                stack[-1].append(("free", int(free[1]), int(free[2])))
            elif match.startswith("(") and match.endswith(")"):
                stack[-1].append(("one", [words_of(x) for x in match[1:-1].split("|")]))
            else:
                raise ValueError(f"a match is .{{n,m}} words or (wording|wording): {match!r}")
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0] + words_of(markup[at:])


@dataclass
class Automaton:
    """States are the words of all templates: what each reads, its template, whether it may be first or last, the mandatory
    words read up to it, and the states that may follow."""

    names: list[str]
    reads: list[str] = field(default_factory=list)
    of: list[int] = field(default_factory=list)
    done: list[int] = field(default_factory=list)
    first: set[int] = field(default_factory=set)
    last: set[int] = field(default_factory=set)
    follow: list[set[int]] = field(default_factory=list)
    mandatory: list[int] = field(default_factory=list)


def compile_templates(templates: Mapping[str, str]) -> Automaton:
    a = Automaton(list(templates))

    def state(reads: str, t: int, done: int) -> int:
        for xs, x in ((a.reads, reads), (a.of, t), (a.done, done), (a.follow, set())):
            xs.append(x)
        return len(a.reads) - 1

    for t, markup in enumerate(templates.values()):
        count = 0

        def sequence(parts: list, top: bool) -> tuple[bool, set[int], set[int]]:
            """Whether it may be empty, and its first and last states."""
            nonlocal count
            empty, first, last = True, set(), set()
            for part in parts:
                if isinstance(part, str):
                    count += top
                    s = state(part, t, count)  # noqa: B023
                    e, f, l = False, {s}, {s}
                elif part[0] == "optional":
                    e, f, l = sequence(part[1], False)
                    e = True
                elif part[0] == "one":
                    got = [sequence(x, False) for x in part[1]]
                    e, f, l = any(x[0] for x in got), set().union(*(x[1] for x in got)), set().union(*(x[2] for x in got))
                else:
                    chain = [state(_ANY, t, count) for _ in range(part[2])]  # noqa: B023
                    for x, y in zip(chain, chain[1:], strict=False):
                        a.follow[x].add(y)
                    e, f, l = part[1] == 0, set(chain[:1]), set(chain[max(part[1] - 1, 0) :])
                for s in last:
                    a.follow[s] |= f
                first |= f if empty else set()
                last = l | last if e else l
                empty &= e
            return empty, first, last

        empty, first, last = sequence(parse(markup), True)
        if empty or count == 0 or any(a.reads[s] == _ANY for s in first | last):
            raise ValueError(f"template {a.names[t]!r} must have mandatory words, and must not begin or end with free words")
        a.first |= first
        a.last |= last
        a.mandatory.append(count)
    return a


class Scanner:
    """The automaton's tables, as arrays that a step looks up for many pairs at once."""

    def __init__(self, a: Automaton):
        vocabulary = sorted({w for w in a.reads if w != _ANY})
        code = {w: i + 1 for i, w in enumerate(vocabulary)}
        hashes = _hashes(vocabulary)
        by = np.argsort(hashes)
        self.hashes, self.codes = hashes[by], by + 1
        self.k = len(vocabulary) + 1
        n = len(a.reads)
        starts = [(n * self.k + code[a.reads[t]], t) for t in a.first]
        moves = [(s * self.k + code[a.reads[t]], t) for s in range(n) for t in a.follow[s] if a.reads[t] != _ANY]
        self.base = n  # the state before any word
        self.word_key, self.word_at, self.word_to = _table(moves + starts)
        self.free_key, self.free_at, self.free_to = _table([(s, t) for s in range(n) for t in a.follow[s] if a.reads[t] == _ANY])
        self.begins = np.zeros(self.k, bool)
        self.begins[[k % self.k for k, _ in starts]] = True
        self.last = np.zeros(n, bool)
        self.last[list(a.last)] = True
        self.of = np.array(a.of)
        m = np.array(a.mandatory)[self.of]
        self.part = np.where(m > 1, (np.array(a.done) - 1) / np.maximum(m - 1, 1), 0.0).clip(0)

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.codes[at], 0)

    def run(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Template, start and end of each match, by start and template, and the score of each document."""
        code = self.encode(words)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        score = np.zeros(len(first) - 1)
        start = np.flatnonzero(self.begins[code])
        state = np.full(len(start), self.base)
        n, found, step = self.base + 1, [], 0
        while len(start):
            w = code[start + step]
            i, to = _moves(self.word_key, self.word_at, self.word_to, state * self.k + w)
            j, free = _moves(self.free_key, self.free_at, self.free_to, state)
            pairs = np.unique(np.concatenate([start[i] * n + to, start[j] * n + free]))
            start, state = pairs // n, pairs % n
            np.maximum.at(score, doc[start], self.part[state])
            step += 1
            hit = self.last[state]
            found.append(np.stack([start[hit], self.of[state[hit]], np.full(int(hit.sum()), step)]))
            on = start + step < first[doc[start] + 1]
            start, state = start[on], state[on]
        if not found:
            return (np.zeros(0, np.int64),) * 3 + (score,)
        s, t, length = np.concatenate(found, 1)
        by = np.lexsort((length, t, s))
        s, t, length = s[by], t[by], length[by]
        far = np.ones(len(s), bool)  # the furthest end is the last of its start and template
        far[:-1] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
        s, t, length = s[far], t[far], length[far]
        score[doc[s]] = 1.0
        return t, s, s + length, score


def _hashes(words: list[str]) -> np.ndarray:
    return V.words(*V.buffer(pa.array(words, pa.string())), lambda b: ~_SKIP[b]).hash


def _table(pairs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, where each one's values begin, and the values."""
    pairs = sorted(set(pairs))
    keys, at = np.unique(np.array([k for k, _ in pairs], np.int64), return_index=True)
    return keys, np.append(at, len(pairs)), np.array([t for _, t in pairs], np.int64)


def _moves(keys: np.ndarray, at: np.ndarray, to: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each asked key its values: index into asked, and value."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    hit = np.flatnonzero(keys[k] == asked)
    k = k[hit]
    n = at[k + 1] - at[k]
    return np.repeat(hit, n), to[np.arange(n.sum()) + np.repeat(at[k] - (np.cumsum(n) - n), n)]


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, matches (template, start, end in words; by start and template's place) and score of each document."""
    small_batches(docs.sparkSession)
    automaton = compile_templates(templates)
    sent = docs.sparkSession.sparkContext.broadcast((Scanner(automaton), automaton.names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, names = sent.value
        for b in V.slices(batches):
            buf, offs = V.buffer(b.column("text"))
            w = V.words(V.lower(buf), offs, lambda part: ~_SKIP[part])
            t, s, e, score = scanner.run(w.hash, w.first)
            at = np.searchsorted(s, w.first)
            base = np.repeat(w.first[:-1], np.diff(at))
            spans = pa.StructArray.from_arrays([pa.array(names, pa.string()).take(pa.array(t)), pa.array(s - base), pa.array(e - base)], ["template", "start", "end"])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(w.counts), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), spans), pa.array(score)], ["doc_id", "n_words", "matches", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(freed(run), f"doc_id {id_type(docs, id_col)}, n_words long, matches array<struct<template:string,start:long,end:long>>, score double")
