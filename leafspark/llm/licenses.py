"""License scan by template-markup matching.

A template is license wording with two kinds of markup: ``<<beginOptional>> ... <<endOptional>>`` around
words that may be left out (regions may nest), and ``<<var;max=N>>`` for up to N words of any kind. Templates are compiled into
word automata. A text carries a template's label if the automaton accepts some run of its words, that is,
if all mandatory words stand there exactly and in order. Beside the templates, fixed phrases are counted
and label a text as well.

Texts are cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. The work is row by
row, without a shuffle; an automaton only runs where the template's longest mandatory run of words occurs.

Edge cases: null and empty texts have no words, no labels and score 0. Repeated rows are scanned one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import alnum_words, with_result

# Phrases and labels of the contract.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Public license wording, with markup.
TEMPLATES = {
    "mit-full": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice
        <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or
        substantial portions of the Software.""",
    "mit-notice": """<<head>>Released under the <<var;max=2>> MIT License""",
    "isc": """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for
        any purpose with or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are
        permitted provided that the following conditions are met: <<var;max=1>> Redistributions of source code
        must retain the above copyright notice, this list of conditions and the following disclaimer.
        <<var;max=1>> Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
    "bsd-3-clause": """Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. <<var;max=1>> Neither the name of <<var;max=12>> nor the names of its contributors may be
        used to endorse or promote products derived from this software without specific prior written
        permission.""",
    "apache-2-header": """Licensed under the Apache License, Version 2.0
        <<beginOptional>>(the "License"); you may not use this file except in compliance with the License. You
        may obtain a copy of the License at <<var;max=8>><<endOptional>>""",
    "gpl": """This <<var;max=3>> is <<beginOptional>>free software: you can redistribute it and/or modify it under
        the terms of<<endOptional>> <<beginOptional>>licensed under<<endOptional>> the GNU General Public License
        <<beginOptional>>as published by the Free Software Foundation, either<<endOptional>>
        <<beginOptional>>,<<endOptional>> version 3""",
    "lgpl": """GNU Lesser General Public License <<beginOptional>>as published by the Free Software Foundation,
        either<<endOptional>> version <<var;max=2>>""",
    "cc-by-nc-notice": """Licensed under <<beginOptional>>a Creative Commons<<endOptional>> CC BY-NC
        <<beginOptional>>4.0<<endOptional>>""",
    "cc0": """To the extent possible under law, <<var;max=12>> has waived all copyright and related or neighboring
        rights""",
    "unlicense": """This is free and unencumbered software released into the public domain.""",
}

FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.ArrayType(T.StringType())),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField(
            "matches",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("label", T.StringType()),
                        T.StructField("start", T.LongType()),
                        T.StructField("end", T.LongType()),
                    ]
                )
            ),
        ),
        T.StructField("score", T.DoubleType()),
    ]
)

_MARK = re.compile(r"<<(.*?)>>")


def parse(template: str) -> list[tuple]:
    """The template as items: ("word", w), ("var", max) and ("opt", items), whose items may hold further ones."""
    out: list[tuple] = []
    open_: list[list[tuple]] = [out]
    for i, piece in enumerate(_MARK.split(template)):
        if i % 2 == 0:
            open_[-1] += [("word", w) for w in alnum_words(piece.encode())]
        elif piece == "beginOptional":
            open_.append([])
        elif piece == "endOptional":
            if len(open_) == 1:
                raise ValueError("an optional region ends that has not begun")
            if inner := open_.pop():
                open_[-1].append(("opt", inner))
        elif m := re.fullmatch(r"var;max=(\d+)", piece):
            open_[-1].append(("var", int(m[1])))
        elif piece != "head":
            raise ValueError(f"unknown markup <<{piece}>>")
    if len(open_) > 1:
        raise ValueError("an optional region does not end")
    if not out or out[0][0] != "word":
        raise ValueError("a template begins with a mandatory word")
    return out


class Automaton:
    """A nondeterministic word automaton of one template."""

    def __init__(self, label: str, template: str) -> None:
        self.label, items = label, parse(template)
        self.words: list[dict[bytes, int]] = [{}]  # by state: word to next state
        self.any: list[int] = [-1]  # next state on any word
        self.free: list[list[int]] = [[]]  # next states on no word
        self.end = self._chain(items, 0)
        runs, run = [], []
        for kind, value in [*items, ("stop", None)]:
            if kind == "word":
                run.append(value)
            else:
                runs.append(run)
                run = []
        self.head = b" " + b" ".join(runs[0]) + b" "
        self.anchor = b" " + b" ".join(max(runs, key=len)) + b" "

    def _state(self) -> int:
        self.words.append({})
        self.any.append(-1)
        self.free.append([])
        return len(self.any) - 1

    def _chain(self, items: list[tuple], at: int) -> int:
        for kind, value in items:
            if kind == "word":
                self.words[at][value] = nxt = self._state()
                at = nxt
            elif kind == "var":
                stops = [at]
                for _ in range(value):
                    self.any[at] = at = self._state()
                    stops.append(at)
                end = self._state()
                for s in stops:
                    self.free[s].append(end)
                at = end
            else:
                inner = self._state()
                self.free[at].append(inner)
                end = self._state()
                self.free[self._chain(value, inner)].append(end)
                self.free[at].append(end)
                at = end
        return at

    def _closed(self, states: set[int]) -> set[int]:
        left = list(states)
        while left:
            for nxt in self.free[left.pop()]:
                if nxt not in states:
                    states.add(nxt)
                    left.append(nxt)
        return states

    def accept(self, words: list[bytes], start: int) -> int:
        """The end of the longest accepted run from ``start``, or -1."""
        states, at, end = self._closed({0}), start, -1
        while states:
            if self.end in states:
                end = at
            if at == len(words):
                break
            word, at = words[at], at + 1
            nxt = {self.words[s][word] for s in states if word in self.words[s]}
            nxt |= {self.any[s] for s in states if self.any[s] >= 0}
            states = self._closed(nxt)
        return end


def places(line: bytes, phrase: bytes) -> Iterator[int]:
    """Word positions of ``phrase`` (with blanks around) in ``line``, overlapping ones included."""
    at, before, words = line.find(phrase), 0, 0
    while at >= 0:
        words += line.count(b" ", before, at)
        before = at
        yield words
        at = line.find(phrase, at + 1)


def scan(text: bytes | None, phrases: list[tuple[bytes, str]], automata: list[Automaton]) -> tuple:
    words = alnum_words(text)
    line = b" " + b" ".join(words) + b" "
    starts: list[int] = []
    base: set[str] = set()
    for phrase, label in phrases:
        if found := list(places(line, phrase)):
            starts += found
            base.add(label)
    matches = []
    for a in automata:
        if a.anchor in line:
            for start in places(line, a.head):
                if (end := a.accept(words, start)) >= 0:
                    matches.append((a.label, start, end))
    labels = base | {m[0] for m in matches}
    score = 1.0 if matches else 0.5 if base else 0.0
    span = (min(starts), max(starts)) if starts else (None, None)
    return len(words), len(starts), *span, sorted(base), sorted(labels), matches, score


def scan_licenses(
    docs: DataFrame,
    text_col: str = "text",
    out: str = "license",
    templates: dict[str, str] | None = None,
    phrases: dict[str, str] | None = None,
) -> DataFrame:
    """``docs`` with the struct column ``out``: word counts, phrase places, labels, template matches, score.

    The score is 1 if a whole template is accepted, 0.5 if there is only a phrase, else 0.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases

    def make():
        fixed = [(b" " + b" ".join(alnum_words(p.encode())) + b" ", label) for p, label in phrases.items()]
        automata = [Automaton(label, t) for label, t in templates.items()]
        return lambda text: scan(text, fixed, automata)

    return with_result(docs, text_col, out, FIELDS, make)


def as_regex(template: str) -> str:
    """The template as a regular expression over words with one blank before each, for the SQL."""

    def of(items: list[tuple]) -> str:
        return "".join(
            " " + v.decode() if kind == "word" else f"(?: [^ ]+){{0,{v}}}" if kind == "var" else f"(?:{of(v)})?"
            for kind, v in items
        )

    return of(parse(template)) + " "
