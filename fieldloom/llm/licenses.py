"""License scans by template markup: mandatory wording with optional and replaceable regions, as token automata.

A template is words with two kinds of markup: ``[[ ... ]]`` is optional (it may nest), ``<<n>>`` stands for any 0 to n
words. It compiles to an automaton over the words of a text; a text has the license where the automaton, started at a
place, reaches its end, so every mandatory word must be there, in order, and nothing else between.

Cases: a null or empty text has no words, no labels and score 0. Repeated rows give repeated rows. Columns other than
the id and the text are not read, so they may have any name. A text of any length is scanned whole; time is linear in
it, since an automaton starts only where its leading words stand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import batch, chunked, text_bytes

# The phrases of the base and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Public license wording with this module's markup, and labels.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license [[version]] 2 0 [[the license you may not use this file except in compliance with the license [[you may obtain a copy of the license at <<12>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied]]]]"),
    ("gpl-2.0", "licensed under the gnu general public license [[as published by the free software foundation]] [[either]] version 2 [[of the license]] [[or [[at your option]] any later version]]"),
    ("gpl-3.0", "licensed under the gnu general public license [[as published by the free software foundation]] [[either]] version 3 [[of the license]] [[or [[at your option]] any later version]]"),
    ("gpl-notice", "free software you can redistribute it and or modify it under the terms of the gnu [[lesser]] [[affero]] general public license as published by the free software foundation"),
    ("mit-grant", "released under the mit license"),
    ("mit-grant", "licensed under the mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software [[the software is provided as is without warranty of any kind express or implied <<90>> in the software]]"),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution [[3]] [[neither the name of <<12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission]]"),
    ("cc-by-4.0", "licensed under [[a]] [[the]] [[creative commons]] cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under [[a]] [[the]] [[creative commons]] cc by nc [[4 0]]"),
    ("cc-by-sa-4.0", "licensed under [[a]] [[the]] [[creative commons]] cc by sa [[4 0]]"),
    ("cc-by-4.0", "licensed under [[a]] [[the]] creative commons attribution [[4 0]] [[international]] license"),
    ("cc0-1.0", "dedicated to the public domain under [[creative commons]] cc0 [[1 0]]"),
)

#: Upper-case letters become lower-case, ASCII other than digits and letters becomes a space, and the rest stays.
_FOLD = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))

ANY = None


class Automaton:
    """States in a row; at each, a word (or ANY) leads to the next state, and a skip to a later one needs no word."""

    def __init__(self, markup: str) -> None:
        self.words: list[bytes | None] = []
        self.skips: dict[int, list[int]] = {}
        opened: list[int] = []
        for part in re.findall(r"\[\[|\]\]|<<\d+>>|[^\s\[\]<>]+", markup):
            if part == "[[":
                opened.append(len(self.words))
            elif part == "]]":
                self.skips.setdefault(opened.pop(), []).append(len(self.words))
            elif part[0] == "<":
                for _ in range(int(part[2:-2])):
                    self.skips.setdefault(len(self.words), []).append(len(self.words) + 1)
                    self.words.append(ANY)
            else:
                self.words.append(part.encode().translate(_FOLD).strip())
        if opened:
            raise ValueError("an optional region is not closed")
        stop = min([*self.skips, len(self.words)])
        if not stop:
            raise ValueError("a template must begin with a mandatory word")
        self.lead = b" " + b" ".join(self.words[:stop]) + b" "
        self.lead_words = stop

    def _reach(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in self.skips.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    def longest(self, words: list[bytes], at: int) -> int:
        """Words from `at` that the template accepts at most; 0 if it doesn't accept. The lead is known to stand there."""
        states, best, end = self._reach({self.lead_words}), 0, len(self.words)
        for i in range(at + self.lead_words, len(words) + 1):
            if end in states:
                best = i - at
            if i == len(words):
                break
            states = self._reach({s + 1 for s in states if s < end and self.words[s] in (ANY, words[i])})
            if not states:
                break
        return best


@lru_cache(maxsize=8)
def compiled(templates: tuple[tuple[str, str], ...]) -> tuple[tuple[str, Automaton], ...]:
    return tuple((label, Automaton(markup)) for label, markup in templates)


def places(joined: bytes, phrase: bytes) -> Iterator[int]:
    """Word numbers where the phrase, with a space at either end, stands in the joined words."""
    at, words, before = joined.find(phrase), 0, 0
    while at >= 0:
        words += joined.count(b" ", before, at)
        before = at
        yield words
        at = joined.find(phrase, at + 1)


def scan(text: bytes, phrases: tuple[tuple[str, str], ...], templates: tuple[tuple[str, str], ...]) -> dict:
    """All findings of one text: places of phrases and spans (label, first word, words) of templates."""
    words = text.translate(_FOLD).split()
    joined = b" " + b" ".join(words) + b" "
    base = [(label, at, phrase.count(" ") + 1) for phrase, label in phrases for at in places(joined, f" {phrase} ".encode())]
    spans = [(label, at, n) for label, x in compiled(templates) for at in places(joined, x.lead) if (n := x.longest(words, at))]
    return {"n_words": len(words), "base": base, "spans": spans}


def covered(spans: list[tuple[str, int, int]]) -> int:
    """Words under at least one span."""
    total = done = 0
    for _, at, n in sorted(spans, key=lambda x: x[1]):
        total += max(0, at + n - max(at, done))
        done = max(done, at + n)
    return total


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64())])))])
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first: long, words: long>>"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """One row a row of docs: the phrases' places, labels of phrases and templates, spans, and the share of words under findings as score."""

    def run(batches):
        for b in batches:
            texts = text_bytes(b.column(1))
            for i, j in chunked(texts):
                rows = []
                for doc, text in zip(b.column(0).slice(i, j - i).to_pylist(), texts[i:j], strict=True):
                    x = scan(text, phrases, templates)
                    at = [p for _, p, _ in x["base"]]
                    own, both = {p[0] for p in x["base"]}, {p[0] for p in x["base"] + x["spans"]}
                    rows.append((doc, x["n_words"], len(at), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(both)), covered(x["base"] + x["spans"]) / max(1, x["n_words"]), [{"label": s[0], "first": s[1], "words": s[2]} for s in x["spans"]]))
                yield batch(_SCHEMA, *zip(*rows, strict=True))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
