"""License scans by matching template markup.

A template is a text with two kinds of regions: `[[...]]` is optional and may be left out,
`{{n}}` is replaceable and takes up to n words of any kind.  All other wording is
mandatory.  Templates are compiled into one automaton over words: a mandatory word is a
transition of its own, an optional region can be skipped, a replaceable one is a chain of
states that any word leads along.  A text is accepted by a template where some run of its
words is led from the template's first state to its last, so that all mandatory wording
is there, in order and exactly.

The automaton reads each text once, word by word, with the set of states that are alive;
where none is, it goes to the next word that a template can begin with.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import bytes_in_parts, lower_bytes
from loomgraph.session import ship

#: Words in UTF-8, after A-Z are lower-cased.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MARKUP = re.compile(r"(\[\[)|(\]\])|\{\{(\d+)\}\}")

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# The wording of public licenses and of the notices that name them.
TEMPLATES = {
    "mit": """[[the]] [[mit license]] [[copyright [[c]] {{12}} [[all rights reserved]]]]
        permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the
        rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit
        persons to whom the software is furnished to do so subject to the following conditions
        the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or
        substantial portions of the software
        the software is provided as is without warranty of any kind express or implied including but not limited to the
        warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{6}} be
        liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from
        out of or in connection with the software or the use or other dealings in the software""",
    "isc": """[[isc license]] [[copyright [[c]] {{12}}]]
        permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies
        the software is provided as is and {{4}} disclaims all warranties with regard to this software including all
        implied warranties of merchantability and fitness in no event shall {{4}} be liable for any special direct
        indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in
        an action of contract negligence or other tortious action arising out of or in connection with the use or
        performance of this software""",
    "bsd-2-clause": """redistribution and use in source and binary forms with or without modification are permitted provided that
        the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of
        conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright
        notice this list of conditions and the following disclaimer in the documentation and or other materials provided
        with the distribution this software is provided by {{10}} as is and any express or implied warranties including
        but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed""",
    "bsd-3-clause": """redistribution and use in source and binary forms with or without modification are permitted provided that
        the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of
        conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright
        notice this list of conditions and the following disclaimer in the documentation and or other materials provided
        with the distribution [[3]] neither the name of {{10}} nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission""",
    "zlib": """this software is provided as is without any express or implied warranty in no event will the authors be held
        liable for any damages arising from the use of this software permission is granted to anyone to use this software
        for any purpose including commercial applications and to alter it and redistribute it freely subject to the
        following restrictions""",
    "unlicense": """this is free and unencumbered software released into the public domain anyone is free to copy modify publish
        use compile sell or distribute this software""",
    "apache-2.0": "[[you may use this file]] licensed under the apache license version 2 0 [[the license]]",
    "gpl-2.0": "licensed under [[the terms of]] the [[gnu]] general public license version 2 [[0]] [[or {{3}} later [[version]]]]",
    "gpl-3.0": "licensed under [[the terms of]] the [[gnu]] general public license version 3 [[0]] [[or {{3}} later [[version]]]]",
    "mit-notice": "[[this {{4}} is]] [[released]] [[distributed]] [[licensed]] under [[the terms of]] the mit license",
    "cc-by": "licensed under [[a]] [[the]] cc by [[4 0]] [[3 0]]",
    "cc-by-nc": "licensed under [[a]] [[the]] cc by nc [[4 0]] [[3 0]]",
    "cc-by-sa": "licensed under [[a]] [[the]] cc by sa [[4 0]] [[3 0]]",
}

# Spellings that license texts use for one word.
SAME = {"licence": "license", "licenced": "licensed", "sublicence": "sublicense", "merchantibility": "merchantability"}


@dataclass(frozen=True)
class Scan:
    """templates: label -> markup. phrases: words that stand for a label by themselves, in lower case."""

    templates: tuple[tuple[str, str], ...] = tuple(TEMPLATES.items())
    phrases: tuple[tuple[str, str], ...] = tuple(PHRASES.items())


def parsed(markup: str) -> list:
    """The template as nested lists: bytes are mandatory words, numbers replaceable regions, lists optional ones."""
    stack: list[list] = [[]]
    at = 0
    for m in [*_MARKUP.finditer(markup), None]:
        plain = markup[at : m.start() if m else len(markup)]
        stack[-1] += WORD.findall(lower_bytes(plain.encode()))
        if m is None:
            break
        at = m.end()
        if m[1]:
            stack.append([])
        elif m[2]:
            if len(stack) == 1:
                raise ValueError("an optional region ends that didn't begin")
            region = stack.pop()
            stack[-1].append(region)
        else:
            stack[-1].append(int(m[3]))
    if len(stack) > 1:
        raise ValueError("an optional region doesn't end")
    if not any(isinstance(x, bytes) for x in stack[0]):
        raise ValueError("a template needs a mandatory word")
    return stack[0]


class Automaton:
    """All templates as one. States are numbers; only those that a word leads from, or that accept, are kept
    in the tuples that a word leads to.

    symbols: word -> number, 0 for all others. first: symbol -> states after a template's first word.
    steps, steps_any: state -> states after a symbol, after any word. share: of the template's
    mandatory words, those before the state. accepts: state -> template's number, or -1."""

    def __init__(self, how: Scan):
        self.labels = [label for label, _ in how.templates]
        self.symbols: dict[bytes, int] = {}
        self._words: list[list[tuple[int, int]]] = []
        self._any: list[list[int]] = []
        self._free: list[list[int]] = []
        self.share: list[float] = []
        self.accepts: list[int] = []
        begins = []
        for number, (_, markup) in enumerate(how.templates):
            nodes = parsed(markup)
            total = sum(isinstance(x, bytes) for x in nodes)
            begins.append(self._state(0.0))
            end = self._build(nodes, begins[-1], 0, total, True)
            self.accepts[end] = number
        after = [self._closure(k) for k in range(len(self.share))]
        self.steps: list[dict[int, tuple[int, ...]]] = []
        for words in self._words:
            step: dict[int, set[int]] = {}
            for symbol, target in words:
                step.setdefault(symbol, set()).update(after[target])
            self.steps.append({symbol: tuple(sorted(states)) for symbol, states in step.items()})
        self.steps_any = [tuple(sorted({x for t in targets for x in after[t]})) for targets in self._any]
        start = {x for b in begins for x in after[b]}
        if any(self.steps_any[x] for x in start):
            raise ValueError("a template can't begin with a replaceable region")
        first: dict[int, set[int]] = {}
        for x in start:
            for symbol, states in self.steps[x].items():
                first.setdefault(symbol, set()).update(states)
        self.first = {symbol: tuple(sorted(states)) for symbol, states in first.items()}
        self.phrases = [(label, [self._symbol(w) for w in WORD.findall(lower_bytes(phrase.encode()))]) for phrase, label in how.phrases]
        # spellings of one word are apart for phrases, and one symbol for templates
        same = {self._symbol(k.encode()): self._symbol(v.encode()) for k, v in SAME.items()}
        self.canon = np.array([same.get(k, k) for k in range(len(self.symbols) + 1)])
        self.begins = np.zeros(len(self.canon), bool)
        self.begins[list(self.first)] = True

    def _symbol(self, word: bytes) -> int:
        return self.symbols.setdefault(word, len(self.symbols) + 1)

    def _state(self, share: float) -> int:
        self._words.append([])
        self._any.append([])
        self._free.append([])
        self.share.append(share)
        self.accepts.append(-1)
        return len(self.share) - 1

    def _build(self, nodes: list, at: int, done: int, total: int, counted: bool) -> int:
        for node in nodes:
            if isinstance(node, bytes):
                done += counted
                then = self._state(done / total)
                word = node.decode()
                self._words[at].append((self._symbol(SAME.get(word, word).encode()), then))
            elif isinstance(node, int):
                then = self._state(done / total)
                self._free[at].append(then)
                for _ in range(node):
                    more = self._state(done / total)
                    self._any[at].append(more)
                    self._free[more].append(then)
                    at = more
            else:
                inner = self._build(node, at, done, total, False)
                then = self._state(done / total)
                self._free[inner].append(then)
                self._free[at].append(then)
            at = then
        return at

    def _closure(self, state: int) -> set[int]:
        seen, todo = {state}, [state]
        while todo:
            for x in self._free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return {x for x in seen if self._words[x] or self._any[x] or self.accepts[x] >= 0}

    def read(self, text: bytes) -> np.ndarray:
        """The symbols of a whole text's words."""
        get, parts = self.symbols.get, [np.zeros(0, np.int32)]
        lower = lower_bytes(text)
        for part in bytes_in_parts(lower, WORD):
            found = WORD.findall(part)
            parts.append(np.fromiter((get(w, 0) for w in found), np.int32, len(found)))
        return np.concatenate(parts)

    def places(self, symbols: np.ndarray) -> list[tuple[str, np.ndarray]]:
        """(label, starts) of each phrase."""
        out = []
        for label, phrase in self.phrases:
            n = max(0, len(symbols) - len(phrase) + 1)
            here = np.ones(n, bool)
            for k, symbol in enumerate(phrase):
                here &= symbols[k : k + n] == symbol
            out.append((label, np.flatnonzero(here)))
        return out

    def matches(self, symbols: np.ndarray) -> tuple[list[tuple[int, int, int]], float]:
        """(template, first word, last word) of the runs that a template accepts and that are in no longer
        run that one accepts; and the largest share of a template's mandatory words that was read,
        from its first on, before a word that doesn't fit."""
        words = self.canon[symbols]
        places = np.flatnonzero(self.begins[words])
        best, found = 0.0, {}
        steps, steps_any, share, accepts, first = self.steps, self.steps_any, self.share, self.accepts, self.first
        alive: dict[int, int] = {}  # state -> the first word of the earliest run that leads there
        i = 0
        while True:
            if not alive:
                k = np.searchsorted(places, i)
                if k == len(places):
                    break
                i = int(places[k])
            elif i >= len(words):
                break
            symbol = int(words[i])
            now: dict[int, int] = {}
            for state, began in alive.items():
                for x in (*steps[state].get(symbol, ()), *steps_any[state]):
                    if now.get(x, began) >= began:
                        now[x] = began
            for x in first.get(symbol, ()):
                now.setdefault(x, i)
            for x, began in now.items():
                if share[x] > best:
                    best = share[x]
                if accepts[x] >= 0:
                    found[accepts[x], began] = i
            alive = now
            i += 1
        runs = sorted(((n, a, b) for (n, a), b in found.items()), key=lambda r: (r[1], -r[2]))
        kept: list[tuple[int, int, int]] = []
        for n, a, b in runs:  # of those before it, the one that ends last begins no later
            if not kept or b > kept[-1][2] or (a, b) == kept[-1][1:]:
                kept.append((n, a, b))
        return kept, best


@cache
def automaton(how: Scan = Scan()) -> Automaton:
    return Automaton(how)


_OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, matches array<struct<label: string, first: long, last: long>>, score double"


def scanned(text: bytes | None, how: Scan = Scan()) -> dict:
    machine = automaton(how)
    symbols = machine.read(text or b"")
    places = machine.places(symbols)
    starts = np.concatenate([np.zeros(0, np.int64), *(p for _, p in places)])
    runs, share = machine.matches(symbols)
    base = sorted({label for label, p in places if len(p)})
    matches = [{"label": machine.labels[n], "first": a, "last": b} for n, a, b in runs]
    return {
        "n_words": len(symbols), "n_base": len(starts), "first_word": int(starts.min()) if len(starts) else None, "last_word": int(starts.max()) if len(starts) else None,
        "base_labels": base, "labels": sorted({*base, *(m["label"] for m in matches)}), "matches": matches, "score": max(share, 0.5 if base else 0.0),
    }


def license_scan(docs: DataFrame, how: Scan = Scan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document: n_words; n_base, first_word, last_word and base_labels of the phrases; matches
    (label, first and last word) of the templates; labels of both; and score, the largest share
    of a template's mandatory words read in order, 0.5 at least where a phrase is.

    A null text is an empty one, without words and labels. Repeated rows are scanned as rows of
    their own; a null id stays null. Texts are read whole and once, in time that grows with their
    length. Other columns are not read. An empty table gives no rows."""
    ship(docs.sparkSession)
    kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.list_(pa.string()), "labels": pa.list_(pa.string())}
    schema = pa.schema([*kinds.items(), ("matches", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            yield pa.RecordBatch.from_pylist([{"doc_id": ids[i].as_py()} | scanned(texts[i].as_py(), how) for i in range(batch.num_rows)], schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(run, _OUT)
