"""License scans by template matching.

A template is license wording with markup: ``<<beginOptional>>...<<endOptional>>`` may be missing, and
``<<var;match=.{0,N}>>`` stands for up to N arbitrary words. It compiles to an automaton over word tokens. A text is
accepted at a place if its words follow the automaton to the end: mandatory wording must match word for word. Matching
starts only at words that can begin a template, and each start reports its longest match.

Base phrases are plain word runs; all their places count. Null texts have no words; a template may match many times;
overlapping matches of different templates all count; repeated rows get equal results; an empty table gives no rows;
columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideflow.llm.common import LOWER, NOT_ALNUM, buffer_of, slices, word_hashes, words_of

#: Phrases and their labels.
PHRASES = {"the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: The phrases that the contract of the query ``op3_licenses`` names.
CONTRACT_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: License wording with optional and replaceable regions.
TEMPLATES = {
    "mit-notice": "Released under the <<beginOptional>>terms of the<<endOptional>> MIT License",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 <<beginOptional>>(the \"License\"); you may not use this file except in compliance with the License<<endOptional>>",
    "gpl-3.0-notice": "This <<var;match=.{1,3}>> is licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License, <<beginOptional>>as published by the Free Software Foundation,<<endOptional>> version 3 <<beginOptional>>or any later version<<endOptional>>",
    "cc-by-nc-4.0-notice": "Licensed under <<beginOptional>>a Creative Commons<<endOptional>> CC BY-NC 4.0 <<beginOptional>>International License<<endOptional>>",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. <<beginOptional>>THE SOFTWARE IS PROVIDED \"AS IS\" AND <<var;match=.{1,4}>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE<<endOptional>>",
    "mit-text": "<<beginOptional>>Copyright (c) <<var;match=.{0,20}>><<endOptional>> Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.",
}
_MARK = re.compile(r"<<(beginOptional|endOptional|var;match=\.\{(\d+),(\d+)\})>>")
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text: str) -> list[bytes]:
    return _WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode("utf-8")))


class Automaton:
    """States are places between a template's words; ``step`` moves a set of states over one word.

    ``words[s]`` is the word that leads from s to s+1 (None: any word), ``skips[s]`` the states that s reaches freely.
    """

    def __init__(self, template: str):
        self.words: list[bytes | None] = []
        jumps: list[tuple[int, int]] = []
        open_, at = [], 0
        for mark in [*_MARK.finditer(template), None]:
            self.words += tokens(template[at : mark.start() if mark else len(template)])
            if mark is None:
                break
            at = mark.end()
            if mark[1] == "beginOptional":
                open_.append(len(self.words))
            elif mark[1] == "endOptional":
                if not open_:
                    raise ValueError("endOptional without beginOptional")
                jumps.append((open_.pop(), len(self.words)))
            else:
                least, most = int(mark[2]), int(mark[3])
                self.words += [None] * least
                end = len(self.words) + most - least
                jumps += [(s, end) for s in range(len(self.words), end)]
                self.words += [None] * (most - least)
        if open_ or not any(w is not None for w in self.words):
            raise ValueError("an optional region stays open, or the template has no wording")
        self.end = len(self.words)
        ahead: dict[int, set[int]] = {}
        for s, t in jumps:
            ahead.setdefault(s, set()).add(t)
        self.free = []
        for s in range(self.end + 1):
            seen, todo = {s}, [s]
            while todo:
                for t in ahead.get(todo.pop(), ()):
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            self.free.append(frozenset(seen))
        if self.end in self.free[0]:
            raise ValueError("the template accepts an empty text")

    def first_words(self) -> set[bytes | None]:
        return {self.words[s] for s in self.free[0] if s < self.end}

    def longest(self, word_at, start: int, stop: int) -> int | None:
        """The end of the longest match of the words from start; ``word_at`` gives a word's number."""
        states, best = self.free[0], None
        for place in range(start, stop):
            word = word_at[place]
            now: set[int] = set()
            for s in states:
                if s < self.end and (self.ids[s] == -1 or self.ids[s] == word):
                    now |= self.free[s + 1]
            if not now:
                break
            states = now
            if self.end in states:
                best = place + 1
        return best

    def number(self, vocabulary: dict[bytes, int]) -> Automaton:
        self.ids = [-1 if w is None else vocabulary[w] for w in self.words]
        return self


class Scanner:
    """Phrases and templates compiled against one small vocabulary of word hashes."""

    def __init__(self, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES):
        self.phrases = [(tokens(p), label) for p, label in phrases.items()]
        machines = {label: Automaton(t) for label, t in templates.items()}
        vocabulary = sorted({w for p, _ in self.phrases for w in p} | {w for m in machines.values() for w in m.words if w is not None})
        self.numbers = {w: k for k, w in enumerate(vocabulary)}
        raw = b" ".join(vocabulary)
        data = np.frombuffer(raw, np.uint8)
        starts, ends, _ = words_of(data, np.array([0, len(data)]), NOT_ALNUM)
        hashes = word_hashes(data, starts, ends)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.near = np.zeros(1 << 16, bool)
        self.near[hashes & np.uint64(0xFFFF)] = True
        self.machines = [(m.number(self.numbers), label) for label, m in machines.items()]
        if any(None in m.first_words() for m, _ in self.machines):
            raise ValueError("a template may not begin with a replaceable region")
        self.starters = [np.array(sorted(self.numbers[w] for w in m.first_words())) for m, _ in self.machines]

    def numbered(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -2, np.int32)  # a word of no template
        some = np.flatnonzero(self.near[hashes & np.uint64(0xFFFF)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[some]), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes[some]
        out[some[hit]] = self.order[at[hit]]
        return out

    def scan(self, texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, str]], list[tuple[int, int, str]]]]:
        """For each text: number of words, base places, template matches (start, end, label)."""
        data, bounds = buffer_of(texts)
        data = LOWER[data]
        starts, ends, rows = words_of(data, bounds, NOT_ALNUM)
        ids = self.numbered(word_hashes(data, starts, ends)) if len(starts) else np.zeros(0, np.int32)
        row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        base: list[list[tuple[int, str]]] = [[] for _ in range(len(rows) - 1)]
        for words, label in self.phrases:
            n = len(words)
            if len(ids) < n:
                continue
            hit = row[: len(ids) - n + 1] == row[n - 1 :]
            for k, w in enumerate(words):
                hit &= ids[k : len(ids) - n + 1 + k] == self.numbers[w]
            for p in np.flatnonzero(hit).tolist():
                base[row[p]].append((p - int(rows[row[p]]), label))
        found: list[list[tuple[int, int, str]]] = [[] for _ in range(len(rows) - 1)]
        for (machine, label), begin in zip(self.machines, self.starters, strict=True):
            for p in np.flatnonzero(np.isin(ids, begin)).tolist():
                stop = machine.longest(ids, p, int(rows[row[p] + 1]))
                if stop is not None:
                    found[row[p]].append((p - int(rows[row[p]]), stop - int(rows[row[p]]), label))
        for k in range(len(rows) - 1):
            yield int(rows[k + 1] - rows[k]), sorted(base[k]), sorted(found[k])


SCHEMA = "doc_id long, n_words long, base array<struct<word:long,label:string>>, matches array<struct<first:long,stop:long,label:string>>"


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, base (word, label), matches (first word, end, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in slices(batches, "text"):
            rows = list(scanner.scan(batch.column("text")))
            base = pa.array([[{"word": w, "label": x} for w, x in r[1]] for r in rows], pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())])))
            matches = pa.array([[{"first": a, "stop": b, "label": x} for a, b, x in r[2]] for r in rows], pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64()), ("label", pa.string())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([r[0] for r in rows], pa.int64()), base, matches], ["doc_id", "n_words", "base", "matches"])

    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(run, SCHEMA)


def licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """The digest: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the share of words that template matches and base phrases cover (counted once each), at most 1.
    """
    if len(set(phrases.values())) < len(phrases):
        raise ValueError("phrases need labels of their own")
    rows = scan_licenses(docs, phrases)
    lengths = F.create_map(*[F.lit(x) for p, label in phrases.items() for x in (label, len(tokens(p)))])
    names = lambda *c: F.array_join(F.array_sort(F.array_distinct(F.concat(*c))), ",")
    base, matches = F.transform("base", lambda x: x["label"]), F.transform("matches", lambda x: x["label"])
    covered = F.concat(
        F.flatten(F.transform("matches", lambda x: F.sequence(x["first"], x["stop"] - 1))),
        F.flatten(F.transform("base", lambda x: F.sequence(x["word"], x["word"] + F.element_at(lengths, x["label"]) - 1))),
    )
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(F.transform("base", lambda x: x["word"])).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["word"])).alias("last_word"), names(base).alias("base_labels"), names(base, matches).alias("labels"),
        F.least(F.lit(1.0), F.coalesce(F.try_divide(F.size(F.array_distinct(covered)), F.col("n_words")), F.lit(0.0))).cast("double").alias("score"),
    )
