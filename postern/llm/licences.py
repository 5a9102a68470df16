"""License scans with a generalised suffix automaton of licence tokens.

All templates go into one automaton over word ids. A document is streamed through it: at each word the automaton's
state is the longest run of words, ending here, that occurs in some template (the matching statistics). Maximal
runs become matches at every template place they occur in; matches of one template that lie in the same order and
close together are chained, and a chain that covers enough of its template is a span with that label.

A phrase is a short template whose every occurrence is reported, whatever surrounds it. The automaton is built from
fixed templates, so it is small and is shipped with the task; documents need no shuffle.

Defined cases: null and empty texts have no words, no span and score 0; rows repeating a doc_id are each judged;
texts are streamed whole, long ones too; only the named columns are read, so clashing further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from postern.llm.batches import ALNUM, owners, per_document, split_words

# Phrases that always count, with their labels, and opening passages of public licence texts.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("epl", "Eclipse Public License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc", "This work is licensed under a Creative Commons Attribution International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "All rights reserved"),
)

#: Words a match needs (fewer if its template is shorter), words between chained matches, share of a template.
LEAST_WORDS, GAP, COVER = 4, 12, 0.75

SPAN = StructType(
    [
        StructField("label", StringType()),
        StructField("start", IntegerType()),
        StructField("end", IntegerType()),
        StructField("covered", DoubleType()),
        StructField("phrase", StringType()),
    ]
)


@dataclass
class Automaton:
    """Suffix automaton of several word sequences; `places` are the (template, last word) ends of a state."""

    moves: list[dict[int, int]]
    length: list[int]
    link: list[int]
    places: list[list[tuple[int, int]]]

    @classmethod
    def of(cls, sequences: Sequence[Sequence[int]]) -> Automaton:
        a = cls([{}], [0], [-1], [[]])
        for k, sequence in enumerate(sequences):
            last = 0
            for i, word in enumerate(sequence):
                last = a._extend(last, word)
                a.places[last].append((k, i))
        for state in sorted(range(1, len(a.length)), key=lambda s: -a.length[s]):
            a.places[a.link[state]] += a.places[state]
        a.places = [sorted(set(p)) if s else [] for s, p in enumerate(a.places)]
        return a

    def _new(self, length: int, moves: dict[int, int], link: int) -> int:
        self.moves.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.places.append([])
        return len(self.length) - 1

    def _split(self, parent: int, word: int) -> int:
        """State for parent + word with exactly that length."""
        child = self.moves[parent][word]
        if self.length[child] == self.length[parent] + 1:
            return child
        copy = self._new(self.length[parent] + 1, dict(self.moves[child]), self.link[child])
        self.link[child] = copy
        while parent != -1 and self.moves[parent].get(word) == child:
            self.moves[parent][word] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.moves[last]:
            return self._split(last, word)
        new = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p != -1 and word not in self.moves[p]:
            self.moves[p][word] = new
            p = self.link[p]
        self.link[new] = 0 if p == -1 else self._split(p, word)
        return new

    def matches(self, words: Sequence[int], start: int) -> list[tuple[int, int, int]]:
        """Maximal matches (first word, words, state) of a run of known words that begins at `start`."""
        out, state, n = [], 0, 0
        for i, word in enumerate(words):
            if (to := self.moves[state].get(word)) is not None:
                state, n = to, n + 1
                continue
            out.append((start + i - n, n, state))
            while state and word not in self.moves[state]:
                state = self.link[state]
            n = self.length[state] + 1
            state = self.moves[state][word]
        out.append((start + len(words) - n, n, state))
        return out


class Scanner:
    """Phrases and templates as one automaton; made once and sent to the tasks."""

    def __init__(self, templates: Sequence[tuple[str, str]], phrases: Mapping[str, str], least: int, gap: int, cover: float):
        texts = [(label, t, "") for label, t in templates] + [(label, p, p) for p, label in phrases.items()]
        sequences = [t.encode().translate(ALNUM).split() for _, t, _ in texts]
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for s in sequences for w in s))}
        self.labels, self.phrase = [x[0] for x in texts], [x[2] for x in texts]
        self.sizes = [len(s) for s in sequences]
        self.automaton = Automaton.of([[self.ids[w] for w in s] for s in sequences])
        self.least, self.gap, self.cover = [min(least, n) for n in self.sizes], gap, cover
        #: Words the shortest thing to be found has; a shorter run of known words can hold none.
        self.fewest = min((n if p else m for n, m, p in zip(self.sizes, self.least, self.phrase) if n), default=1)
        self._cache: dict[int, list[tuple[int, int]]] = {}

    def spans(self, codes: np.ndarray) -> list[dict]:
        """Spans of one document, from the ids of its words (-1: in no template)."""
        known = np.flatnonzero(codes >= 0)
        if len(known) < self.fewest:
            return []
        cuts = np.flatnonzero(np.diff(known) > 1) + 1
        out, chains, near = [], {}, {}
        for run in np.split(known, cuts):
            if len(run) < self.fewest:
                continue
            first = int(run[0])
            for start, n, state in self.automaton.matches(codes[run[0] : run[-1] + 1].tolist(), first):
                for k, last in self.automaton.places[state]:
                    if self.phrase[k] or n < self.least[k]:
                        continue
                    self._chain(chains.setdefault(k, []), near.setdefault(k, []), start, n, last - n + 1)
            out += self._phrases(codes[run[0] : run[-1] + 1], first)
        for k, found in chains.items():
            best: list[tuple[int, int, float]] = []
            for start, end, _, covered in found:
                if (share := covered / self.sizes[k]) >= self.cover:
                    if best and start < best[-1][1]:
                        if share > best[-1][2]:
                            best[-1] = (start, end, share)
                    else:
                        best.append((start, end, share))
            out += [{"label": self.labels[k], "start": a, "end": b, "covered": min(1.0, c), "phrase": None} for a, b, c in best]
        return out

    def _chain(self, found: list, near: list, start: int, n: int, at: int) -> None:
        """Add the best chain that ends with this match (document start, words, template start) to `found`.

        A match begins a chain, or continues one that ends at most `gap` words before it and earlier in the template,
        whichever then covers most. Matches come in the order of their starts, so a chain out of reach of one is out of
        reach of all later ones; those within reach (`near`) are all tried. They end within `gap` words and a match,
        so their number follows the template, not the document.
        """
        near[:] = [c for c in near if start - c[1] <= self.gap]
        best = (start, start + n, at + n, n)
        for begin, end, reached, covered in near:
            skip = max(0, reached - at, end - start)
            if skip < n and start + skip - end <= self.gap and covered + n - skip > best[3]:
                best = (begin, start + n, at + n, covered + n - skip)
        found.append(best)
        near.append(best)

    def _phrases(self, codes: np.ndarray, first: int) -> list[dict]:
        """Every place of a phrase: the places where the automaton's match is at least as long and ends with it."""
        a, out, state, n = self.automaton, [], 0, 0
        for i, word in enumerate(codes.tolist()):
            while state and word not in a.moves[state]:
                state = a.link[state]
                n = a.length[state]
            state = a.moves[state].get(word, 0)
            n = n + 1 if state else 0
            if state and n >= self.fewest:
                for k, size in self._ends(state):
                    if n >= size:
                        out.append({"label": self.labels[k], "start": first + i - size + 1, "end": first + i + 1, "covered": 1.0, "phrase": self.phrase[k]})
        return out

    def _ends(self, state: int) -> list[tuple[int, int]]:
        """Phrases that end at a match of this state: those on its way along the suffix links, or at it."""
        a = self.automaton
        if state not in self._cache:
            whole, s = set(), state
            while s > 0:
                whole |= {(k, self.sizes[k]) for k, last in a.places[s] if self.phrase[k] and last == self.sizes[k] - 1 and a.length[s] == self.sizes[k]}
                s = a.link[s]
            self._cache[state] = sorted(whole)
        return self._cache[state]


def scan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    least: int = LEAST_WORDS,
    gap: int = GAP,
    cover: float = COVER,
) -> DataFrame:
    """Per document: n_words and spans (label, first word, word after the last, covered share, phrase if it is one)."""
    scanner = Scanner(templates, phrases, least, gap, cover)
    get = scanner.ids.get

    def kernel(blobs: list[bytes | None]) -> list:
        words, counts = split_words(blobs, ALNUM)
        codes = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known, owner = codes >= 0, owners(counts)
        busy = set((owner[known] if scanner.fewest < 2 else owner[:-1][known[:-1] & known[1:]]).tolist())
        base = np.cumsum(counts) - counts
        spans = [scanner.spans(codes[base[d] : base[d] + counts[d]]) if d in busy else [] for d in range(len(blobs))]
        return [counts, spans]

    return per_document(docs, [doc_id], text, kernel, [StructField("n_words", LongType()), StructField("spans", ArrayType(SPAN))])


def digest(scanned: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Counts of `scan`: places of phrases, labels, and the largest covered share as score."""
    base = F.filter("spans", lambda s: s["phrase"].isNotNull())
    joined = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return scanned.withColumn("_base", base).select(
        doc_id,
        "n_words",
        F.size("_base").cast("bigint").alias("n_base"),
        F.array_min(F.transform("_base", lambda s: s["start"])).cast("bigint").alias("first_word"),
        F.array_max(F.transform("_base", lambda s: s["start"])).cast("bigint").alias("last_word"),
        joined(F.col("_base")).alias("base_labels"),
        joined(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["covered"])), F.lit(0.0)).alias("score"),
    )
