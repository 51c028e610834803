"""Find licence notices in documents with a positional rare-token index.

The index holds the rare words of the licence templates with their postings
(template, position): the words of highest IDF, so many that any notice with the
coverage asked for holds rare words of a known weight. A file's rare words are
looked up, and their postings intersected by position: only stretches in which
enough rare words of one template stand near each other are compared with it.
There the heaviest row of template words is found whose distances agree with the
template's up to a small drift from one word to the next, so words may be put in
or left out all along. A row with enough weight is accepted if all mandatory key
phrases of the template stand in its stretch.

Three base phrases are found wherever their words stand consecutively.

Defined cases: null and empty texts have no words, no labels, score 0 and null
places; of several notices of one label the best counts, of rows of equal weight
the one that starts last; repeated rows are scanned each; texts of any length are
scanned whole; other columns are not looked at. The index is as large as the
templates given (by default those below), and every task builds it.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmask.llm.common import documents, q, small_batches

# Phrases and their labels.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# (label, wording of the notice, phrases that it must hold).
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        ("apache license version 2 0", "in compliance with the license"),
    ),
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Licensed under the MIT License", ("mit license",)),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    (
        "gpl-3.0",
        "This work is licensed under the GNU General Public License, version 3",
        ("gnu general public license version 3",),
    ),
    (
        "gpl-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
        ("free software foundation", "version 2 of the license"),
    ),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        ("free software foundation", "version 3 of the license"),
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation",
        ("gnu lesser general public license",),
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
        ("redistribution and use in source and binary forms", "following conditions are met"),
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        ("for any purpose with or without fee is hereby granted",),
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        ("mozilla public license v 2 0",),
    ),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    (
        "cc-by-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        ("creative commons attribution 4 0 international",),
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
)

DRIFT = 2  # words that may be missing or added between a word and the next that is found
COVERAGE = 0.6  # least share of a template's weight

# ASCII letters and digits and all bytes of other characters belong to words.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str) -> list[bytes]:
    """Words with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def places_of(words: list[bytes], at: dict[bytes, list[int]], phrase: list[bytes]) -> list[int]:
    """Starts of a phrase, searched from its first word's places."""
    n = len(phrase)
    return [i for i in at.get(phrase[0], ()) if words[i : i + n] == phrase]


class Index:
    """Rare words of the templates with postings, and the weights of all words.

    A word weighs its IDF, shared by its places in the template. The rare words of a
    template are those of highest IDF until the others weigh less than half of
    what a match needs, so a match always holds rare words of some weight.
    """

    def __init__(self, templates=TEMPLATES, base=BASE_PHRASES, drift=DRIFT, coverage=COVERAGE):
        self.drift, self.coverage = drift, coverage
        self.labels = [label for label, _, _ in templates]
        self.keys = [[words_of(k) for k in keys] for _, _, keys in templates]
        self.texts = [words_of(text) for _, text, _ in templates]
        held_by = defaultdict(set)
        for t, text in enumerate(self.texts):
            for word in text:
                held_by[word].add(t)
        self.idf = {w: math.log(1 + len(self.texts) / len(ts)) for w, ts in held_by.items()}
        self.weights = [[self.idf[w] / text.count(w) for w in text] for text in self.texts]
        self.least = [coverage * sum(weights) - 1e-9 for weights in self.weights]
        self.places = []  # of each template: word -> its places, last first
        self.postings = defaultdict(list)  # rare word -> (template, place)
        self.need = []  # weight of rare words that any match holds
        for t, text in enumerate(self.texts):
            places = defaultdict(list)
            for p in reversed(range(len(text))):
                places[text[p]].append(p)
            self.places.append(dict(places))
            left = sum(self.weights[t])
            for word in sorted(places, key=lambda w: (-self.idf[w], w)):
                if left < self.least[t] / 2:
                    break
                left -= self.idf[word]
                self.postings[word] += [(t, p) for p in places[word]]
            self.need.append(self.least[t] - left - 1e-9)
        self.base = [(words_of(phrase), label) for phrase, label in base]
        self.known = set(self.postings) | {phrase[0] for phrase, _ in self.base}

    def scan(self, text: str | None) -> tuple:
        """(n_words, n_base, first, last, base labels, labels, score) of a text."""
        words = words_of(text or "")
        at = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.known:
                at[w].append(i)
        starts, base = [], set()
        for phrase, label in self.base:
            if found := places_of(words, at, phrase):
                starts += found
                base.add(label)
        accepted = self.templates_in(words, at)
        labels = base | set(accepted)
        score = max([1.0] * bool(base) + list(accepted.values()), default=0.0)
        edges = (min(starts), max(starts)) if starts else (None, None)
        return (len(words), len(starts), *edges, ",".join(sorted(base)), ",".join(sorted(labels)), score)

    def templates_in(self, words: list[bytes], at: dict[bytes, list[int]]) -> dict[str, float]:
        """Accepted labels with the share of their template's weight that was met."""
        seeds = defaultdict(list)
        for w in at:
            for t, p in self.postings.get(w, ()):
                seeds[t] += [(i, p) for i in at[w]]
        accepted: dict[str, float] = {}
        for t, found in seeds.items():
            for low, high in self.regions(t, sorted(found), len(words)):
                share = self.best_match(t, words[low:high])
                if share > accepted.get(self.labels[t], 0.0):
                    accepted[self.labels[t]] = min(1.0, share)
        return accepted

    def regions(self, t: int, seeds: list[tuple[int, int]], n: int) -> Iterator[tuple[int, int]]:
        """Stretches of a text in which the rare words of a template stand near enough to each other.

        Seeds are (place in the text, place in the template), in order. Consecutive words
        of a match are off by drift at most, which bounds the length of a match.
        """
        reach = len(self.texts[t]) * (1 + self.drift)
        weights, held, total, first = self.weights[t], defaultdict(int), 0.0, 0
        low = high = None
        for i, p in seeds:
            held[p] += 1
            if held[p] == 1:
                total += weights[p]
            while seeds[first][0] < i - reach:
                gone = seeds[first][1]
                held[gone] -= 1
                if not held[gone]:
                    total -= weights[gone]
                first += 1
            if total < self.need[t] - 1e-6:
                continue
            start = max(0, seeds[first][0] - reach)
            if high is not None and start > high:
                yield low, high
                low = start
            elif high is None:
                low = start
            high = min(n, i + reach + 1)
        if high is not None:
            yield low, high

    def best_match(self, t: int, words: list[bytes]) -> float:
        """Greatest share of the template's weight in a row of its words that holds all key phrases; 0 without any.

        Words of a row follow each other in text and template, and their distances differ
        by drift at most from one to the next, so offsets may drift along the template.
        """
        places, weights, size = self.places[t], self.weights[t], len(self.texts[t])
        drift, least = self.drift, self.least[t]
        ends: dict[int, list[tuple[int, float, int]]] = {}  # by offset: (place, best weight up to it, start of its text)
        best, keys = 0.0, None
        for i, word in enumerate(words):
            for p in places.get(word, ()):
                before, start = 0.0, i - p
                for d in range(i - p - drift, i - p + drift + 1):
                    for q_, weight, s in reversed(ends.get(d, ())):
                        if q_ < p and q_ + d < i:
                            if (weight, s) > (before, start) or not before:
                                before, start = weight, s
                            break
                weight = before + weights[p]
                row = ends.setdefault(i - p, [])
                if weight >= least and weight > best:
                    if keys is None:
                        keys = [starts_of(words, key) for key in self.keys[t]]
                    low, high = start - drift, i + size - p + drift
                    held = zip(keys, self.keys[t], strict=True)
                    if all(any(low <= k and k + len(key) <= high for k in found) for found, key in held):
                        best = weight
                # the better of this end and earlier ones at the same offset
                if row and row[-1][1] > weight:
                    row.append((p, row[-1][1], row[-1][2]))
                else:
                    row.append((p, weight, start))
        return best / sum(weights)


def starts_of(words: list[bytes], phrase: list[bytes]) -> list[int]:
    return [i for i, w in enumerate(words) if w == phrase[0] and words[i : i + len(phrase)] == phrase]


RESULT = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")]
    + [T.StructField(c, T.StringType()) for c in ("base_labels", "labels")]
    + [T.StructField("score", T.DoubleType())]
)


def scanner(templates=TEMPLATES):
    """An expression builder: text to what Index.scan gives."""

    @F.arrow_udf(RESULT)
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Index(templates)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        for batch in batches:
            rows = [index.scan(t) for t in batch.to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return scanned


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    templates: (label, wording, phrases that it must hold), as many as are wanted.
    """
    small_batches(docs.sparkSession)
    scanned = scanner(templates)
    return docs.select(q(id_col).alias("doc_id"), scanned(q(text_col)).alias("s")).select("doc_id", "s.*")


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
