"""License scan by a positional index of rare words.

Each licence template is a word sequence. Of its words those with the highest inverse document frequency, counted
over all documents, are its anchors; the index maps an anchor to (template, position). A document looks up its own
words: every anchor met at position i votes for the template beginning at i - position, votes that agree within a
few words form an alignment, and an alignment is accepted when enough of the template's words stand at their
places and its mandatory key phrases stand inside it.

Base phrases are counted exactly, wherever their words stand consecutively; their labels always count.

Inputs: a null text has no words. Rows are scanned one by one, also when ids repeat or are null. Extra columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import ALNUM_BYTES, encoded, slices

# Phrases and labels of the base count.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Public licence notices (label, notice, mandatory key phrases), lower case, words only.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license", "except in compliance")),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use", "source and binary forms")),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("reserved", "all rights reserved", ("all rights reserved",)),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited", ("unauthorized copying",)),
)

ANCHORS = 4
SLACK = 2
MIN_COVER = 0.75


def words_of(text: str | None) -> list[bytes]:
    return encoded(text).translate(ALNUM_BYTES).split()


def _phrase_places(words: list[bytes], phrase: tuple[bytes, ...]) -> list[int]:
    n, out, at = len(phrase), [], -1
    try:
        while True:
            at = words.index(phrase[0], at + 1)
            if tuple(words[at: at + n]) == phrase:
                out.append(at)
    except ValueError:
        return out


_BASE = {tuple(p.encode().split()): label for p, label in BASE.items()}
_VOCABULARY = frozenset(w for _, notice, _ in TEMPLATES for w in notice.encode().split())


def document_frequencies(docs: DataFrame) -> tuple[int, dict[bytes, int]]:
    """Documents in all, and documents that hold each word of the templates (a fixed, small vocabulary)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = Counter(), 0
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column(0).to_pylist():
                seen.update(_VOCABULARY.intersection(words_of(text)))
        yield pa.record_batch([pa.array(["", *(w.decode() for w in seen)]), pa.array([rows, *seen.values()])], names=["word", "n"])

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"].encode(): r["n"] for r in counts.collect()}
    return found.pop(b"", 0), found


class Index:
    def __init__(self, documents: int, frequency: dict[bytes, int], anchors: int = ANCHORS):
        self.templates = [(label, n.encode().split(), [tuple(k.encode().split()) for k in keys]) for label, n, keys in TEMPLATES]
        idf = {w: math.log((documents + 1) / (frequency.get(w, 0) + 1)) for w in _VOCABULARY}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.anchors = []
        for t, (_, words, _) in enumerate(self.templates):
            first = {w: i for i, w in reversed(list(enumerate(words)))}
            rare = sorted(first, key=lambda w: (-idf[w], first[w]))[:anchors]
            self.anchors.append(len(rare))
            for w in rare:
                self.postings[w].append((t, first[w]))
        self.postings = dict(self.postings)

    def scan(self, text: str | None) -> tuple[int, list[int], set[str], dict[str, float]]:
        """(words, places of base phrases, base labels, coverage by label of the accepted templates)."""
        words = words_of(text)
        places, base = [], set()
        for phrase, label in _BASE.items():
            if found := _phrase_places(words, phrase):
                places += found
                base.add(label)
        labels: dict[str, float] = {}
        if not self.postings.keys().isdisjoint(words):
            postings, votes = self.postings, defaultdict(list)
            for i, w in enumerate(words):
                if w in postings:
                    for t, at in postings[w]:
                        votes[t].append((i - at, at))
            for t, starts in votes.items():
                cover = max((self._cover(words, t, start) for start in self._alignments(starts, self.anchors[t])), default=0.0)
                if cover >= MIN_COVER:
                    label = self.templates[t][0]
                    labels[label] = max(labels.get(label, 0.0), cover)
        return len(words), places, base, labels

    @staticmethod
    def _alignments(starts: list[tuple[int, int]], anchors: int) -> set[int]:
        """Beginnings on which at least half of the anchors agree within the slack."""
        by_start: dict[int, set[int]] = defaultdict(set)
        for start, at in starts:
            by_start[start].add(at)
        need = max(1, -(-anchors // 2))
        out = set()
        for start in by_start:
            near = set().union(*(by_start.get(start + d, ()) for d in range(-SLACK, SLACK + 1)))
            if len(near) >= need:
                out.add(start)
        return out

    def _cover(self, words: list[bytes], t: int, start: int) -> float:
        """Share of the template's words that stand in order near their places; 0 without its key phrases."""
        _, template, keys = self.templates[t]
        window = words[max(0, start - SLACK): start + len(template) + SLACK]
        if not all(_phrase_places(window, key) for key in keys):
            return 0.0
        at, met = max(0, start - SLACK) - 1, 0
        for i, w in enumerate(template):
            for j in range(max(at + 1, start + i - SLACK), min(len(words), start + i + SLACK + 1)):
                if words[j] == w:
                    at, met = j, met + 1
                    break
        return met / len(template)


def scan(docs: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; see the module's text."""
    index = Index(*document_frequencies(docs), anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in slices(batch, "text"):
                rows = []
                for n, places, base, labels in map(index.scan, cut.column(1).to_pylist()):
                    rows.append((n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
                                 ",".join(sorted(base | labels.keys())), 1.0 if base else max(labels.values(), default=0.0)))
                columns = list(zip(*rows))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
                yield pa.record_batch([cut.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                                      names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
