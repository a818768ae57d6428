"""Licence scans with a positional rare-token index.

Templates are word sequences of licence notices, each with mandatory key phrases. One pass over the
table counts in how many documents each template word occurs. The index keeps the positions of every
template word. Of the template words that a document holds, the ``anchors`` of highest IDF are looked
up, for each template whose mandatory words are all there; each occurrence votes for
``(template, document position - template position)``. So does every place at which a mandatory phrase
stands, whatever the anchors are: a match has all its mandatory phrases about their places, so each of its
relative positions is proposed. There (give or take ``slack`` words) the mandatory phrases are looked up
word by word around their places, and the score is the IDF share of template words found in place. The
anchors only tell which relative positions are tried first.

Base phrases (``BASE``) are searched everywhere by themselves; the method's labels are added to theirs.

Defined results: null and empty texts have no words, no label and score 0; a base phrase scores 1; a
null ``doc_id`` stays null; repeated rows are scanned separately; an empty table gives an empty
result; other columns are not read. Words and document frequencies cover whole texts of all rows.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.text import alnum_words, map_rows

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices as their publishers print them, and the phrases that must be there.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of "
                   "the license at http www apache org licenses license 2 0", ["apache org licenses"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files", ["permission is hereby granted", "free of charge"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met", ["source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee "
            "is hereby granted", ["with or without fee"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as "
            "published by the free software foundation", ["gnu general public license"]),
    ("lgpl", "licensed under the gnu lesser general public license version 3", ["lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license version 3", ["affero general public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ["mozilla public license"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license",
     ["creative commons attribution"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc0", "released under cc0 1 0 universal public domain dedication", ["public domain dedication"]),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ["free and unencumbered software"]),
]

ANCHORS = 3
SLACK = 2
MIN_SCORE = 0.5


class Index:
    """Positional postings of the template words."""

    def __init__(self, templates, idf: dict[bytes, float], anchors: int = ANCHORS, slack: int = SLACK,
                 min_score: float = MIN_SCORE):
        self.anchors, self.slack, self.min_score = anchors, slack, min_score
        self.templates, self.postings, self.ranked, self.needed = [], {}, [], []
        for t, (label, text, phrases) in enumerate(templates):
            words = alnum_words(text)
            keys = []
            for p in phrases:
                own = alnum_words(p)
                at = next(i for i in range(len(words)) if words[i:i + len(own)] == own)
                keys.append((at, own))
            weight = [idf.get(w, 0.0) for w in words]
            self.templates.append((label, words, keys, weight))
            self.ranked.append(sorted(set(words), key=lambda w: (-idf.get(w, 0.0), w)))
            self.needed.append(frozenset(w for _, own in keys for w in own))
            for q, w in enumerate(words):
                self.postings.setdefault(w, []).append((t, q))

    def match(self, words: list[bytes]) -> dict[str, float]:
        """Labels whose template is found, with the best score."""
        have = set(words)
        asked: dict[bytes, set[int]] = {}
        for t, needed in enumerate(self.needed):
            if needed <= have:
                for w in [w for w in self.ranked[t] if w in have][:self.anchors]:
                    asked.setdefault(w, set()).add(t)
        if not asked:
            return {}
        votes: dict[int, dict[int, set]] = {}
        for p, w in enumerate(words):
            if w in asked:
                for t, q in self.postings[w]:
                    if t in asked[w]:
                        votes.setdefault(t, {}).setdefault(p - q, set()).add(w)
        tried: dict[int, dict[int, int]] = {}
        for t, offsets in votes.items():
            places = tried.setdefault(t, {})
            for offset in offsets:
                near = set().union(*(offsets.get(offset + d, ()) for d in range(-self.slack, self.slack + 1)))
                if len(near) >= 2:
                    places[offset] = len(near)
        line = b" " + b" ".join(words) + b" "
        for t, needed in enumerate(self.needed):
            if needed <= have:
                at, own = self.templates[t][2][0]
                places = tried.setdefault(t, {})
                for p in _phrase_places(line, own):
                    for d in range(-self.slack, self.slack + 1):
                        places.setdefault(p - at + d, 0)
        found: dict[str, float] = {}
        for t, places in tried.items():
            label = self.templates[t][0]
            for offset in sorted(places, key=lambda o: -places[o]):
                if found.get(label) == 1.0:
                    break  # no place can be better
                s = self._verify(words, t, offset)
                if s >= self.min_score:
                    found[label] = max(s, found.get(label, 0.0))
        return found

    def _verify(self, words: list[bytes], t: int, offset: int) -> float:
        _, template, keys, weight = self.templates[t]
        around = range(-self.slack, self.slack + 1)
        for at, own in keys:
            if not any(offset + at + d >= 0 and words[offset + at + d:offset + at + d + len(own)] == own
                       for d in around):
                return 0.0
        hit = total = 0.0
        for q, w in enumerate(template):
            total += weight[q]
            lo = max(0, offset + q - self.slack)
            if w in words[lo:max(0, offset + q + self.slack + 1)]:
                hit += weight[q]
        return hit / total if total else 0.0


def _phrase_places(line: bytes, phrase: list[bytes]):
    """First words of the places of a phrase in a line of words (a blank before, between and behind them)."""
    own = b" " + b" ".join(phrase) + b" "
    at = line.find(own)
    word, counted = 0, 0
    while at >= 0:
        word += line.count(b" ", counted, at)
        counted = at
        yield word
        at = line.find(own, at + 1)


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """``(first word, label)`` of every place of a base phrase."""
    line = b" " + b" ".join(words) + b" "
    return [(word, label) for phrase, label in BASE.items() for word in _phrase_places(line, phrase.encode().split())]


def idf(docs: DataFrame, templates=TEMPLATES) -> dict[bytes, float]:
    """IDF of the template words over all rows; as many numbers as the templates have words."""
    vocabulary = frozenset(w for _, text, _ in templates for w in alnum_words(text))

    def count(batches):
        import pyarrow as pa
        seen, rows = Counter(), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                rows += 1
                seen.update(vocabulary.intersection(alnum_words(t)))
        seen[b""] = rows
        yield pa.RecordBatch.from_pydict({"w": pa.array(list(seen), pa.binary()),
                                          "n": pa.array(list(seen.values()), pa.int64())})

    got = {bytes(r.w): r.n for r in docs.select("text").mapInArrow(count, "w binary, n long")
           .groupBy("w").agg(F.sum("n").alias("n")).collect()}
    total = got.get(b"", 0)
    return {w: math.log((total + 1) / (got.get(w, 0) + 1)) + 1 for w in vocabulary}


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    weights = idf(docs, templates)
    id_type = dict(docs.dtypes)["doc_id"]

    def rows(columns, index):
        out = []
        for i, t in zip(*columns):
            words = alnum_words(t)
            places = base_places(words)
            base = {label for _, label in places}
            found = index.match(words)
            starts = [p for p, _ in places]
            out.append((i, len(words), len(places), min(starts, default=None), max(starts, default=None),
                        ",".join(sorted(base)), ",".join(sorted(base | found.keys())),
                        1.0 if places else min(1.0, max(found.values(), default=0.0))))
        return out

    return map_rows(docs, rows, f"doc_id {id_type}, n_words long, n_base long, first_word long, "
                    "last_word long, base_labels string, labels string, score double", ["doc_id", "text"],
                    before=lambda: Index(templates, weights))
