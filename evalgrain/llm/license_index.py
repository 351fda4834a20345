"""License scans by a positional index of rare words.

Method: license templates are indexed by word and position. Each file's own licence words are ranked by their inverse
document frequency over the whole corpus; the rarest ones are looked up, the postings of a template are intersected by
relative position (word position in the file minus position in the template), and where enough rare words agree on one
place the mandatory key phrases of that license are verified there.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, functions as F

from evalgrain.llm.common import map_batches, whole_text

# Phrases whose places are counted, and the label each gives.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Openings and notices of common licenses. A template is (label, text, phrases of which one must stand
# within the place found).
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files", ("permission is hereby granted free of charge",)),
    ("mit", "Released under the MIT License.", ("mit license",)),
    ("apache", "Licensed under the Apache License, Version 2.0", ("apache license",)),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License",
     ("except in compliance with the license",)),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation",
     ("gnu general public license", "free software foundation")),
    ("lgpl", "GNU Lesser General Public License", ("lesser general public license",)),
    ("agpl", "GNU Affero General Public License", ("affero general public license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsd", "Released under the BSD License.", ("bsd license",)),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License", ("mozilla public license",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted", ("for any purpose with or without fee",)),
    ("unlicense", "This is free and unencumbered software released into the public domain",
     ("released into the public domain",)),
    ("cc0", "CC0 1.0 Universal Public Domain Dedication", ("cc0 1 0",)),
    ("cc-by", "Licensed under CC BY 4.0.", ("cc by 4 0",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", ("cc by sa 4 0",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", ("cc by nc 4 0",)),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0.", ("cc by nd 4 0",)),
    ("proprietary", "All rights reserved", ("all rights reserved",)),
)
AGREE = 0.6  # part of a template's words that must stand at their relative positions
UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: bytes) -> list[bytes]:
    return WORD.findall(text.translate(UPPER))


class Index:
    """Postings word -> (template, position) of a fixed set of templates."""

    def __init__(self, templates=TEMPLATES):
        self.labels = [t[0] for t in templates]
        self.words = [words(t[1].encode()) for t in templates]
        self.phrases = [[words(p.encode()) for p in t[2]] for t in templates]
        self.postings = defaultdict(list)
        for t, body in enumerate(self.words):
            for k, word in enumerate(body):
                self.postings[word].append((t, k))

    def scan(self, body: list[bytes], idf: dict[bytes, float]) -> dict[str, float]:
        """Label -> best score (0 to 1) in a file's words: the part of the template's words found, weighted by idf."""
        there = self.postings.keys() & set(body)
        ranked = sorted(there, key=lambda w: (-idf.get(w, 0.0), w))
        # A template's positions whose word the file has, the rarest word first.
        anchors = defaultdict(list)
        for rank, word in enumerate(ranked):
            for t, k in self.postings[word]:
                anchors[t].append((rank, k, word))
        anchors = {t: marks for t, marks in anchors.items() if len(marks) >= AGREE * len(self.words[t])}
        if not anchors:
            return {}
        places = defaultdict(list)
        for k, word in enumerate(body):
            if word in there:
                places[word].append(k)
        found: dict[str, float] = {}
        for t, marks in anchors.items():
            size = len(self.words[t])
            total = sum(idf.get(w, 0.0) + 1.0 for w in self.words[t])
            # Where AGREE of the words agree, one of the rarest 1 - AGREE of them, and one more, does.
            first = sorted(marks)[:int((1 - AGREE) * size) + 1]
            for start in {p - k for _, k, word in first for p in places[word]}:
                agree = [w for k, w in enumerate(self.words[t]) if 0 <= start + k < len(body) and body[start + k] == w]
                if len(agree) < AGREE * size:
                    continue
                near = body[max(0, start):start + size]
                if any(near[i:i + len(p)] == p for p in self.phrases[t] for i in range(len(near) - len(p) + 1)):
                    score = sum(idf.get(w, 0.0) + 1.0 for w in agree) / total
                    found[self.labels[t]] = max(found.get(self.labels[t], 0.0), score)
        return found


def base_places(body: list[bytes]) -> list[tuple[int, int, str]]:
    """(first word, last word, label) of every place where a base phrase stands."""
    out = []
    for phrase, label in BASE.items():
        *front, last = words(phrase.encode())
        k = -1
        while True:
            try:
                k = body.index(last, k + 1)
            except ValueError:
                break
            if k >= len(front) and body[k - len(front):k] == front:
                out.append((k - len(front), k, label))
    return sorted(out)


def document_frequencies(docs: DataFrame, templates=TEMPLATES) -> tuple[dict[bytes, int], int]:
    """Documents of the whole corpus that hold each template word, and their number; as many rows as words."""
    vocabulary = {w for t in templates for w in words(t[1].encode())}

    def run(batches):
        for batch in batches:
            seen, texts = Counter(), batch.column("text").to_pylist()
            for text in texts:
                seen.update(vocabulary.intersection(WORD.findall(text.translate(UPPER))))
            yield {"word": [b"", *seen], "n": [len(texts), *seen.values()]}

    rows = (map_batches(docs.select(whole_text().cast("binary").alias("text")), run, "word binary, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")).collect())
    counts = {bytes(r["word"]): r["n"] for r in rows}
    return counts, counts.pop(b"", 0)


def license_scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of documents (doc_id, text).

    n_base counts all places of base phrases; first_word and last_word are the smallest and the largest start. `labels`
    has the base labels and those of templates found. The score is that of the best template, 1 with a base phrase, 0
    without any license. Null and empty text: no words, empty labels. Repeated rows: one row each.
    """
    counts, n = document_frequencies(docs, templates)
    idf = {w: math.log((n + 1) / (c + 1)) for w, c in counts.items()}

    def run(batches):
        index = Index(templates)
        phrase_ends = {words(p.encode())[-1] for p in BASE}
        for batch in batches:
            out = defaultdict(list)
            for text in batch.column("text").to_pylist():
                body = words(text)
                base = base_places(body) if phrase_ends.intersection(body) else []
                found = index.scan(body, idf)
                labels = {label for _, _, label in base}
                for name, value in (
                        ("n_words", len(body)), ("n_base", len(base)),
                        ("first_word", min((b[0] for b in base), default=None)),
                        ("last_word", max((b[0] for b in base), default=None)),
                        ("base_labels", ",".join(sorted(labels))), ("labels", ",".join(sorted(labels | found.keys()))),
                        ("score", 1.0 if base else max(found.values(), default=0.0))):
                    out[name].append(value)
            yield {"doc_id": batch.column("doc_id"), **out}

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(docs.select("doc_id", whole_text().cast("binary").alias("text")), run,
                       f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
                       "base_labels string, labels string, score double")
