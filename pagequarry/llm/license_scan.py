"""License scans as an exact set-similarity join of text windows with license templates.

A template is a set of words. A window of a text, as many words long as the template has, matches when
it contains at least ``PERCENT`` of the template's words. Words are put in one global order, by how many
documents have them, rarest first. A matching window must have one of the template's first
``n - ceil(n * PERCENT / 100) + 1`` words (prefix filter); it must be long enough for the words still to
find (length filter); and what follows the shared word in the order must hold the rest (positional
filter). Most documents have no prefix word at all and are only counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from pagequarry.llm.arrow import steps, utf8

#: Share of a template's words that a window must contain.
PERCENT = 80
# Phrases whose places are counted, and the label of each.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Wordings of license notices, and the label of each.
TEMPLATES = (
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", "mit"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "all-rights-reserved"),
)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SPLIT = re.compile(rb"[0-9a-z\x80-\xff]+")
_CAPITALS = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@dataclass
class Templates:
    """Templates with their words in the global order, prefixes and phrases."""

    frequency: dict[bytes, int]
    texts: tuple = TEMPLATES
    percent: int = PERCENT
    sets: list = field(init=False)

    def __post_init__(self) -> None:
        rank = lambda w: (self.frequency.get(w, 0), w)
        self.sets = []
        for text, label in self.texts:
            words = text.encode().split()
            order = sorted(set(words), key=rank)
            need = -(-len(order) * self.percent // 100)
            self.sets.append((order, {w: k for k, w in enumerate(order)}, need, len(words), label))
        self.phrases = [(tuple(p.encode().split()), label) for p, label in PHRASES]
        # Words one of which a document must have: prefixes, and the rarest word of each phrase.
        anchors = {w for order, _, need, _, _ in self.sets for w in order[: len(order) - need + 1]}
        anchors |= {min(p, key=rank) for p, _ in self.phrases}
        self.anchors = re.compile(
            rb"(?<![0-9a-z\x80-\xff])(?:" + b"|".join(sorted(map(re.escape, anchors))) + rb")(?![0-9a-z\x80-\xff])"
        )


def windows(words: list[bytes], templates: Templates) -> list[tuple[int, int, str, float, bool]]:
    """(first word, words, label, containment, best?) of the best window of each run of overlapping
    windows that match a template; best means that no other template contains more of the place."""
    places: dict[bytes, list[int]] = {}
    vocabulary = {w for _, at, _, _, _ in templates.sets for w in at}
    for k, w in enumerate(words):
        if w in vocabulary:
            places.setdefault(w, []).append(k)
    out = []
    for order, at, need, width, label in templates.sets:
        if len(words) < need:  # length filter
            continue
        starts: set[int] = set()
        for k, w in enumerate(order[: len(order) - need + 1]):
            if len(order) - k < need:  # positional filter
                break
            for p in places.get(w, ()):
                starts.update(range(max(0, p - width + 1), p + 1))
        best: tuple | None = None
        for s in sorted(starts):
            have = len({w for w in words[s : s + width] if w in at})
            if have >= need:
                if best and s < best[0] + width:
                    if have > best[4]:
                        best = (s, width, label, have / len(order), have)
                else:
                    if best:
                        out.append(best[:4])
                    best = (s, width, label, have / len(order), have)
        if best:
            out.append(best[:4])
    out.sort()
    return [
        (s, n, label, c, not any(s < t + m and t < s + n and d > c for t, m, _, d in out))
        for s, n, label, c in out
    ]


def phrase_places(words: list[bytes], templates: Templates) -> list[tuple[int, str]]:
    out = []
    for phrase, label in templates.phrases:
        n = len(phrase)
        k = -1
        while True:
            try:
                k = words.index(phrase[0], k + 1)
            except ValueError:
                break
            if tuple(words[k : k + n]) == phrase:
                out.append((k, label))
    return sorted(out)


def word_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of words of every text."""
    is_word = _WORD[data]
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    begins[edges] = is_word[edges]
    return np.diff(np.searchsorted(np.flatnonzero(begins), offsets))


def word_frequencies(docs: DataFrame, text: str) -> dict[bytes, int]:
    """In how many documents each template word stands, over all documents."""
    vocabulary = sorted({w for t, _ in TEMPLATES for w in t.encode().split()} | {w for p, _ in PHRASES for w in p.encode().split()})
    find = re.compile(rb"(?<![0-9a-z\x80-\xff])(?:" + b"|".join(map(re.escape, vocabulary)) + rb")(?![0-9a-z\x80-\xff])")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = dict.fromkeys(vocabulary, 0)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            raw = data.tobytes().translate(_CAPITALS)
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                for w in set(find.findall(raw[a:b])):
                    total[w] += 1
        yield pa.RecordBatch.from_pydict(
            {"word": [w.decode() for w in total], "n": pa.array(list(total.values()), pa.int64())}
        )

    sums = docs.select(F.col(text).alias("text")).mapInArrow(count, "word string, n long")
    # One row per template word.
    return {r["word"].encode(): r["n"] for r in sums.groupBy("word").agg(F.sum("n").alias("n")).collect()}


KIND = (
    "struct<n_words:bigint,base:array<struct<word:bigint,label:string>>,"
    "found:array<struct<word:bigint,length:bigint,label:string,containment:double,best:boolean>>>"
)


def scanned(text: Column, frequency: dict[bytes, int]) -> Column:
    """Words of a text, places of the phrases, and windows that match a template. Null: empty."""
    base_kind = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    found_kind = pa.list_(
        pa.struct(
            [
                ("word", pa.int64()),
                ("length", pa.int64()),
                ("label", pa.string()),
                ("containment", pa.float64()),
                ("best", pa.bool_()),
            ]
        )
    )

    @arrow_udf(KIND)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        templates = Templates(frequency)
        for texts in batches:
            data, offsets = utf8(texts)
            n = np.zeros(len(texts), np.int64)
            base: list[list] = [[] for _ in range(len(texts))]
            found: list[list] = [[] for _ in range(len(texts))]
            for first, last in steps(offsets):
                at = offsets[first : last + 1] - offsets[first]
                part = data[offsets[first] : offsets[last]]
                n[first:last] = word_counts(part, at)
                raw = part.tobytes().translate(_CAPITALS)
                # A line feed ends each text, so that no word has a neighbour in another text.
                ends = at.tolist()
                apart = b"\n".join([raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])
                begins = at[:-1] + np.arange(len(at) - 1)
                hits = [m.start() for m in templates.anchors.finditer(apart)]
                for row in np.unique(np.searchsorted(begins, hits, side="right") - 1).tolist():
                    words = _SPLIT.findall(raw[at[row] : at[row + 1]])
                    base[first + row] = [
                        {"word": k, "label": label} for k, label in phrase_places(words, templates)
                    ]
                    found[first + row] = [
                        {"word": s, "length": w, "label": label, "containment": c, "best": b}
                        for s, w, label, c, b in windows(words, templates)
                    ]
            yield pa.StructArray.from_arrays(
                [pa.array(n), pa.array(base, base_kind), pa.array(found, found_kind)],
                ["n_words", "base", "found"],
            )

    return scan(text)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``base`` (places of phrases) and ``found`` (matching windows) of every
    row; repeated rows each. Null, empty and wordless texts have none."""
    frequency = word_frequencies(docs, text)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return d.select("doc_id", scanned(F.col("text"), frequency).alias("s")).select("doc_id", "s.*")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, first and last place and labels (of phrases and best windows); the score is the best containment, 1 for a phrase."""

    def labels(c: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(c)), ",")

    base, found = F.col("base.label"), F.expr("filter(found, f -> f.best).label")
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.concat(base, found)).alias("labels"),
        F.when(F.size("base") > 0, 1.0)
        .otherwise(F.coalesce(F.array_max("found.containment"), F.lit(0.0)))
        .alias("score"),
    )
