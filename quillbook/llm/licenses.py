"""Licence scan through a positional index of rare words.

Templates are licence phrases and longer licence texts. Document frequencies
over all documents tell which of a template's words are rare. In a document
only these are looked up: an occurrence at word p of a template's word t puts
the template's start at p - t, and starts on which several rare words agree are
kept. A phrase needs all its words to agree. A longer text needs two of three,
and then its mandatory key phrases near the places where they belong. All of
it is array arithmetic inside a document's row; only the frequencies are
shuffled, one row for each word of the templates.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbook.llm.common import fresh, or_empty

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rare words looked up for a longer text, and words by which a key phrase may have moved.
RARE = 3
DRIFT = 8


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key_phrases: tuple[str, ...] = ()

    @property
    def words(self) -> list[str]:
        return words_of(self.text)


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


#: Phrases and their labels.
PHRASES = (
    Template("gpl", "gnu general public license"),
    Template("apache", "apache license"),
    Template("cc-by", "cc by"),
    Template("mit", "mit license"),
)

#: Opening sentences of licence texts.
TEXTS = (
    Template("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
             "documentation files", ("permission is hereby granted", "free of charge")),
    Template("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
             "the following conditions are met", ("redistribution and use", "following conditions are met")),
    Template("apache-text", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
             "with the License", ("apache license version 2 0", "in compliance with the license")),
    Template("gpl-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
             "Public License as published by the Free Software Foundation", ("is free software", "gnu general public license")),
    Template("mpl-text", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
             ("source code form", "mozilla public license")),
    Template("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
             "granted", ("for any purpose with or without fee",)),
    Template("cc-by-text", "This work is licensed under a Creative Commons Attribution 4.0 International License",
             ("creative commons attribution",)),
    Template("unlicense-text", "This is free and unencumbered software released into the public domain", ("unencumbered software",)),
)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case. Of all other characters only two turn into ASCII letters in ``lower``: those texts go letter by letter."""
    other = text.contains("K") | text.contains("İ")
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(other, F.translate(text, letters, letters.lower())).otherwise(F.lower(text))


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def literal(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def rarity(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, float]:
    """Inverse document frequency of each word of ``vocabulary`` over all documents."""
    present = F.array_intersect(words(or_empty(text_col)), literal(vocabulary))
    found = dict(docs.select(F.explode(present).alias("w")).groupBy("w").count().collect())  # a row for each template word at most
    n = docs.count()
    return {w: math.log((1 + n) / (1 + found.get(w, 0))) for w in vocabulary}


def scan(docs: DataFrame, text_col: str = "text", phrases: tuple[Template, ...] = PHRASES, texts: tuple[Template, ...] = TEXTS) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    n_base counts the places where the words of a phrase follow each other;
    first_word and last_word are the first and last start among them, words
    counted from 0, or null. labels adds those of the longer texts. score is the
    largest share of a found template's words that stand in their places, 1 for
    phrases, 0 if nothing is found. spans lists every place as (label, start,
    length, share); a longer text whose opening is cut off has a negative start.
    A null or empty text has no words and no places. Repeated rows are scanned
    alike. Columns of ``docs`` may have any name: an added column whose name is
    taken gets an underscore at its end.
    """
    templates = [*phrases, *texts]
    vocabulary = sorted({w for t in templates for w in t.words})
    idf = rarity(docs, vocabulary, text_col)
    places = []  # of the words of each template that are looked up
    for t in templates:
        by_rarity = sorted(range(len(t.words)), key=lambda i: (-idf[t.words[i]], i))
        places.append(sorted(by_rarity if t in phrases else by_rarity[:RARE]))
    lookups = sorted({t.words[i] for t, at in zip(templates, places, strict=True) for i in at})
    names = fresh(docs, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
    n_word, n_hit, *rest = fresh(docs, "scan_words", "scan_hits", *[f"scan_at_{i}" for i in range(len(lookups))],
                                 *[f"scan_start_{i}" for i in range(len(templates))], *[f"scan_span_{i}" for i in range(len(templates))])
    at_names, rest = dict(zip(lookups, rest, strict=False)), rest[len(lookups):]
    start_names, span_names = rest[:len(templates)], rest[len(templates):]
    found, hits = F.col(n_word), F.col(n_hit)

    def word_at(i: Column) -> Column:
        return F.get(found, i)

    def places_of(word: str) -> Column:
        return F.when(F.size(hits) > 1, F.filter(hits, lambda p: word_at(p) == word)).otherwise(nothing)

    def starts_by(word: str, i: int) -> Column:
        return F.transform(at_names[word], lambda p: p - i)

    def aligned(t: Template, at: list[int]) -> Column:
        starts = {i: starts_by(t.words[i], i) for i in at}
        if t in phrases:
            return reduce(F.array_intersect, [starts[i] for i in at])
        pairs = [F.array_intersect(starts[i], starts[j]) for i in at for j in at if i < j]
        return reduce(F.array_union, pairs)

    def spans(t: Template, starts: Column) -> Column:
        size = len(t.words)
        if t in phrases:
            return F.transform(starts, lambda s: F.struct(F.lit(t.label).alias("label"), s.alias("start"), F.lit(size).alias("length"), F.lit(1.0).alias("share")))

        def phrase_near(s: Column, phrase: str) -> Column:
            wanted = words_of(phrase)
            offset = next(i for i in range(size) if t.words[i:i + len(wanted)] == wanted)
            near = F.sequence(F.greatest(s + (offset - DRIFT), F.lit(0)), F.greatest(s + (offset + DRIFT), F.lit(0)))
            return F.exists(near, lambda p: F.slice(found, p + 1, len(wanted)) == literal(wanted))

        def share(s: Column) -> Column:
            equal = [F.when((s + i >= 0) & (word_at(F.greatest(s + i, F.lit(0))) == w), 1).otherwise(0) for i, w in enumerate(t.words)]
            return reduce(lambda a, b: a + b, equal) / size

        kept = F.filter(starts, lambda s: reduce(lambda a, b: a & b, [phrase_near(s, p) for p in t.key_phrases]))
        return F.transform(kept, lambda s: F.struct(
            F.lit(t.label).alias("label"), s.alias("start"), F.lit(size).alias("length"), share(s).cast("double").alias("share")))

    nothing = F.array().cast("array<int>")
    marked = docs.withColumn(n_word, words(or_empty(text_col)))
    marked = marked.withColumn(n_hit, F.array_compact(F.transform(found, lambda w, i: F.when(w.isin(lookups), i))))
    marked = marked.withColumns({name: places_of(w) for w, name in at_names.items()})
    marked = marked.withColumns({
        name: aligned(t, at) for name, t, at in zip(start_names, templates, places, strict=True)})
    marked = marked.withColumns({
        name: spans(t, F.col(start)) for name, start, t in zip(span_names, start_names, templates, strict=True)})
    base = F.concat(*[F.col(n) for n in start_names[:len(phrases)]])

    def labels(of: list[tuple[str, Template]]) -> Column:
        present = F.array_compact(F.array(*[F.when(F.size(n) > 0, t.label) for n, t in of]))
        return F.concat_ws(",", F.array_sort(F.array_distinct(present)))

    by_template = list(zip(span_names, templates, strict=True))
    every = F.concat(*span_names)
    columns = [
        F.size(found).cast("long"), F.size(base).cast("long"), F.array_min(base).cast("long"), F.array_max(base).cast("long"),
        labels(by_template[:len(phrases)]), labels(by_template),
        F.coalesce(F.array_max(F.transform(every, lambda s: s["share"])), F.lit(0.0)), every,
    ]
    return marked.select(*docs.columns, *[c.alias(n) for c, n in zip(columns, names, strict=True)])
