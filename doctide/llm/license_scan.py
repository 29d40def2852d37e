"""License scan: base phrases, and an exact set-similarity join with templates.

A text is cut into blocks of ``2 * stride`` words, one every ``stride`` words, so each
passage of up to ``stride`` words lies whole in a block.  A template's stride is the
power of two (``LEAST_STRIDE`` at least) that holds all its words, however long it is.
A block matches a template if it contains at least ``CONTAINMENT`` of the template's
distinct words.  The join is exact and orders words by their document frequency in the
whole corpus, rarest first:

* prefix filter: of a template with ``n`` words of which ``m`` must be there, any
  matching block holds one of the ``n - m + 1`` rarest.  An inverted index from these
  words to their templates gives a block's candidates, so that a block meets only
  templates it shares a rare word with, however many there are;
* length filter: a block has at least ``m`` distinct template words;
* positional filter: after the first shared word, enough words must be left on
  both sides.

Templates are constants: their index is a literal of the plan, a table of buckets that a
word's checksum looks up.  Documents are neither shuffled nor handed to Python.

Cases: null or empty text has no words, no labels, null places and score 0; repeated
rows are scanned one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctide.llm.work import carried

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed phrases and their labels.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)
#: Label, statement.  Statements are the customary sentences of public licenses.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
               "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
            "from this software without specific prior written permission"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
            "that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights "
            "to the work worldwide under copyright law"),
)
CONTAINMENT = 0.9
LEAST_STRIDE = 32


def words(text: str) -> Column:
    """Words of a text column, A-Z lower-cased.

    ``lower`` also folds letters outside A-Z, which moves no word boundary and makes no word
    equal to one of a phrase or template; the one letter that it turns into an ASCII one, the
    Kelvin sign, is exchanged for another (``translate`` takes several times as long).
    """
    plain = F.lower(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\u212a"), F.lit("\u212b")))
    return F.array_remove(F.split(plain, SEPARATORS), "")


def _every(statement: str) -> list[str]:
    return re.findall("[0-9a-z]+", statement.lower())


def _tokens(statement: str) -> list[str]:
    return list(dict.fromkeys(_every(statement)))


def stride(statement: str) -> int:
    """Words between the blocks that a template is looked for in; blocks are twice as long."""
    return max(LEAST_STRIDE, 1 << (len(_every(statement)) - 1).bit_length())


def frequencies(df: DataFrame, text: str, vocabulary: list[str]) -> dict[str, int]:
    """Documents that hold each word of the vocabulary; at most one row a word is collected."""
    known = F.array(*[F.lit(v) for v in vocabulary])
    rows = (
        df.select(F.explode(F.array_intersect(known, words(text))).alias("w"))
        .groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()
    )
    return {r["w"]: r["n"] for r in rows}


def template_index(df: DataFrame, text: str, templates=TEMPLATES, containment: float = CONTAINMENT):
    """(ordered vocabulary, [(label, ordered words, prefix length, needed)])."""
    sets = [(label, _tokens(statement)) for label, statement in templates]
    vocabulary = sorted({w for _, t in sets for w in t})
    seen = frequencies(df, text, vocabulary)
    vocabulary.sort(key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(vocabulary)}
    index = []
    for label, t in sets:
        t = sorted(t, key=rank.__getitem__)
        need = math.ceil(containment * len(t) - 1e-9)
        index.append((label, t, len(t) - need + 1, need))
    return vocabulary, index


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


class _Index:
    """What a word leads to: its place in the global order, and the templates in whose prefix it is."""

    def __init__(self, vocabulary, index):
        self.size = 1 << (2 * len(vocabulary)).bit_length()
        postings: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, p, _) in enumerate(index):
            for at, w in enumerate(t[:p]):
                postings.setdefault(w, []).append((k, at))
        buckets: list[list[Column]] = [[] for _ in range(self.size)]
        none = F.array().cast("array<struct<template:int,at:int>>")
        for rank, w in enumerate(vocabulary):
            found = [F.struct(F.lit(k).alias("template"), F.lit(at).alias("at")) for k, at in postings.get(w, ())]
            buckets[zlib.crc32(w.encode()) % self.size].append(F.struct(
                F.lit(rank).alias("rank"), F.lit(w).alias("word"), (F.array(*found) if found else none).alias("postings")))
        kind = "array<struct<rank:int,word:string,postings:array<struct<template:int,at:int>>>>"
        self.table = F.array(*[(F.array(*b) if b else F.array()).cast(kind) for b in buckets])
        self.prefixes = sorted(postings)

    def known(self, words: Column) -> Column:
        """For each word: its entry, or null."""
        return F.transform(words, lambda w: F.get(F.filter(
            F.get(self.table, F.pmod(F.crc32(w.cast("binary")), F.lit(self.size)).cast("int")), lambda e: e["word"] == w), F.lit(0)))


MATCHES = "array<struct<label:string,template:int,block:int,start:long,containment:double>>"


def _matches(index, step: int) -> Column:
    """Matches of the templates of one stride, over _e: what is known of each word."""
    own = F.array(*[F.lit(k) for k, (*_, s) in enumerate(index) if s == step])
    needs = F.array(*[F.lit(need) for *_, need, _ in index])
    sets, labels = F.array(*[_strings(t) for _, t, *_ in index]), _strings([label for label, *_ in index])
    last = F.greatest(F.ceil((F.size("_e") - step) / step).cast("int"), F.lit(1)) - 1

    def block(k):
        """Distinct known words in global order, once for all that reads them."""
        known = F.array_sort(F.array_distinct(F.filter(F.slice("_e", k * step + 1, 2 * step), lambda e: e.isNotNull())))
        return F.struct(k.alias("k"), known.alias("known"))

    def in_block(b):
        size = F.size(b["known"])

        def wanted(e, j):
            need = lambda p: F.get(needs, p["template"])
            return F.transform(F.filter(e["postings"], lambda p: F.array_contains(own, p["template"]) & (size - j >= need(p))
                                        & (F.size(F.get(sets, p["template"])) - p["at"] >= need(p))), lambda p: p["template"])

        candidates = F.array_sort(F.array_distinct(F.flatten(F.transform(b["known"], wanted))))
        shared = F.transform(candidates, lambda t: F.struct(
            t.alias("t"), F.size(F.array_intersect(F.get(sets, t), F.transform(b["known"], lambda e: e["word"]))).alias("n")))
        return F.transform(F.filter(shared, lambda x: x["n"] >= F.get(needs, x["t"])), lambda x: F.struct(
            F.get(labels, x["t"]).alias("label"), x["t"].alias("template"), b["k"].alias("block"), (b["k"] * step).cast("long").alias("start"),
            (x["n"] / F.size(F.get(sets, x["t"]))).alias("containment")))

    least = min(need for *_, need, s in index if s == step)
    blocks = F.filter(F.transform(F.sequence(F.lit(0), last), block), lambda b: F.size(b["known"]) >= least)
    return F.flatten(F.transform(blocks, in_block))


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
         templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """keep's columns, n_words, n_base, first_word, last_word, base_labels, matches, labels, score.

    matches: one entry a block and template that meet the threshold; start is the block's first word.
    """
    vocabulary, index = template_index(df, text, templates, containment)
    index = [(*entry, stride(statement)) for entry, (_, statement) in zip(index, templates)]
    words_to = _Index(vocabulary, [entry[:4] for entry in index])
    out = df.select(carried(keep), words(text).alias("_w")).withColumn("n_words", F.size("_w").cast("long"))

    def places(phrase: str) -> Column:
        parts = phrase.split()
        here = lambda i: [F.get("_w", i + k) == p for k, p in enumerate(parts)]

        def at(i):
            test = here(i)[0]
            for t in here(i)[1:]:
                test = test & t
            return test

        return F.filter(F.sequence(F.lit(0), F.size("_w") - 1), at)

    has = F.array_contains("_w", "license") & (F.size("_w") > 0)
    none = F.array().cast("array<int>")
    for phrase, label in PHRASES:
        out = out.withColumn(f"_at_{label}", F.when(has, places(phrase)).otherwise(none))
    every = F.concat(*[F.col(f"_at_{label}") for _, label in PHRASES])

    # texts without a prefix word have no candidates: their words are not looked up
    shares = F.arrays_overlap("_w", _strings(words_to.prefixes)) if words_to.prefixes else F.lit(False)
    out = out.withColumn("_e", F.when(shares, words_to.known(F.col("_w"))))
    found = F.concat(*[_matches(index, step) for step in sorted({s for *_, s in index})]) if index else F.array()
    out = out.withColumn("matches", F.when(F.col("_e").isNotNull(), found.cast(MATCHES)).otherwise(F.array().cast(MATCHES)))
    base = F.array_compact(F.array(*[
        F.when(F.size(f"_at_{label}") > 0, F.lit(label)) for label in sorted(x for _, x in PHRASES)
    ]))
    return out.select(
        "_keep.*", "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.transform("matches", lambda m: m["label"]))), ",").alias("labels"),
        F.when(F.size(every) > 0, F.lit(1.0)).otherwise(
            F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))
        ).alias("score"),
        "matches",
    )
