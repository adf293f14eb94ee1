"""Operator 3: licence scans by a trained paragraph classifier; DataFrame functions only.

A paragraph is a line, and a notice that is wrapped over consecutive non-blank
lines is found by the words of its lines together, under its first line.  Its words and word pairs are the features of a sparse
softmax regression over licence families and "none", which the driver trains on
variants of the templates below and on at most ``max_rows`` distinct corpus lines.
Words that ordinary paragraphs have as well are no features; how often they have
them is counted over all lines of the corpus, less those that read like a template.
A paragraph without one of the few anchor words left scores as none, and is not
scored at all; the sampled lines have one.

The unknown class is calibrated by leaving families out: a family must be more
probable than what texts of families unseen in training usually reach.  A family
is reported only if a template of it confirms it, by the share of the template's
words that the paragraph holds; a paragraph that reads like a licence but is not
confirmed is unknown.

Scoring is one projection without a shuffle: a paragraph's score needs only the
document's own row, whole texts however long.  Null and empty texts have no
paragraphs.  Repeated rows stay; other columns are not read.  Of families that are
equally probable the first by name counts.  On an empty corpus the templates still
train, and no rows come out.
"""

from __future__ import annotations

import functools
import itertools
import operator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct lines sampled as examples of no licence, at most.
MAX_ROWS = 2_000
#: Share of all lines above which a word is too common, and of a template's words that confirm it.
COMMON, CONFIRM = 0.005, 0.7
NONE = "none"

#: Short licence notices by family.
TEMPLATES = {
    "agpl": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc0": (
        "This work is dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    ),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "lgpl": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "reserved": ("All rights reserved.", "Copyright. All rights reserved. No part of this publication may be reproduced without permission."),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
}


def _tokens(text: Column) -> Column:
    """Lower-case words: runs of letters and digits."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def _grams(words: Column) -> Column:
    """Words and pairs of neighbouring words, each once."""
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, pairs))


def _grams_of(words: list[str]) -> set[str]:
    return {*words, *map(" ".join, itertools.pairwise(words))}


@dataclass
class LicenseModel:
    families: list[str]  # the last is NONE
    weights: dict[str, np.ndarray]
    bias: np.ndarray
    anchors: list[str]
    least: float  # probability below which a family is unknown
    templates: list[tuple[str, list[str]]]

    def probabilities(self, words: list[str]) -> np.ndarray:
        s = self.bias + sum((self.weights[g] for g in sorted(_grams_of(words)) if g in self.weights), np.zeros(len(self.bias)))
        e = np.exp(s - s.max())
        return e / e.sum()


def _softmax(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 300, ridge: float = 0.02) -> np.ndarray:
    """Weights (classes, features) by gradient descent with momentum on balanced classes."""
    w, speed = np.zeros((classes, x.shape[1])), 0
    share = 1 / np.maximum(np.bincount(y, minlength=classes), 1)[y]
    goal = np.eye(classes)[y]
    for _ in range(rounds):
        s = x @ w.T
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        grad = ((p - goal) * share[:, None]).T @ x / classes + ridge * np.where(np.arange(x.shape[1]) == 0, 0, w) / classes
        speed = 0.9 * speed - 0.8 * grad
        w = w + speed
    return w


def _lines(docs: DataFrame) -> DataFrame:
    lines = docs.select(F.explode(F.split(F.col("text").cast("string"), "\n")).alias("line"))
    return lines.where(F.trim("line") != "").select("line", _tokens(F.col("line")).alias("words"))


def line_counts(docs: DataFrame, templates: list[tuple[str, list[str]]]) -> tuple[int, dict[str, int]]:
    """How many lines of docs read like no template, and how many of those have each word of the templates."""
    own = sorted({w for _, t in templates for w in t if w})
    # Lines with the same template words are one group; what a group is like is decided once.
    groups = _lines(docs).groupBy(F.array_sort(F.array_distinct(F.filter("words", lambda w: w.isin(own)))).alias("own")).agg(F.count(F.lit(1)).alias("n"))
    alike = [F.size(F.array_intersect("own", F.array(*[F.lit(w) for w in sorted(set(t))]))) >= 0.5 * len(set(t)) for _, t in templates]
    plain = groups.where(~functools.reduce(operator.or_, alike))
    counted = plain.select(F.explode(F.concat("own", F.array(F.lit("")))).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r.word: r.n for r in counted.collect()}  # a row a word of the templates, and one for all lines
    return found.pop("", 0), found


def fit(docs: DataFrame, max_rows: int = MAX_ROWS) -> LicenseModel:
    """Train on the templates, on counts of all lines of docs (..., text), and on at most ``max_rows`` of those."""
    spark = docs.sparkSession
    given = spark.createDataFrame([(f, t.strip(".")) for f, texts in TEMPLATES.items() for t in texts], "family string, text string")
    templates = [(r.family, list(r.words)) for r in given.select("family", _tokens(F.col("text")).alias("words")).collect()]
    total, often = line_counts(docs, templates)
    rare = lambda w: often.get(w, 0) <= COMMON * total
    anchors = sorted({w for _, t in templates for w in t if w and rare(w) and not w.isdigit()})
    # A pair is as rare as its rarer word.
    vocabulary = sorted({g for _, t in templates for g in _grams_of(t) if any(p in anchors for p in g.split())})
    picked = _lines(docs).where(F.arrays_overlap("words", F.array(*[F.lit(w) for w in anchors]))).groupBy("line").agg(F.first("words").alias("words"))
    picked = picked.orderBy(F.xxhash64("line"), "line").limit(max_rows)
    sample = [[w for w in r.words if w] for r in picked.select("words").collect()]
    sample = [w for w in sample if w and all(len(set(t) & set(w)) < 0.5 * len(set(t)) for _, t in templates)]
    families = [*TEMPLATES, NONE]
    index = {g: i + 1 for i, g in enumerate(vocabulary)}

    def vector(words: list[str]) -> np.ndarray:
        x = np.zeros(len(vocabulary) + 1)
        x[0] = 1
        x[[index[g] for g in _grams_of(words) if g in index]] = 1
        return x

    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    rows: list[tuple[int, list[str]]] = []
    for family, t in templates:
        cut = max(2, len(t) // 8)
        variants = [t, t[cut:], t[:-cut], t[cut // 2 :], *([*t[:i], *t[i + 1 :]] for i in range(len(t)))]
        # Less the word that tells two families apart, a notice reads like one of the other.
        rows += [(families.index(family), v) for v in variants if all(f == family or like(v, other) < like(v, t) for f, other in templates)]
    rng = np.random.default_rng(3)
    none = len(families) - 1
    # Of no licence: corpus paragraphs, and single anchor words among nothing else.
    rows += [(none, w) for w in sample] + [(none, [w]) for w in anchors] + [(none, [])]
    rows += [(none, [str(w) for w in rng.choice(anchors, 3, replace=False)]) for _ in range(200)]
    # Most sample paragraphs have no feature at all; equal rows are trained on once.
    x = np.unique([[c, *vector(w)] for c, w in rows], axis=0)
    y, x = x[:, 0].astype(int), x[:, 1:]
    w = _softmax(x, y, len(families))
    strange = []
    for left in range(none):
        rest = y != left
        other = _softmax(x[rest], y[rest], len(families), rounds=100)
        s = x[~rest] @ other.T
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[:, [left, none]] = 0
        strange += p.max(axis=1).tolist()
    least = float(np.clip(np.quantile(strange, 0.9), 0.3, 0.6))
    return LicenseModel(families, {g: w[:, i] for g, i in index.items()}, w[:, 0], anchors, least, templates)


def _array(values, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def paragraphs(docs: DataFrame, model: LicenseModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, n_paragraphs, and ``found``: line, family, probability and template share of each licence."""
    size = len(model.families)
    anchors = _array(model.anchors, "string")
    lines = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("line"), _tokens(x).alias("words"), (F.trim(x) == "").alias("blank")))
    live = F.filter(numbered, lambda x: F.arrays_overlap(x["words"], anchors))
    live = F.when(F.arrays_overlap(_tokens(F.col("text").cast("string")), anchors), live)
    weights = F.create_map(*[x for g, w in model.weights.items() for x in (F.lit(g), _array([float(v) for v in w], "double"))])

    def scores(grams: Column) -> Column:
        # Membership is looked up in a hash set; only the few grams of the vocabulary meet the map.
        own = F.transform(F.array_sort(F.filter(grams, lambda g: g.isin(list(model.weights)))), lambda g: F.element_at(weights, g))
        return F.aggregate(own, _array([float(v) for v in model.bias], "double"), lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))

    def judged(x: Column) -> Column:
        s = x["s"]
        top = F.array_max(s)
        total = F.aggregate(s, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
        licensed = F.slice(s, 1, size - 1)
        best = F.array_max(licensed)
        none = F.exp(F.element_at(s, size) - top) / total
        family = F.element_at(_array(model.families, "string"), F.array_position(licensed, best).cast("int"))
        shares = [F.when(family == f, F.size(F.array_intersect(x["words"], _array(sorted(set(t)), "string"))) / F.lit(float(len(set(t))))).otherwise(0.0) for f, t in model.templates]
        return F.struct(x["line"].alias("line"), family.alias("family"), (F.exp(best - top) / total).alias("p"), none.alias("none"), F.greatest(*shares).alias("share"), x["last"].alias("last"))

    # Each step is a transform of its own, so that what the next one uses often is computed once.
    def scored(texts: Column) -> Column:
        cut = F.transform(texts, lambda x: x.withField("grams", _grams(x["words"])))
        return F.transform(F.transform(cut, lambda x: x.withField("s", scores(x["grams"]))), judged)

    sure = lambda x: (x["none"] < 0.5) & (x["p"] >= model.least) & (x["share"] >= CONFIRM)
    n = F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("long")
    alone = docs.select(*keep, n.alias("n_paragraphs"), F.when(live.isNotNull(), numbered).alias("__lines"), scored(F.transform(live, lambda x: x.withField("last", x["line"]))).alias("__alone"))

    # A block ends at a blank line and at a confirmed one; lines without words do not count.
    done = F.transform(F.filter("__alone", sure), lambda x: x["line"])
    rest = F.transform("__lines", lambda x: F.struct(x["line"].alias("line"), F.array_remove(x["words"], "").alias("words"), (x["blank"] | F.array_contains(done, x["line"])).alias("ends")))
    alone = alone.withColumn("__rest", F.filter(rest, lambda x: x["ends"] | (F.size(x["words"]) > 0)))

    # From each line on as many lines as hold the longest template, wherever in its first line it begins.
    longest = max(len(t) for _, t in model.templates)

    def window(x: Column, i: Column) -> Column:
        start = F.struct(x["line"].alias("line"), x["line"].alias("last"), x["words"].alias("words"), F.lit(0).alias("more"), F.lit(True).alias("open"))

        def grow(acc: Column, y: Column) -> Column:
            on = acc["open"] & ~y["ends"] & (acc["more"] < longest)
            return F.struct(
                acc["line"].alias("line"), F.when(on, y["line"]).otherwise(acc["last"]).alias("last"), F.when(on, F.concat(acc["words"], y["words"])).otherwise(acc["words"]).alias("words"),
                F.when(on, acc["more"] + F.size(y["words"])).otherwise(acc["more"]).alias("more"), on.alias("open"),
            )

        return F.when(~x["ends"], F.aggregate(F.slice("__rest", i + 2, F.lit(longest)), start, grow))

    confirmed = [F.array(*[F.lit(w) for w in sorted(set(t))]) for _, t in model.templates]
    able = lambda x: functools.reduce(operator.or_, [F.size(F.array_intersect(x["words"], t)) >= CONFIRM * F.size(t) for t in confirmed])
    windows = F.filter(F.transform("__rest", window), lambda x: x.isNotNull() & (x["last"] > x["line"]) & F.arrays_overlap(x["words"], anchors) & able(x))
    blocks = alone.withColumn("__windows", windows).withColumn("__blocks", F.filter(scored(F.col("__windows")), sure))
    # Of overlapping windows of one family the fullest is the notice, the last of equals.
    better = lambda x, y: (y["family"] == x["family"]) & (y["line"] <= x["last"]) & (x["line"] <= y["last"]) & ((y["share"] > x["share"]) | (y["share"] == x["share"]) & (y["line"] > x["line"]))
    blocks = blocks.withColumn("__blocks", F.filter("__blocks", lambda x: ~F.exists("__blocks", lambda y: better(x, y))))
    # Lines that a block explains are not licences of their own.
    part = lambda x: F.exists("__blocks", lambda y: (x["line"] >= y["line"]) & (x["line"] <= y["last"]) & (x["family"] == y["family"]))
    single = F.filter("__alone", lambda x: (x["none"] < 0.5) & (sure(x) | ~part(x)))
    found = F.transform(
        F.array_sort(F.concat(single, F.col("__blocks"))),
        lambda x: F.struct(x["line"].alias("line"), F.when(sure(x), x["family"]).otherwise("unknown").alias("family"), F.round(x["p"], 6).alias("p"), F.round(x["share"], 6).alias("share")),
    )
    kind = "array<struct<line:int,family:string,p:double,share:double>>"
    return blocks.select(*keep, "n_paragraphs", F.coalesce(found, F.array().cast(kind)).alias("found"))


def scan(docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Per document: n_paragraphs, n_licensed, n_unknown, families, and line:family of each licence paragraph."""
    found = paragraphs(docs, fit(docs, max_rows))
    unknown = F.size(F.filter("found", lambda x: x["family"] == "unknown")).cast("long")
    names = F.array_remove(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"]))), "unknown")
    return found.select(
        "doc_id", "n_paragraphs", (F.size("found") - unknown).cast("long").alias("n_licensed"), unknown.alias("n_unknown"),
        F.array_join(names, ",").alias("families"),
        F.array_join(F.transform("found", lambda x: F.concat(x["line"].cast("string"), F.lit(":"), x["family"])), ",").alias("lines"),
    )
