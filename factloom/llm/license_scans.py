"""License scans: MinHash bands over overlapping text windows retrieve templates, shingle containment verifies. DataFrame functions only.

Words are the runs of letters and digits of the lower-cased text. A template belongs to the widest class of windows of which one lies
wholly inside it wherever it stands in a text (class: width and step, see CLASSES); its own windows start at every word. A window's MinHash
has BANDS bands of ROWS minima over its five-word shingles: similarity 0.8 is retrieved with probability 1 - (1 - 0.8**ROWS)**BANDS =
0.999964, and a window that lies inside a text of the template equals one of the template's windows and is always retrieved. A template matches
where at least CONTAINMENT of its distinct shingles occur in the text around the window.

Only windows that share a shingle with some template are signed, as others have no minimum in common with any; shingles are looked at
only near anchors (every shingle of every template has an anchor word). Templates are a fixed list, given as a parameter; their bands (BOUND at most) are sent to all tasks. Documents are neither
shuffled nor grouped, but for the few windows that match.

Defined results: null or empty text matches nothing and has an empty array; a null doc_id stays (such rows are one document here); rows with one doc_id, also repeated ones, have their
matches together and are returned each; a text of any length is read whole; of two templates that fit the same words both are reported; a template of fewer than five words is an error; an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _blocks as B

SHINGLE, CONTAINMENT = 5, 0.8
BANDS, ROWS = 10, 2
#: (width, step): a template of at least width + step - 1 words has such a window inside.
CLASSES = ((16, 8), (8, 4), (5, 1))
BOUND = 200_000

#: Notices of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
#: Words too frequent to be anchors, unless a shingle has no other.
FREQUENT = frozenset("a above all an and any appear are as at be binary by copy copies following for form forms free from general if in include included including is it later list may met more must not obtain obtaining of one option or other person persons program provided public purpose required rights sell shall so source subject substantial terms that the this to under use version was whom with without work you your 0 2 3 4".split())
_WORDS = r"[^\p{L}\p{N}]+"


def _python_words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def _shingles(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]


def _class_of(n: int) -> int:
    return next((w for w, s in CLASSES if n >= w + s - 1), 0)


def anchors(templates: dict[str, str]) -> list[str]:
    """Words of which every shingle has one: the infrequent ones, else the shingle's longest."""
    left: dict[str, set[str]] = {}
    for text in templates.values():
        for s in _shingles(_python_words(text)):
            left[s] = {w for w in s.split() if w not in FREQUENT} or {max(s.split(), key=lambda w: (len(w), w))}
    #: Few are enough: take greedily those that stand in the most shingles.
    chosen: list[str] = []
    while left:
        best = max(sorted(set().union(*left.values())), key=lambda w: sum(w in v for v in left.values()))
        chosen.append(best)
        left = {s: v for s, v in left.items() if best not in s.split()}
    return sorted(chosen)


def _bands(words, start, width: int):
    """Band keys of the window of width words that starts at start (0-based)."""
    shingles = F.transform(F.sequence(F.lit(1), F.lit(width - SHINGLE + 1)), lambda i: F.array_join(F.slice(words, start + i, SHINGLE), " "))
    minimum = lambda s, j: F.array_min(F.transform(s, lambda x: F.xxhash64(F.lit(j), x)))
    return F.get(F.transform(F.array(shingles), lambda s: F.array(*(F.xxhash64(F.lit(f"{width}/{b}"), *(minimum(s, b * ROWS + r) for r in range(ROWS))) for b in range(BANDS)))), F.lit(0))


def _template_bands(spark, templates: dict[str, str]) -> DataFrame:
    """template, shingles array<string>, n words, band."""
    rows = [(k, w, _class_of(len(w))) for k, w in ((k, _python_words(t)) for k, t in sorted(templates.items()))]
    table = spark.createDataFrame([(k, w, list(dict.fromkeys(_shingles(w))), c) for k, w, c in rows], "template string, words array<string>, shingles array<string>, width int")
    if sum(len(w) * BANDS for _, w, _ in rows) > BOUND:
        raise ValueError(f"templates have more than {BOUND} bands")
    out = None
    for width, _ in CLASSES:
        part = table.filter(F.col("width") == width).withColumn("start", F.explode(F.sequence(F.lit(0), F.size("words") - width)))
        part = part.withColumn("band", F.explode(_bands(F.col("words"), F.col("start"), width))).select("template", "shingles", F.size("words").alias("n"), "band").distinct()
        out = part if out is None else out.union(part)
    return out


def matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, template, start (word of the first window), containment: the verified matches of docs (doc_id, text), one row for each document and template."""
    if short := sorted(k for k, t in templates.items() if len(_python_words(t)) < SHINGLE):
        raise ValueError(f"templates of fewer than {SHINGLE} words cannot be found: {short}")
    if not templates:
        raise ValueError("no templates")
    most = max(len(_python_words(t)) for t in templates.values())
    widest = max(w for w, _ in CLASSES)
    words = docs.select("doc_id", F.split(F.trim(F.regexp_replace(F.lower(F.col("text")), _WORDS, " ")), " ").alias("words"))
    anchor = anchors(templates)
    shared = sorted({x for t in templates.values() for x in _shingles(_python_words(t))})
    places = F.filter(F.transform("words", lambda w, i: F.when(w.isin(anchor), i)), lambda i: i.isNotNull())
    near = F.array_distinct(F.flatten(F.transform(F.col("at"), lambda p: F.sequence(F.greatest(p - SHINGLE + 1, F.lit(0)), p))))
    #: Places of shingles that some template has; a window without one has no minimum in common with any template.
    near = F.filter(near, lambda i: F.array_join(F.slice("words", i + 1, SHINGLE), " ").isin(shared))
    rows = words.withColumn("at", places).withColumn("at", near)
    starts = None
    for width, step in CLASSES:
        grid = F.array_distinct(F.flatten(F.transform(F.col("at"), _grid(width, step))))
        fits = F.transform(F.filter(grid, _fits(width)), _cut(width, most, widest))
        starts = fits if starts is None else F.concat(starts, fits)
    #: explode would add a filter on its array, which is pushed below and has the words cut twice; explode_outer adds none.
    windows = rows.select("doc_id", F.explode_outer(starts).alias("w")).filter(F.col("w").isNotNull()).select("doc_id", "w.*")
    keys = None
    for width, _ in CLASSES:
        keys = F.when(F.col("width") == width, _bands(F.col("around"), F.col("inside"), width)) if keys is None else keys.when(F.col("width") == width, _bands(F.col("around"), F.col("inside"), width))
    known = _template_bands(docs.sparkSession, templates)
    found = windows.withColumn("band", F.explode(keys)).join(F.broadcast(known), "band")
    here = F.transform(F.sequence(F.lit(1), F.greatest(F.size("around") - SHINGLE + 1, F.lit(1))), lambda i: F.array_join(F.slice("around", i, SHINGLE), " "))
    share = F.size(F.array_intersect("shingles", here)) / F.size("shingles")
    found = found.withColumn("containment", share).filter(F.col("containment") >= containment)
    return found.groupBy("doc_id", "template").agg(F.min("start").alias("start"), F.max("containment").alias("containment"))


def _grid(width, step):
    #: Starts of the grid's windows that hold the shingle at place p: multiples of step in [p + SHINGLE - width, p].
    return lambda p: F.sequence(F.greatest(F.ceil((p + SHINGLE - width) / step) * step, F.lit(0)).cast("int"), F.greatest(F.floor(p / step) * step, F.ceil((p + SHINGLE - width) / step) * step, F.lit(0)).cast("int"), F.lit(step))


def _fits(width):
    return lambda s: s + width <= F.size("words")


def _cut(width, most, widest):
    #: The window, and the words around it in which a template that it belongs to must lie.
    return lambda s: F.struct(
        s.cast("int").alias("start"), F.lit(width).alias("width"), F.slice("words", F.greatest(s - most, F.lit(0)) + 1, F.lit(2 * most + widest)).alias("around"), F.least(s, F.lit(most)).cast("int").alias("inside"))


def scanned(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, licenses array<struct<template, start, containment>> (by template) of each row of docs (doc_id, text)."""
    rows = B.own(docs, "doc_id", "text")
    found = matches(rows, templates).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("template", "start", F.round("containment", 6).alias("containment")))).alias("licenses"))
    ids = rows.select("doc_id")
    return ids.join(found.withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d")), "left").select("doc_id", F.coalesce("licenses", F.array().cast("array<struct<template:string,start:int,containment:double>>")).alias("licenses"))


def op10_license_scans(spark, sf_dir: str) -> DataFrame:
    """Every text of documents, scanned for the notices of TEMPLATES."""
    return scanned(B.table(spark, sf_dir, "documents"))
