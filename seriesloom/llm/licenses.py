"""License scan with DataFrame functions alone: MinHash bands over overlapping windows, then exact containment.

Texts are split into words (A-Z lower-cased, common punctuation taken as space) and five-word shingles. A document is
cut into windows of six shingles that overlap by three, and each template into pieces of at most four, so a piece that
stands in a document lies whole in one window. Window and piece then have a similarity of at least (piece size) / 6;
bands are single minimum values, and there are as many as retrieve even a one-shingle template with the chance `recall`
from one window. A template that is shorter than a piece is looked up by its shingles' hashes as well, so that it can't be
missed. Retrieved (document, template) pairs are verified exactly: the share of the template's shingles, as text, that the
document holds.

The six hashes of a window are columns of a generated row and all minimum values are plain arithmetic on them, so the
search runs inside generated code. Templates stand in the plan as literals; more than a plan should hold are scanned for in
several passes. Windows that hit are gathered by document before they are shuffled, so a text moves once, however often it
repeats a license.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shingles of a window, the step from one window to the next, and shingles of a template's piece.
WINDOW, STEP, PIECE = 6, 3, 4
MASK = (1 << 31) - 1
_PUNCTUATION = "\t\n\x0b\x0c\r.,;:!?\"'()[]*"

#: Opening or identifying passages of common licenses, and the notices by which texts declare them.
TEMPLATES: dict[str, str] = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": 'you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "mit-notice": "Released under the MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
}


@dataclass(frozen=True)
class Settings:
    """percent: share of a template's shingles that a document has to hold. recall: chance that one window retrieves a
    template of one shingle. most_shingles: bound on the templates' shingles of one pass, since they stand in the plan; a
    longer template is refused."""

    percent: int = 80
    recall: float = 0.99
    most_shingles: int = 5_000

    @property
    def bands(self) -> int:
        return math.ceil(math.log(1 - self.recall) / math.log(1 - 1 / WINDOW))

    @property
    def factors(self) -> list[int]:
        """Odd multipliers; each gives an order of the 31-bit hashes, and a window's least value in it is a band."""
        r = random.Random(11)
        return [r.randrange(1, 1 << 31, 2) for _ in range(self.bands)]


def words(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.array_remove(F.split(F.translate(text, upper + _PUNCTUATION, upper.lower() + " " * len(_PUNCTUATION)), " "), "")


def _shingle(w: Column, i: Column) -> Column:
    """The 31-bit hash of the shingle at place i (from 0)."""
    return F.xxhash64(*(F.get(w, i + k) for k in range(5))).bitwiseAND(F.lit(MASK))


def template_shingles(spark: SparkSession, templates: dict[str, str], s: Settings) -> list[tuple[str, list[str], list[int]]]:
    """(name, shingles in order, their hashes) of each template; one of fewer than five words has none."""
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string").select("name", words(F.col("text")).alias("w")).filter(F.size("w") >= 5)
    at = F.sequence(F.lit(0), F.size("w") - 5)
    return [tuple(r) for r in rows.select("name", F.transform(at, lambda i: F.concat_ws(" ", F.slice("w", i + 1, 5))), F.transform(at, lambda i: _shingle(F.col("w"), i))).collect()]


def _value(h: Column, factor: int) -> Column:
    return (h * F.lit(factor)).bitwiseAND(F.lit(MASK))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, s: Settings | None = None) -> DataFrame:
    """doc_id, license, n_template, n_common, containment for each document and template that it holds to `percent`.

    Null texts and texts of fewer than five words hold nothing. Rows that repeat a doc_id count as one document, whose
    best row counts; rows without a doc_id are matched together under the null. Other columns are ignored, and an empty
    table gives an empty result.
    """
    s = s or Settings()
    out = docs.sparkSession.createDataFrame([], "doc_id long, license string, n_template long, n_common long, containment double")
    for part in _passes(TEMPLATES if templates is None else templates, s):
        out = out.unionByName(_scan(docs, part, s))
    return out


def _passes(templates: dict[str, str], s: Settings) -> list[dict[str, str]]:
    """The templates in parts of at most most_shingles words."""
    out: list[dict[str, str]] = []
    size = s.most_shingles + 1
    for name, text in sorted(templates.items()):
        n = len(text.split())
        if n > s.most_shingles:
            raise ValueError(f"template {name} is too long")
        if size + n > s.most_shingles:
            out.append({})
            size = 0
        out[-1][name] = text
        size += n
    return out


def _scan(docs: DataFrame, templates: dict[str, str], s: Settings) -> DataFrame:
    spark = docs.sparkSession
    found = template_shingles(spark, templates, s)
    factors = s.factors
    index: dict[int, set[str]] = {}  # band << 32 | value -> templates
    exact: dict[int, set[str]] = {}  # hash -> templates shorter than a piece
    for name, _, hashes in found:
        for i in range(0, len(hashes), PIECE):
            for b, f in enumerate(factors):
                index.setdefault(b << 32 | min(h * f & MASK for h in hashes[i : i + PIECE]), set()).add(name)
        for h in hashes if len(hashes) < PIECE else ():
            exact.setdefault(len(factors) << 32 | h, set()).add(name)
    if not index:
        return spark.createDataFrame([], "doc_id long, license string, n_template long, n_common long, containment double")
    # no filter on the words: it would be pushed below them and split every text twice
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", words(F.col("text")).alias("w"))
    places = F.when(F.size("w") >= 5, F.sequence(F.lit(0), F.size("w") - 5))
    hashed = rows.select("doc_id", "text", F.transform(places, lambda i: _shingle(F.col("w"), i)).alias("h"))
    zero = F.lit(0).cast("long")
    window = lambda i: F.struct(*(F.coalesce(F.get("h", i + k), F.get("h", i), zero).alias(f"h{k}") for k in range(WINDOW)))
    starts = F.when(F.size("h") > 0, F.sequence(F.lit(0), F.size("h") - 1, F.lit(STEP)))
    windows = hashed.select("doc_id", "text", F.inline(F.transform(starts, window)))
    least = [F.least(*(_value(F.col(f"h{k}"), f) for k in range(WINDOW))) for f in factors]
    hit = None
    for b, v in enumerate(least):
        one = v.isin(sorted(x & MASK for x in index if x >> 32 == b))
        hit = one if hit is None else hit | one
    for k in range(STEP if exact else 0):  # every shingle is among the first STEP of some window
        hit = hit | F.col(f"h{k}").isin(sorted(x & MASK for x in exact))
    # a lambda keeps this filter out of whole-stage code, where it would be one method too long to be compiled; outside,
    # Spark gives every band a method of its own. The lambda itself is true and only reached by windows that hit.
    hit = hit & F.exists(F.array("h0"), lambda x: x >= 0)
    # only for the few windows that hit a band, the templates are looked up
    entries = sorted((index | exact).items())
    table = F.map_from_arrays(F.array(*(F.lit(k).cast("long") for k, _ in entries)), F.array(*(F.array(*(F.lit(x) for x in sorted(v))) for _, v in entries)))
    keys = [F.lit(b << 32) + v for b, v in enumerate(least)] + [F.lit(len(factors) << 32) + F.col(f"h{k}") for k in range(STEP)]
    retrieved = F.array_distinct(F.flatten(F.filter(F.transform(F.array(*keys), lambda k: F.try_element_at(F.col("table"), k)), lambda x: x.isNotNull())))
    hits = windows.filter(hit).withColumn("table", table).select("doc_id", "text", F.xxhash64("text").alias("key"), F.explode(retrieved).alias("license"))
    pairs = hits.groupBy("doc_id", "key").agg(F.first("text").alias("text"), F.collect_set("license").alias("licenses"))
    own = F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda i: F.concat_ws(" ", F.slice("w", i, 5)))
    texts = F.create_map(*(x for name, t, _ in found for x in (F.lit(name), F.array(*(F.lit(y) for y in sorted(set(t)))))))
    split = pairs.select("doc_id", "licenses", words(F.col("text")).alias("w")).select("doc_id", "licenses", own.alias("own")).select("doc_id", "own", F.explode("licenses").alias("license"))
    counted = split.withColumn("t", F.element_at(texts, F.col("license"))).select("doc_id", "license", F.size("t").cast("long").alias("n_template"), F.size(F.array_intersect("t", "own")).cast("long").alias("n"))
    best = counted.groupBy("doc_id", "license", "n_template").agg(F.max("n").alias("n_common"))
    return best.filter(F.col("n_common") * 100 >= F.col("n_template") * s.percent).withColumn("containment", F.col("n_common") / F.col("n_template"))
