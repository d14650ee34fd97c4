"""License scans (operator 1): MinHash bands over overlapping text windows, then exact shingle containment.

Windows hold a number of five-word shingles. A template is cut into all of its windows of the size class that its
length calls for; a text into every `step`-th. So a template that a text holds has a window in common with it, word for
word or nearly. BANDS minima of one row each retrieve it: where a pair of windows has the least similarity that the
containment threshold allows, 1 - (1 - similarity) ** BANDS is over 0.999. Everything is done within a row of the
documents, with no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contrastkit.llm.common import let

#: Words in a shingle, and the least containment of a template in a text.
SHINGLE, LEAST = 5, 0.8
#: (least shingles of a template, shingles in a window, step of a text's windows): a run of window + step - 1 shingles
#: holds a whole window of the text.
CLASSES = ((1, 1, 1), (7, 4, 4), (23, 16, 8))
#: Two sets with containment LEAST and equal size have this similarity at least.
SIMILARITY = LEAST / (2 - LEAST)
MISSED = 0.001
BANDS = math.ceil(math.log(MISSED) / math.log(1 - SIMILARITY))
MOST_TEMPLATES = 500

#: License notices (fixed values): (name, text).
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
)


def _words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")  # empty at the ends of some texts


def _hashes(words: Column) -> Column:
    """A hash of each shingle, in order."""
    one = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)])
    return F.when(F.size(words) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), one)).otherwise(F.array().cast("array<bigint>"))


def _constant(k: int) -> int:
    """The k-th of the numbers that hashes are xor-ed with to order them anew."""
    x = (k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    return (x ^ x >> 32) - (1 << 63)


def _bands(hashes: Column, classes: list[tuple[int, int]]) -> Column:
    """Band values of a text's windows: for each (window, step) the minima of each window. A window of one shingle has
    one band, its hash. A text shorter than a window is one window; the last window ends with the text."""

    def minima(orders: Column, window: int) -> Callable[[Column], Column]:
        return lambda p: F.array(*[F.array_min(F.slice(orders[k], p, F.lit(window))).bitwiseXOR(F.lit(_constant(100 * window + k))) for k in range(BANDS)])

    def anew(k: int) -> Callable[[Column], Column]:
        return lambda x: x.bitwiseXOR(F.lit(_constant(k)))

    def of(orders: Column, plain: Column) -> Column:
        out = []
        for window, step in classes:
            if window == 1:
                out.append(plain)
                continue
            last = F.greatest(F.size(plain) - window + 1, F.lit(1))
            starts = F.array_union(F.sequence(F.lit(1), last, F.lit(step)), F.array(last))
            out.append(F.flatten(F.transform(starts, minima(orders, window))))
        return F.concat(*out)

    def ordered(h: Column) -> Column:
        return let(F.array(*[F.transform(h, anew(k)) for k in range(BANDS)]), lambda o: of(o, h))

    plain_only = all(window == 1 for window, _ in classes)
    return let(hashes, lambda h: F.when(F.size(h) > 0, h if plain_only else ordered(h)).otherwise(F.array().cast("array<bigint>")))


def _class_of(shingles: int) -> tuple[int, int]:
    return next((window, step) for least, window, step in reversed(CLASSES) if shingles >= least)


def _shingles(words: Column) -> Column:
    """The distinct shingles as text."""
    joined = lambda i: F.array_join(F.slice(words, i, F.lit(SHINGLE)), " ")
    return F.when(F.size(words) >= SHINGLE, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - SHINGLE + 1), joined))).otherwise(F.array().cast("array<string>"))


def _prepared(spark: SparkSession, templates: tuple[tuple[str, str], ...]) -> list[tuple[str, list[str], list[int], tuple[int, int]]]:
    """(license, shingles, band values, window class) of each template that has a shingle."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    table = spark.createDataFrame(list(enumerate(templates)), "k int, t struct<license: string, text: string>").coalesce(1)
    table = table.withColumn("words", _words(F.col("t.text")))
    bands = F.lit(None).cast("array<bigint>")
    for least, window, _ in CLASSES:  # all of its windows
        bands = F.when(F.size("words") - SHINGLE + 1 >= least, _bands(_hashes(F.col("words")), [(window, 1)])).otherwise(bands)
    found = table.select("k", "t.license", _shingles(F.col("words")).alias("shingles"), F.array_distinct(bands).alias("bands"), (F.size("words") - SHINGLE + 1).alias("n")).orderBy("k").collect()
    return [(r["license"], r["shingles"], r["bands"], _class_of(r["n"])) for r in found if r["n"] > 0]


def license_scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(doc_id, template, license, shared, containment): templates of which a text holds the share LEAST or more.

    template is a number in the list, containment the share of its distinct shingles found in the whole text. Texts
    that are null or hold no license have no row; rows of docs that repeat are returned as often. Templates of fewer
    than SHINGLE words are never found, and more than MOST_TEMPLATES are an error, as they are part of the plan. A null
    doc_id stays null. Other columns of docs are not read. No rows in: no rows out.
    """
    known = _prepared(docs.sparkSession, templates)
    if not known:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).alias("template"), F.lit("").alias("license"), F.lit(0).alias("shared"), F.lit(0.0).alias("containment")).limit(0)
    classes = sorted({c for *_, c in known})
    every = sorted({b for _, _, bands, _ in known for b in bands})
    literal = lambda values, kind: F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")

    def verified(words: Column, hits: Column) -> Column:
        def checked(shingles: Column) -> Column:
            one = []
            for k, (name, own, bands, _) in enumerate(known):
                shared = F.when(F.arrays_overlap(hits, literal(bands, "bigint")), F.size(F.array_intersect(shingles, literal(own, "string")))).otherwise(F.lit(0))
                one.append(F.struct(F.lit(k).alias("template"), F.lit(name).alias("license"), shared.alias("shared"), F.lit(len(own)).alias("of")))
            return F.filter(F.array(*one), lambda x: x["shared"] >= F.lit(LEAST) * x["of"])

        return let(_shingles(words), checked)

    def scanned(words: Column) -> Column:
        hits = F.array_intersect(_bands(_hashes(words), classes), literal(every, "bigint"))
        return let(hits, lambda h: F.when(F.size(h) > 0, verified(words, h)))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), let(_words(F.coalesce("text", F.lit(""))), scanned).alias("found"))
    # kept as an outer generator: what is null goes behind it, so that the scan is not repeated as a filter before it
    rows = rows.select("doc_id", F.explode_outer("found").alias("x")).where(F.col("x").isNotNull())
    return rows.select("doc_id", "x.template", "x.license", "x.shared", (F.col("x.shared") / F.col("x.of")).alias("containment"))
