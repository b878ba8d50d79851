"""License scans. DataFrame functions only.

Windows of a file's terms are compared with licence statements, from one line to a whole
licence text, by the cosine of sparse TF-IDF vectors over the statements' terms. Document
frequencies come from all files; other words have no weight, so neither a name in a header
nor a larger table hides a statement. Tags of the form ``SPDX-License-Identifier: X`` count
as they stand. A file's own licence is that of its best window. Licence files give their
licence to their directory, and a file without a licence of its own inherits from the
nearest ancestor directory that has one.

A statement's heaviest terms serve as anchors: a window that holds none of them cannot
reach the similarity, because they carry more than 1 - t^2 of its squared length. So a
window is laid where an anchor stands, as the anchor stands in the statement, and is a
quarter longer at either end than the statement, for words put in.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleframe.session import durable

MIN_COSINE = 0.75
#: Terms that fewer than about one file in 1100 holds weigh alike, whatever the size of the table.
MAX_WEIGHT = 8.0
#: Statements of common licences and parts of their texts (fixed values).
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Apache License Version 2.0, January 2004 TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ),
    "MIT": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "MPL-2.0": ("This file is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0"),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("Released into the public domain under CC0 1.0",),
    "Unlicense": ("This is free and unencumbered software released into the public domain",),
    "Proprietary": ("All rights reserved",),
}
#: A tag and the expression it gives.
TAG = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9][A-Za-z0-9.-]*[A-Za-z0-9]\+?(?:[ \t]+(?:OR|AND|WITH)[ \t]+[A-Za-z0-9][A-Za-z0-9.-]*[A-Za-z0-9]\+?)*)"
#: Names of files whose licence holds for their directory (fixed values).
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|copyright|notice|unlicense)[^/]*$"
SPLIT = "[^a-z0-9]+"


def terms(text: str) -> list[str]:
    return [t for t in re.split(SPLIT, text.lower()) if t]


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPLIT), lambda t: t != "")


Statements = dict[str, tuple[str, ...]]


def inverse_frequencies(files: DataFrame, templates: Statements = TEMPLATES) -> dict[str, float]:
    """Smoothed inverse document frequency of the statements' terms over all files, ``MAX_WEIGHT`` at most."""
    wanted = sorted({t for texts in templates.values() for text in texts for t in terms(text)})
    held = files.select(F.array_intersect(_terms(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.array(*[F.lit(t) for t in wanted])).alias("t"))
    # One row per term of the templates, and the number of files. Outer explodes spare a second evaluation for emptiness.
    counted = held.select(F.explode_outer(F.concat("t", F.array(F.lit("")))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()
    seen = {r["t"]: r["n"] for r in counted}
    return {t: min(math.log((1 + seen.get("", 0)) / (1 + seen.get(t, 0))) + 1, MAX_WEIGHT) for t in wanted}


def template_vectors(idf: dict[str, float], templates: Statements = TEMPLATES) -> list[tuple[str, list[str], dict[str, float]]]:
    """Licence, terms and unit TF-IDF vector of every statement, by the licence's name."""
    out = []
    for name in sorted(templates):
        for text in templates[name]:
            own = terms(text)
            raw = {t: own.count(t) * idf[t] for t in sorted(set(own))}
            length = math.sqrt(sum(w * w for w in raw.values()))
            out.append((name, own, {t: w / length for t, w in raw.items()}))
    return out


def anchors(vector: dict[str, float], min_cosine: float = MIN_COSINE) -> list[str]:
    """The fewest heavy terms of a statement that together exceed 1 - t^2 of its squared length."""
    found, share = [], 0.0
    for t, w in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
        found.append(t)
        share += w * w
        if share > 1 - min_cosine**2 + 1e-12:
            break
    return found


def slack(own: list[str]) -> int:
    """Terms that a window has more than its statement at either end."""
    return 1 + len(own) // 4


def places(vectors: list[tuple[str, list[str], dict[str, float]]], min_cosine: float = MIN_COSINE) -> dict[str, list[tuple[int, int]]]:
    """Per anchor the statements it stands for: number, and terms of the window before the anchor."""
    out: dict[str, list[tuple[int, int]]] = {}
    for k, (_, own, vector) in enumerate(vectors):
        for t in anchors(vector, min_cosine):
            out.setdefault(t, []).append((k, own.index(t) + slack(own)))
    return out


def statements(files: DataFrame, key: str, templates: Statements = TEMPLATES, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(key, place, licence, score) of every window that reaches ``min_cosine`` and of the first tag.

    ``place`` is the number of terms before the window, -1 for a tag, whose score is 1.
    """
    idf = inverse_frequencies(files, templates)
    vectors = template_vectors(idf, templates)
    laid = places(vectors, min_cosine)
    pattern = r"(?i)(?<![a-z0-9])(" + "|".join(map(re.escape, sorted(laid))) + r")(?![a-z0-9])"
    near = files.where(F.col("text").rlike(pattern)).select(key, _terms(F.col("text").cast("string")).alias("t"))
    # The terms are read as a whole column; only their windows become rows.
    hits = F.filter(F.transform("t", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda z: z["x"].isin(sorted(laid)))
    table = F.create_map(*[v for t in sorted(laid) for v in (F.lit(t), F.array(*[F.struct(F.lit(k).alias("k"), F.lit(back).alias("back")) for k, back in laid[t]]))])
    # Several anchors may lay one window: it is named by one number, so that repeats are cut by hash.
    named = F.transform(hits, lambda z: F.transform(F.element_at(table, z["x"]), lambda w: (z["i"] - w["back"]).cast("long") * len(vectors) + w["k"]))
    sizes = F.array(*[F.lit(len(own) + 2 * slack(own)) for _, own, _ in vectors])

    def window(code: Column) -> Column:
        k, first = F.pmod(code, F.lit(len(vectors))).cast("int"), F.floor(code / len(vectors)).cast("int")
        start = F.greatest(first, F.lit(0))
        return F.struct(k.alias("k"), first.alias("first"), F.slice("t", start + 1, F.greatest(first + sizes[k] - start, F.lit(0))).alias("own"))

    windows = F.transform(F.array_distinct(F.flatten(named)), window)
    each = near.select(key, F.explode_outer(windows).alias("w")).select(key, "w.k", "w.first", F.filter("w.own", lambda x: x.isin(sorted(idf))).alias("own"))
    counted = F.transform(F.array_distinct("own"), lambda x: F.struct(x.alias("term"), F.size(F.filter("own", lambda y: y == x)).alias("tf")))
    held = each.select(key, "k", "first", F.explode_outer(counted).alias("c")).select(key, "k", "first", "c.term", "c.tf")
    # As many rows as the statements have terms.
    weights = files.sparkSession.createDataFrame([(t, idf[t], [vector.get(t, 0.0) for _, _, vector in vectors]) for t in sorted(idf)], "__t string, idf double, own array<double>")
    weighted = held.join(F.broadcast(weights), held["term"] == weights["__t"]).withColumn("w", F.col("tf") * F.col("idf"))
    scored = weighted.groupBy(key, "k", "first").agg(F.sum(F.col("w") * F.col("own")[F.col("k")]).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    names = F.array(*[F.lit(name) for name, _, _ in vectors])
    found = scored.select(key, F.greatest("first", F.lit(0)).alias("place"), names[F.col("k")].alias("licence"), F.round(F.col("dot") / F.col("length"), 9).alias("score")).where(F.col("score") >= min_cosine)
    tags = files.select(key, F.lit(-1).alias("place"), F.regexp_extract(F.col("text").cast("string"), TAG, 1).alias("licence"), F.lit(1.0).alias("score"))
    return found.unionByName(tags.where(F.col("licence") != ""))


def directory(path: Column) -> Column:
    """The directory of a path, empty for the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(path: Column) -> Column:
    """A directory and all above it, the top as an empty text."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(0), n), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def scan(files: DataFrame, is_licence_file: Column | None = None, templates: Statements = TEMPLATES, min_cosine: float = MIN_COSINE) -> DataFrame:
    """id, path, licence, source ('own' or 'inherited', null if none), score and from_path of every row of (id, path, text).

    ``is_licence_file`` tells which files speak for their directory; by default their
    name does. Of several windows or files the best score counts, then the first place or
    path, then the licence's name. Null or empty texts
    have no licence of their own; a file with a null path inherits nothing and gives
    nothing. Rows that repeat id, path and text are returned as often as they occur.
    Empty path segments are ignored.
    """
    own = files.select("id", F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"), (F.col("path").rlike(LICENCE_FILE) if is_licence_file is None else is_licence_file).alias("speaks"))
    own = own.withColumn("key", F.xxhash64("id", F.coalesce("path", F.lit("")), F.col("id").isNull(), F.col("path").isNull(), "text"))
    found = durable(statements(own.select("key", "text").where("text is not null"), "key", templates, min_cosine), "licences")
    rank = F.struct((-F.col("score")).alias("s"), "place", "licence")
    best = found.groupBy(F.col("key").alias("k")).agg(F.min(rank).alias("b")).select("k", F.col("b.licence").alias("own"), (-F.col("b.s")).alias("score"))
    names = own.drop("text")
    known = durable(names.join(best, names["key"] == best["k"], "left").drop("k"), "files")
    known = known.withColumn("dir", F.array_join(F.filter(F.split(directory(F.col("path")), "/"), lambda p: p != ""), "/"))
    given = known.where("speaks and own is not null and path is not null").groupBy(F.col("dir").alias("from_dir"))
    given = given.agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "own")).alias("g")).select("from_dir", F.col("g.path").alias("from_path"), F.col("g.own").alias("given"), (-F.col("g.s")).alias("given_score"))
    dirs = known.where("path is not null").select("dir").distinct()
    climbed = dirs.select("dir", F.explode(ancestors(F.col("dir"))).alias("up"))
    # The nearest ancestor is the longest one that has a licence.
    found = climbed.join(given, climbed["up"] == given["from_dir"]).groupBy(F.col("dir").alias("d"))
    found = found.agg(F.max_by(F.struct("from_path", "given", "given_score"), F.length("up")).alias("f"))
    both = known.join(found, known["dir"] == found["d"], "left")
    return both.select(
        "id", "path",
        F.coalesce("own", "f.given").alias("licence"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("f.given").isNotNull(), "inherited").alias("source"),
        F.coalesce("score", "f.given_score").alias("score"),
        F.when(F.col("own").isNotNull(), F.col("path")).otherwise(F.col("f.from_path")).alias("from_path"),
    )
