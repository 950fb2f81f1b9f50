"""License scans: notices found in texts by MinHash bands over overlapping windows."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import let
from .store import table

#: Notices looked for by default. Fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
}
N = 5


def normal(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9 \t-\r]+", "", text.lower()).split()


def bands_for(shingles: int, window: int, similarity: float, recall: float) -> int:
    """Bands of one row so that a window that holds the share `similarity` of a template meets it with probability `recall`."""
    shared = math.ceil(similarity * shingles)
    j = shared / (window - N + 1 + shingles - shared)
    return math.ceil(math.log(1 - recall) / math.log(1 - j))


def _shingles(words: Column) -> Column:
    n = F.size(words)
    return F.when(n >= N, F.transform(F.sequence(F.lit(1), n - (N - 1)), lambda i: F.xxhash64(F.slice(words, i, N)))).otherwise(F.array().cast("array<bigint>"))


def scan(
    docs: DataFrame, templates: dict[str, str] | None = None, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, recall: float = 0.999,
    max_templates: int = 2000,
) -> DataFrame:
    """One row per document and template found in it: id, template, containment, word (of the window, from 0), n_windows.

    A window with the share `similarity` or more of a template's 5-word shingles holds it. Words are lower-cased and lose
    all but a-z and 0-9. Templates of like length share windows of 1.5 times the longest's words, which overlap so that any
    run as long as the template lies wholly in one. Each window has as many MinHash values as bring the least similarity that such a window
    can have to a collision with probability `recall`; each is a band. A collision retrieves the template; shared shingles are
    then counted exactly.

    Texts that share no shingle with any template can't collide and get no windows. Null, empty and short texts yield nothing.
    Templates (at most max_templates, each of five words or more) are constants of the plan; all work stays within a row, without a shuffle,
    but for the last grouping of what was found.
    """
    templates = TEMPLATES if templates is None else templates
    if len(templates) > max_templates:
        raise ValueError(f"more than {max_templates} templates")
    spark = docs.sparkSession
    known = {k: normal(t) for k, t in templates.items()}
    if short := [k for k, w in known.items() if len(w) < N]:
        raise ValueError(f"templates of under {N} words: {short}")
    if not known:
        return docs.select(F.col(id_col), F.lit("").alias("template"), F.lit(0.0).alias("containment"), F.lit(0).alias("word"), F.lit(0).alias("n_windows")).where("false")
    hashed = _template_hashes(spark, known)
    vocabulary = F.array(*[F.lit(h) for h in sorted({h for hs in hashed.values() for h in hs})])

    text = F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^a-z0-9 \t-\r]+", "")
    # the filter repeats the expression, so what it needs more than once is bound within it
    split = F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), r"[ \t-\r]+")
    hashes = let(let(split, _shingles), lambda h: F.when(F.arrays_overlap(h, vocabulary), h))
    d = docs.select(F.col(id_col).alias("_id"), hashes.alias("_h")).where(F.col("_h").isNotNull())
    d = table(d, "candidates")  # few; each class of templates reads them again

    found = []
    classes: dict[int, list[str]] = {}
    for k, w in known.items():
        classes.setdefault(math.ceil(math.log(len(w), 1.5)), []).append(k)
    for names in classes.values():
        longest = max(len(known[k]) for k in names)
        width = longest + max(2, longest // 2)  # in words
        stride, across = width - longest + 1, width - N + 1  # in words, in shingles
        bands = max(bands_for(len(set(hashed[k])), width, similarity, recall) for k in names)
        sketch = lambda hs, bands=bands: F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda b: F.array_min(F.transform(hs, lambda h: F.xxhash64(h, b))))
        marks = {k: spark.range(1).select(sketch(F.array(*[F.lit(h) for h in hashed[k]])).alias("s")) for k in names}
        marks = {k: m.first()["s"] for k, m in marks.items()}
        starts = F.sequence(F.lit(0), F.greatest(F.size("_h") - F.lit(max(across - stride, 1)), F.lit(0)), F.lit(stride))
        w = d.select("_id", "_h", F.explode_outer(starts).alias("word")).withColumn("_win", F.slice("_h", F.col("word") + 1, across))
        w = w.where(F.arrays_overlap("_win", vocabulary)).withColumn("_s", sketch(F.col("_win")))
        hits = []
        for k in names:
            own = sorted(set(hashed[k]))
            collide = F.exists(F.zip_with("_s", F.array(*[F.lit(x) for x in marks[k]]), lambda a, b: a == b), lambda x: x)
            share = F.size(F.array_intersect("_win", F.array(*[F.lit(h) for h in own]))) / F.lit(float(len(own)))
            hits.append(F.when(collide, F.struct(F.lit(k).alias("template"), share.alias("containment"))))
        w = w.select("_id", "word", F.explode_outer(F.array(*hits)).alias("x"))
        found.append(w.select("_id", "word", "x.template", "x.containment").where(F.coalesce(F.col("containment") >= similarity, F.lit(False))))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    best = out.groupBy("_id", "template").agg(F.max("containment").alias("containment"), F.max_by("word", F.struct("containment", -F.col("word"))).alias("word"), F.count("*").cast("int").alias("n_windows"))
    return best.withColumnRenamed("_id", id_col)


def _template_hashes(spark: SparkSession, known: dict[str, list[str]]) -> dict[str, list[int]]:
    rows = spark.createDataFrame(list(known.items()), "k string, w array<string>").coalesce(1)
    return {r["k"]: r["h"] for r in rows.select("k", _shingles(F.col("w")).alias("h")).collect()}


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "template", "containment")


def _op2_sql() -> str:
    """Every document against every template: the share of its shingles that some window of the scan's width holds."""
    rows, classes = [], {}
    for k, t in TEMPLATES.items():
        classes.setdefault(math.ceil(math.log(len(normal(t)), 1.5)), []).append(k)
    for names in classes.values():
        longest = max(len(normal(TEMPLATES[k])) for k in names)
        width = longest + max(2, longest // 2)
        for k in names:
            w = normal(TEMPLATES[k])
            grams = sorted({" ".join(w[i : i + N]) for i in range(len(w) - N + 1)})
            rows += [f"('{k}', '{g}', {len(grams)}, {width - N + 1}, {width - longest + 1})" for g in grams]
    return rf"""
WITH t(template, gram, n, across, stride) AS (VALUES {", ".join(rows)}),
w AS (SELECT doc_id, string_split_regex(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9 \t-\r]+', '', 'g'), E' \t\n\x0b\f\r'), '[ \t-\r]+') AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS pos, len(w) - 4 AS n_grams, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
h AS (SELECT g.doc_id, g.pos, g.n_grams, t.* FROM g JOIN t USING (gram)),
x AS (SELECT *, unnest(range(greatest(0, (pos - across + stride) // stride * stride), pos + 1, stride)) AS word FROM h),
c AS (SELECT doc_id, template, word, count(DISTINCT gram) / n::DOUBLE AS containment FROM x
  WHERE word <= pos AND pos < word + across AND word <= greatest(n_grams - greatest(across - stride, 1), 0) GROUP BY doc_id, template, word, n)
SELECT doc_id, template, max(containment) AS containment FROM c WHERE containment >= 0.8 GROUP BY doc_id, template
"""


OP2_SQL = _op2_sql()
