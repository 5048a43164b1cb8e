"""License scans by MinHash bands over overlapping windows, with DataFrame functions only.

A text is its words (runs of letters and digits, lower-cased) and their shingles of three words; so is each template. A
template of n shingles is looked for with windows of w shingles, w the next of the sizes 2**(i / 2) from n on, that begin
at every max(1, w // 16)-th shingle. Each window and each template has BANDS MinHash values, a band each; a window
retrieves the templates of its size with which it shares a band. Every retrieved pair is then verified exactly: the part
of the template's shingles that stand in the window and w shingles to either side.

Guarantee: of a copy that holds 0.8 of the template's shingles within w shingles of the text, some window holds all but
w / 16 of them. With w < 1.42 n its similarity to the template is over 0.41, and all 24 bands miss it with a probability
of 0.59**24, below 4e-6.

A window shares a band with a template only if it holds the shingle that is the template's minimum in that band. So only
windows that hold one of these shingles (24 a template) are signed; nothing is lost by that. They are looked up in a hash
set, of ``block_templates`` templates at once; more templates are scanned for block by block.

The text never leaves its task; only matches are shuffled. Null and empty texts and templates match nothing; a text of
fewer than three words is one shingle. Equal rows give one result; equal license names are one license.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N, BANDS = 3, 24

#: License or notice, and a sentence of its public text.
TEMPLATES = [
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("mit", "Released under the MIT License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def shingles(words_col: str) -> Column:
    """Hashes of the runs of three words, in order. Takes a column's name: an expression would be computed for each word."""
    w = F.col(words_col)
    n = F.size(w)
    many = F.transform(F.sequence(F.lit(0), F.greatest(n - N, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(n > 0, many).otherwise(F.array().cast("array<bigint>"))


def window_size(n: Column) -> Column:
    return F.ceil(F.pow(F.lit(2.0), F.ceil(2 * F.log2(n) - 1e-9) / 2) - 1e-9).cast("int")


def signature(hashes: Column) -> Column:
    """The least value of each band."""

    def least(i: int) -> Column:
        return F.array_min(F.transform(hashes, lambda x: F.xxhash64(x, F.lit(i))))

    return F.array(*(least(i) for i in range(BANDS)))


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license string, text string")


def signed(templates: DataFrame) -> DataFrame:
    """license, t (its distinct shingles), w (its window size), sig, and least, the shingle of each band's minimum."""
    rows = templates.select("license", words(F.col("text")).alias("words")).withColumn("t", F.array_distinct(shingles("words"))).where(F.size("t") > 0)

    def least(i: int) -> Column:
        return F.array_min(F.transform("t", lambda x: F.struct(F.xxhash64(x, F.lit(i)).alias("v"), x.alias("x"))))["x"]

    return rows.select("license", "t", window_size(F.size("t")).alias("w"), signature(F.col("t")).alias("sig"), F.array(*(least(i) for i in range(BANDS))).alias("least")).distinct()


def _windows(w: int, own: list[int]) -> Column:
    """The windows of w shingles that hold one of the shingles own, from the columns h and hits."""
    step = max(1, w // 16)
    near = F.filter("hits", lambda i: F.get("h", i).isin(own))
    starts = F.flatten(F.transform(near, lambda i: F.sequence(F.ceil(F.greatest(i - (w - 1), F.lit(0)) / step).cast("int"), F.floor(i / step).cast("int"))))
    return F.transform(F.array_distinct(starts), lambda s: F.struct(F.lit(w).alias("w"), (s * step).alias("start")))


def scan(docs: DataFrame, templates: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, block_templates: int = 1000, *, keep) -> DataFrame:
    """doc_id, license, containment, first_word: for each document and license whose best containment reaches threshold,
    that containment and the least word at which its window begins. templates: license, text."""
    table = keep(signed(default_templates(docs.sparkSession) if templates is None else templates).withColumn("n", F.monotonically_increasing_id()), "templates")
    blocks = max(1, -(-table.count() // block_templates))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("same"), words(F.col(f"`{text_col}`")).alias("words"))
    parts = [_scan(rows, table.where(F.pmod(F.xxhash64("n"), F.lit(blocks)) == k) if blocks > 1 else table, threshold) for k in range(blocks)]
    found = reduce(DataFrame.unionByName, [p for p in parts if p is not None] or [_nothing(rows)])
    best = found.groupBy("doc_id", "same", "license").agg(F.max(F.struct("containment", (-F.col("start")).alias("s"))).alias("b"))
    return best.select("doc_id", "license", F.col("b.containment").alias("containment"), (-F.col("b.s")).cast("long").alias("first_word"))


def _nothing(rows: DataFrame) -> DataFrame:
    return rows.where(F.lit(False)).select("doc_id", "same", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).alias("start"))


def _scan(rows: DataFrame, templates: DataFrame, threshold: float) -> DataFrame | None:
    own = {r["w"]: sorted(set(r["x"])) for r in templates.groupBy("w").agg(F.flatten(F.collect_list("least")).alias("x")).collect()}  # of a block
    if not own:
        return None
    every = sorted({x for xs in own.values() for x in xs})
    rows = rows.select("doc_id", "same", shingles("words").alias("h"))
    # explode() stands for a filter that would be pushed below, and so compute the shingles twice
    rows = rows.select("doc_id", "same", F.explode(F.when(F.exists("h", lambda x: x.isin(every)), F.array("h"))).alias("h"))
    rows = rows.select("doc_id", "same", "h", F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda i: F.get("h", i).isin(every)).alias("hits"))
    rows = rows.select("doc_id", "same", "h", F.explode(F.concat(*(_windows(w, xs) for w, xs in sorted(own.items())))).alias("window"))
    inside = F.slice("h", F.col("window.start") + 1, F.col("window.w"))
    around = F.slice("h", F.greatest(F.col("window.start") - F.col("window.w"), F.lit(0)) + 1, F.col("window.w") * 3)
    rows = rows.select("doc_id", "same", F.col("window.w").alias("w"), F.col("window.start").alias("start"), inside.alias("inside"), around.alias("around"))
    rows = rows.select("doc_id", "same", "w", "start", "around", F.posexplode(signature(F.col("inside"))).alias("band", "value"))
    bands = templates.select("license", "t", "w", F.posexplode("sig").alias("band", "value"))
    found = rows.join(F.broadcast(bands), ["w", "band", "value"])  # of a block of templates
    share = F.size(F.array_intersect("around", "t")) / F.size("t")
    return found.withColumn("containment", share).where(F.col("containment") >= threshold).select("doc_id", "same", "license", "containment", "start")
