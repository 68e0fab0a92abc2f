"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Only DataFrame and SQL functions are used. Texts and templates are shingles of
three words, cut into overlapping windows. A sieve of fixed size, one byte for
each of 2^20 hash values, lets through the shingles that some template may have
and a few others; it loses none, and keeps prose out of the MinHash. The bands of
a window of what is left meet the bands of the templates' windows, whose table is
joined, and a retrieved template counts if the text contains enough of its
shingles. Templates of a few shingles have too little to be alike to a window
beside others, so each of their shingles is a band of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .quality import let

# Usual notices of public licenses, and the texts of short ones.
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "ARR": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL": "This library is free software under the GNU Lesser General Public License.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "ISC-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Zlib-full": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
SHINGLE = 3
#: Words of a window, and how far apart windows begin.
WINDOW, STEP = 48, 24
#: Least share of a template's shingles that a text must contain.
CONTAINMENT = 0.8
#: Bands are retrieved with this chance from windows with this Jaccard similarity to a template's window: three shingles of it beside a full window of others.
LEAST_JACCARD, CHANCE = 0.06, 0.9999
#: Templates with so few shingles are retrieved by each of them.
FEW = 3
#: Places of the sieve.
SIEVE = 1 << 20
#: Rows of the band table that are sent to every executor at most; more are joined by shuffling.
BROADCAST_ROWS = 200_000


def bands_for(jaccard: float = LEAST_JACCARD, chance: float = CHANCE, rows: int = 1) -> int:
    """Bands of `rows` minima with which sets of that similarity share one with that chance."""
    return math.ceil(math.log(1 - chance) / math.log(1 - jaccard**rows))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: Column) -> Column:
    n = F.size(w) - SHINGLE
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))).otherwise(F.array().cast("array<bigint>"))


def bands(sets: Column, single: bool | Column = True) -> Column:
    """(band, value) of a set of shingles; where `single`, each shingle is one more, in band -1."""
    minima = lambda s: F.transform(F.sequence(F.lit(0), F.lit(bands_for() - 1)), lambda k: F.struct(k.alias("band"), F.array_min(F.transform(s, lambda h: F.xxhash64(h, k))).alias("value")))
    own = lambda s: F.transform(F.filter(s, lambda h: F.lit(single)), lambda h: F.struct(F.lit(-1).alias("band"), h.alias("value")))
    return let(sets, lambda s: F.concat(minima(s), own(s)))


def window_sets(hits: Column) -> Column:
    """(window, shingles) of the places of hits (place, shingle): window k has the places from k * STEP to k * STEP + WINDOW."""
    one = F.transform(hits, lambda h: F.floor(h["place"] / STEP).cast("int"))
    ids = F.array_distinct(F.concat(one, F.filter(F.transform(one, lambda k: k - 1), lambda k: k >= 0)))
    inside = lambda k: F.transform(F.filter(hits, lambda h: (h["place"] >= k * STEP) & (h["place"] < k * STEP + WINDOW)), lambda h: h["shingle"])
    return F.filter(F.transform(ids, lambda k: F.struct(k.alias("window"), F.array_distinct(inside(k)).alias("shingles"))), lambda x: F.size(x["shingles"]) > 0)


def sieve_of(shingles_of_all: list[int]) -> bytes:
    """A byte for each place of the sieve, 1 where a shingle of a template falls."""
    out = bytearray(SIEVE)
    for h in shingles_of_all:
        out[h % SIEVE] = 1
    return bytes(out)


def sieved(all_shingles: Column, sieve: bytes) -> Column:
    """(place, shingle) of the shingles that the sieve lets through."""
    there = lambda h: F.substring(F.lit(sieve), F.pmod(h, F.lit(SIEVE).cast("long")).cast("int") + 1, 1) == F.lit(b"\x01")
    return F.filter(F.transform(all_shingles, lambda h, i: F.struct(i.alias("place"), h.alias("shingle"))), lambda x: there(x["shingle"]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """Templates that texts of docs (doc_id, text) contain.

    Result, a row for each text and template: doc_id, license, containment (share
    of the template's shingles), first_word (place of the first of them, from 0).
    Texts without a match (null and empty ones too) have no row; repeated rows
    match as often as they come, so rows may repeat; an empty table gives no rows;
    other columns of docs are ignored. Templates of fewer than three words are
    refused. The shingles that make up the containment may lie anywhere in a text,
    in one window or in many.
    """
    spark, templates = docs.sparkSession, templates or TEMPLATES
    table = spark.createDataFrame(sorted(templates.items()), "license string, notice string")
    table = table.withColumn("_s", F.array_distinct(shingles(words(F.col("notice"))))).select("license", F.col("_s").alias("template"))
    known = table.collect()  # the templates are a parameter of this scan, whatever the documents are
    if not all(r.template for r in known):
        raise ValueError("a template needs three words")
    sieve = sieve_of([h for r in known for h in r.template])
    windows = table.select("license", "template", F.explode(window_sets(F.transform("template", lambda h, i: F.struct(i.alias("place"), h.alias("shingle"))))).alias("_w"))
    index = windows.select("license", "template", F.explode(bands(F.col("_w.shingles"), F.size("template") <= FEW)).alias("_b")).select("license", "template", "_b.band", "_b.value").distinct()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), let(let(words(text), shingles), lambda s: sieved(s, sieve)).alias("_hits"))
    found = found.where(F.size("_hits") > 0).withColumn("_row", F.monotonically_increasing_id())
    met = found.select("doc_id", "_row", "_hits", F.explode(window_sets(F.col("_hits"))).alias("_w")).select("doc_id", "_row", "_hits", F.explode(bands(F.col("_w.shingles"))).alias("_b"))
    small = sum(len(r.template) for r in known) * 2 * bands_for() <= BROADCAST_ROWS * STEP
    retrieved = met.join(F.broadcast(index) if small else index, (F.col("_b.band") == F.col("band")) & (F.col("_b.value") == F.col("value")))
    own = F.array_intersect(F.transform("_hits", lambda x: x["shingle"]), F.col("template"))
    first = F.array_min(F.transform(F.filter("_hits", lambda h: F.array_contains(F.col("template"), h["shingle"])), lambda h: h["place"])).cast("long")
    checked = retrieved.select("doc_id", "_row", "license", (F.size(own) / F.size("template")).alias("containment"), first.alias("first_word")).where(F.col("containment") >= containment)
    return checked.groupBy("_row", "license").agg(F.first("doc_id").alias("doc_id"), F.first("containment").alias("containment"), F.first("first_word").alias("first_word")).select(
        "doc_id", "license", "containment", "first_word"
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir, "doc_id", "text"))


def _sql_words(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def _sql_shingles(w: str) -> str:
    return f"list_transform(range(1, greatest(len({w}) - 1, 1)), lambda i: {w}[i] || ' ' || {w}[i + 1] || ' ' || {w}[i + 2])"


_VALUES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))
#: Containment of every template in every text, without bands.
OP8_SQL = f"""
WITH t AS (SELECT license, {_sql_words("notice")} AS w FROM (VALUES {_VALUES}) x(license, notice)),
ts AS (SELECT license, list_distinct({_sql_shingles("w")}) AS template FROM t),
d AS (SELECT doc_id, {_sql_words("coalesce(text, '')")} AS w FROM documents),
ds AS (SELECT doc_id, {_sql_shingles("w")} AS s FROM d),
p AS (SELECT doc_id, license, template, s, len(list_intersect(list_distinct(s), template)) / CAST(len(template) AS DOUBLE) AS containment FROM ds, ts)
SELECT doc_id, license, containment,
  CAST(list_min(list_filter(range(0, len(s)), lambda i: list_contains(template, s[i + 1]))) AS BIGINT) AS first_word
FROM p WHERE containment >= {CONTAINMENT}
"""
