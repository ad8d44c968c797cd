"""License scan in DataFrame expressions only: MinHash bands over overlapping windows retrieve templates, exact shingle
containment verifies them.

Texts become lower-case words without punctuation and hashes of their three-word shingles. For every size class
(a power of two, L shingles) windows of L shingles begin every L / 2 shingles, and a template of m shingles belongs to
the class with 2 m <= L < 4 m, so an occurrence lies whole inside some window, and covers at least a quarter of it. A
match of containment 0.8 then has a Jaccard similarity of 0.19 or more; with 48 bands of one MinHash each, it collides
in at least one band with probability 1 - 0.81 ** 48 > 0.9999. Candidates count if the window contains at least 0.8 of
the template's shingles.

Scale: one pass; texts without any template shingle, and windows with fewer of them than the least match of their class
has, can't match and leave before signatures are made.
Templates are fixed values, broadcast; what is shuffled is one row per matching window. Bands retrieve: a window meets
the templates with which it shares the least hash of some band, so that containment is computed for those alone.

Licenses that share most of their words (the GNU ones, BSD with two or three clauses, Creative Commons) are told apart
by words that a template can't lack, and a statement that a longer one contains doesn't count where that one is.

Edge cases: null and empty texts and texts of fewer than three words match nothing; a text may match several templates;
repeated rows give repeated results; an empty table gives an empty result; null ids are carried; other columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import saved, words

SHINGLE, BANDS, CONTAINED = 3, 48, 0.8

_CC = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
_CC_WORDS = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_GNU = "is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
RESERVED = "all-rights-reserved"

#: Statements of licenses, by SPDX name where there is one: notices, grants, and titles of full texts; with
#: each, runs of three words without which it is another license's. Names of no license are in small letters.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0", ()),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", ()),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", ()),
    ("MIT", "Released under the MIT License.", ()),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", ()),
    ("GPL-2.0-only", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", ("version 2 as", "gnu general public")),
    ("GPL-2.0-or-later", "This program " + _GNU.format("General Public License", 2), ("version 2 of", "gnu general public")),
    ("GPL-2.0-only", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", ("2 june 1991", "gnu general public")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public", "license version 3")),
    ("GPL-3.0", "This program " + _GNU.format("General Public License", 3), ("version 3 of", "gnu general public")),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", ("gnu general public", "29 june 2007")),
    ("LGPL-2.1-or-later", "This library " + _GNU.format("Lesser General Public License", 2.1), ("gnu lesser general", "version 21 of")),
    ("LGPL-2.1-only", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", ("gnu lesser general", "21 february 1999")),
    ("LGPL-3.0", "This library " + _GNU.format("Lesser General Public License", 3), ("gnu lesser general", "version 3 of")),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", ("gnu lesser general", "29 june 2007")),
    ("AGPL-3.0", "This program " + _GNU.format("Affero General Public License", 3), ("gnu affero general", "version 3 of")),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", ("gnu affero general", "19 november 2007")),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ()),
    ("BSD-2-Clause", _BSD_2, ("redistributions in binary",)),
    ("BSD-3-Clause", _BSD_2 + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ("names of its", "endorse or promote")),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software", ("person or organization",)),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ()),
    ("CC0-1.0", "CC0 1.0 Universal", ()),
    *((f"CC-{x}-4.0", f"Licensed under CC {x} 4.0.", ()) for x in _CC),
    *((f"CC-{x}-4.0", f"This work is licensed under a Creative Commons {'-'.join(_CC_WORDS[p] for p in x.split('-'))} 4.0 International License.", (f"commons {''.join(_CC_WORDS[p] for p in x.split('-')).lower()} 40",)) for x in _CC),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ("public license 20",)),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ()),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ()),
    ("MPL-2.0", "Mozilla Public License Version 2.0", ()),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", ()),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", ()),
    (RESERVED, "All rights reserved.", ()),
]


def plain_words(text: Column) -> Column:
    """Lower-case words; punctuation is dropped, words of nothing else vanish."""
    return words(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\s]+", ""))


def shingles(w: Column) -> Column:
    """Hashes of all runs of SHINGLE words, in order."""
    firsts = F.slice(w, 1, F.greatest(F.size(w) - (SHINGLE - 1), F.lit(0)))
    return F.transform(firsts, lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, SHINGLE))))


def signature(hashes: Column) -> Column:
    """(band, value) of every band: the least of the band's own hashes."""

    def band(b: int) -> Column:
        return F.struct(F.lit(b).alias("band"), F.array_min(F.transform(hashes, lambda x: F.xxhash64(x, F.lit(b)))).alias("value"))

    return F.array(*map(band, range(BANDS)))


def windows_of(h: Column, at: Column, length: int, least: int) -> Column:
    """(class, at, own): the runs of length shingles that begin at every half length and hold at least so many of the rising places at.

    Such a run begins at or before some place and ends after the place least - 1 further on; for each place two beginnings are possible.
    """
    half = length // 2

    def beginnings(p: Column, i: Column) -> Column:
        block = p - p % half
        return F.filter(F.array(F.greatest(block - half, F.lit(0)), block), lambda s: F.get(at, i + (least - 1)) < s + length)

    starts = F.array_distinct(F.flatten(F.transform(at, beginnings)))
    return F.transform(starts, lambda s: F.struct(F.lit(length).alias("class"), s.alias("at"), F.slice(h, s + 1, length).alias("own")))


def _templates(spark, templates) -> DataFrame:
    """(template, license, own, must, class): the distinct shingle hashes of each template, those that it can't lack, and the length of its windows."""
    table = spark.createDataFrame([(i, name, text, list(must)) for i, (name, text, must) in enumerate(templates)], "template int, license string, text string, needs array<string>")
    table = table.withColumn("w", plain_words(F.col("text"))).withColumns({"own": F.array_distinct(shingles(F.col("w"))), "must": F.transform("needs", lambda x: shingles(words(x))[0])})
    length = F.pow(F.lit(2), F.ceil(F.log2(2 * F.size("w") - 2 * (SHINGLE - 1)))).cast("int")
    return table.filter(F.size("own") > 0).select("template", "license", "own", "must", length.alias("class"))


def _outdone(known: DataFrame) -> DataFrame:
    """(inner, outer): licenses of which one's statement is nearly contained in a longer statement of the other. Fixed values."""
    a, b = known.alias("a"), known.alias("b")
    shared = F.size(F.array_intersect("a.own", "b.own"))
    pairs = a.join(F.broadcast(b), (F.col("a.license") != F.col("b.license")) & (F.size("a.own") < F.size("b.own")) & (shared >= CONTAINED * F.size("a.own")))
    return pairs.select(F.col("a.license").alias("inner"), F.col("b.license").alias("outer")).distinct()


def licenses(docs: DataFrame, templates=TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for every row of docs and license that it states: doc_id, license, contained (largest share), n_windows."""
    spark = docs.sparkSession
    known = _templates(spark, templates)
    rows = known.select("own", "class").collect()  # fixed values
    every = sorted({h for r in rows for h in r["own"]})
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), plain_words(F.col(f"`{text}`").cast("string")).alias("w"))
    own = own.select(F.monotonically_increasing_id().alias("row"), "doc_id", shingles(F.col("w")).alias("h"))
    # Places of shingles that some template has; texts without any can't match and leave. The number beside them keeps the
    # filter above, so that places aren't computed a second time for it.
    known_at = F.array_compact(F.transform("h", lambda x, i: F.when(x.isin(every), i)))
    own = own.select("row", "doc_id", "h", known_at.alias("known"), F.monotonically_increasing_id().alias("stays")).filter((F.size("known") > 0) & (F.col("stays") >= 0))
    # A match holds CONTAINED of some template of its class, so that many places at least.
    least = {n: math.ceil(CONTAINED * min(len(r["own"]) for r in rows if r["class"] == n)) for n in sorted({r["class"] for r in rows})}
    pieces = [windows_of(F.col("h"), F.col("known"), n, m) for n, m in least.items()]
    windows = own.select("row", "doc_id", F.explode(F.concat(*pieces)).alias("x")).select("row", "doc_id", "x.class", "x.at", "x.own")
    columns = ("row", "doc_id", "class", "at", "own", "window")
    banded = windows.withColumn("window", F.monotonically_increasing_id()).select(*columns, F.explode(signature(F.col("own"))).alias("s")).select(*columns, "s.band", "s.value")
    fields = ("template", "license", "t_own", "must", "t_class")
    retrieved = known.select("template", "license", F.col("own").alias("t_own"), "must", F.col("class").alias("t_class"), F.explode(signature(F.col("own"))).alias("t")).select(*fields, F.col("t.band").alias("t_band"), F.col("t.value").alias("t_value"))
    # Templates are fixed values: BANDS rows each.
    met = banded.join(F.broadcast(retrieved), (F.col("class") == F.col("t_class")) & (F.col("band") == F.col("t_band")) & (F.col("value") == F.col("t_value")))
    contained = F.size(F.array_intersect("own", "t_own")) / F.size("t_own")
    verified = met.withColumn("contained", contained).filter((F.col("contained") >= CONTAINED) & (F.size(F.array_except("must", "own")) == 0))
    # Few and narrow rows, written because they meet each other below: texts are read once.
    places = saved(verified.groupBy("row", "doc_id", "license", "window", "at", F.col("class").alias("length")).agg(F.max("contained").alias("contained")), "licenses")
    # The statement that a longer one contains doesn't count where that is; a reservation of rights not beside a license.
    outer = places.select(F.col("row").alias("o_row"), F.col("license").alias("outer"), F.col("at").alias("o_at"), F.col("length").alias("o_length"))
    longer = outer.join(F.broadcast(_outdone(known)), "outer").select("o_row", "inner", "o_at", "o_length")  # fixed values
    beside = outer.filter(F.col("outer") != RESERVED).select("o_row", F.lit(RESERVED).alias("inner"), F.col("o_at") - 32, F.col("o_length") + 64)
    hidden = (F.col("row") == F.col("o_row")) & (F.col("license") == F.col("inner")) & (F.col("at") < F.col("o_at") + F.col("o_length")) & (F.col("o_at") < F.col("at") + F.col("length"))
    stated = places.join(longer.unionAll(beside).toDF("o_row", "inner", "o_at", "o_length").distinct(), hidden, "left_anti")
    return stated.groupBy("row", "doc_id", "license").agg(F.max("contained").alias("contained"), F.count("*").alias("n_windows")).drop("row")
