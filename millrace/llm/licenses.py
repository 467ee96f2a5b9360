"""License scans with DataFrame functions only.

Words are runs of letters and digits, lower-cased; shingles are five words. A template of one to
four words is one shingle of its own length; shingles of each length have windows of their own. Templates fall into length classes, powers of two of
their number of shingles. For a class of length L a text is covered by overlapping windows of 2L shingles at
every L, so a passage of up to L + 1 shingles lies whole in one. A window is sketched by MinHash over the
shingles it shares with the dictionary (all templates' shingles): others cannot add to a containment.

A window that holds SHARE of a template's shingles has with it a Jaccard similarity of at least
SHARE * (L / 2) / (2L + (1 - SHARE) * L / 2), about 0.19. With BANDS bands of one row a template is missed
with a probability under (1 - 0.19) ** 96, two in a thousand million. Exact containment of shingle sets in the window
decides.

Nothing but matches is shuffled: shingles, windows, sketches and sets are arrays of the document's row.

Edge cases: null and empty texts match nothing. Templates that are null or have no
words match nothing. What stands between words is ignored: a short notice is found wherever its words follow each
other. Rows that repeat an id are reported together. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import settle

SHINGLE = 5  # words, or as many as a shorter template has
SHARE = 0.8
BANDS = 96

# Short license notices.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
           "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
           "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
           "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                  "compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
           "the following conditions are met:",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
               "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
               "option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
               "not distributed with this file, You can obtain one at",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved.",
    "mit-field": "License: MIT",
    "apache-2.0-field": "License: Apache-2.0",
    "bsd-3-clause-field": "License: BSD-3-Clause",
    "gpl-3.0-field": "License: GPL-3.0",
    "mit-spdx": "SPDX-License-Identifier: MIT",
    "isc-spdx": "SPDX-License-Identifier: ISC",
    "unlicense-spdx": "SPDX-License-Identifier: Unlicense",
    "apache-2.0-spdx": "SPDX-License-Identifier: Apache-2.0",
    "bsd-3-clause-spdx": "SPDX-License-Identifier: BSD-3-Clause",
    "gpl-3.0-spdx": "SPDX-License-Identifier: GPL-3.0",
    "mpl-2.0-spdx": "SPDX-License-Identifier: MPL-2.0",
}
WORDS = r"[\p{L}\p{N}]+"


def templates(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(list((TEMPLATES if texts is None else texts).items()), "license_id string, text string")


def hashed(text: Column) -> Column:
    """Hashes of the words, as an array."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0)), lambda w: F.xxhash64(w))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingles(h: Column, width: int) -> Column:
    """Hash of the `width` words from each word on, as an array; null if there are fewer words."""
    run = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(width))))
    return F.when(F.size(h) >= width, run)


def sketch(values: Column, bands: int) -> Column:
    """One minimum per band of the band's own hash."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)),
                       lambda b: F.array_min(F.transform(values, lambda v: F.xxhash64(v, b))))


def prepared(texts: DataFrame) -> DataFrame:
    """license_id, width (words of a shingle), class (length L) and the distinct shingles of each template."""
    found = texts.select("license_id", hashed(F.col("text")).alias("h")).where(F.size("h") > 0)
    own = F.coalesce(*(shingles(F.col("h"), w) for w in range(SHINGLE, 0, -1)))
    found = found.select("license_id", F.least(F.size("h"), F.lit(SHINGLE)).alias("width"), F.array_distinct(own).alias("wanted"))
    return found.withColumn("class", F.pow(F.lit(2), F.ceil(F.log2(F.size("wanted")))).cast("int"))


def windows(docs: DataFrame, known: dict[int, list[int]], lengths: dict[int, list[int]]) -> DataFrame:
    """(doc_id, width, class, first_word, held): windows with any shingle of the dictionary, and those they hold.
    known and lengths: the shingles and the classes of each width."""
    def hits(h: Column, width: int) -> Column:
        spots = F.transform(shingles(h, width), lambda v, i: F.struct(i.alias("at"), v.alias("v")))
        return F.struct(F.lit(width).alias("width"), F.array(*map(F.lit, lengths[width])).alias("classes"),
                        F.filter(spots, lambda x: x["v"].isin(known[width])).alias("hits"))

    per = F.explode(bound(hashed(F.col("text")), lambda h: F.array(*(hits(h, w) for w in sorted(known)))))
    rows = docs.select("doc_id", per.alias("x")).select("doc_id", "x.*").where(F.size("hits") > 0)
    rows = rows.select("doc_id", "hits", "width", F.explode("classes").alias("class"))
    block = lambda x: F.floor(x["at"] / F.col("class"))
    begins = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.array(block(x), block(x) - 1))))
    rows = rows.select("doc_id", "hits", "width", "class", F.explode(F.filter(begins, lambda b: b >= 0)).alias("b"))
    inside = F.filter("hits", lambda x: (x["at"] >= F.col("b") * F.col("class"))
                      & (x["at"] < (F.col("b") + 2) * F.col("class")))
    return rows.select("doc_id", "width", "class", (F.col("b") * F.col("class")).alias("first_word"),
                       F.array_distinct(F.transform(inside, lambda x: x["v"])).alias("held"))


def scan(docs: DataFrame, texts: DataFrame, share: float = SHARE, bands: int = BANDS) -> DataFrame:
    """(doc_id, license_id, containment, first_word, n_windows): the templates found in each document, the
    best containment and where the first window that reaches it begins, and the number of windows."""
    known = settle(prepared(texts), "templates")
    words: dict[int, list[int]] = {}  # of the dictionary
    lengths: dict[int, list[int]] = {}
    for r in known.select("width", F.explode("wanted").alias("v")).distinct().collect():
        words.setdefault(r["width"], []).append(r["v"])
    for r in known.select("width", "class").distinct().sort("width", "class").collect():
        lengths.setdefault(r["width"], []).append(r["class"])
    if not words:
        return docs.sparkSession.createDataFrame(
            [], "doc_id long, license_id string, containment double, first_word long, n_windows long")
    seen = windows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), words, lengths)
    banded = seen.select("*", F.posexplode(sketch(F.col("held"), bands)).alias("band", "low"))
    keys = known.select("license_id", "wanted", "width", "class",
                        F.posexplode(sketch(F.col("wanted"), bands)).alias("band", "low"))
    pairs = banded.join(keys, ["width", "class", "band", "low"])
    contained = (F.size(F.array_intersect("held", "wanted")) / F.size("wanted")).alias("containment")
    checked = pairs.select("doc_id", "license_id", "first_word", contained).where(F.col("containment") >= share)
    per = checked.groupBy("doc_id", "license_id", "first_word").agg(F.max("containment").alias("containment"))
    return per.groupBy("doc_id", "license_id").agg(
        F.max("containment").alias("containment"),
        F.min(F.struct(-F.col("containment"), F.col("first_word").alias("at")))["at"].alias("first_word"),
        F.count("*").alias("n_windows"))


def oracle(texts: dict[str, str] | None = None) -> str:
    """The same matches by exact containment of every window, without sketches."""
    quoted = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in
                       (TEMPLATES if texts is None else texts).items())
    def run(width: int) -> str:
        return " || ' ' || ".join(f"w[i + {k}]" for k in range(width))

    def every(table: str, key: str, keep: str) -> str:
        return " UNION ALL ".join(
            f"SELECT {key}, {k} AS width, i - 1 AS pos, {run(k)} s FROM (SELECT {key}, w, unnest(range(1, len(w) - {k} + 2)) i "
            f"FROM {table} WHERE {keep.format(k)})" for k in range(1, SHINGLE + 1))

    return f"""
WITH t(license_id, text) AS (VALUES {quoted}),
tw AS (SELECT license_id, regexp_extract_all(lower(text), '{WORDS}') w FROM t),
ts AS (SELECT DISTINCT license_id, width, s FROM ({every("tw", "license_id", f"least(len(w), {SHINGLE}) = {{}}")})),
tn AS (SELECT license_id, count(*) n, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) l FROM ts GROUP BY 1),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORDS}') w FROM documents),
ds AS ({every("dw", "doc_id", "len(w) >= {}")}),
hit AS (SELECT doc_id, pos, license_id, s, n, l FROM ds JOIN ts USING (width, s) JOIN tn USING (license_id)),
win AS (SELECT *, pos // l - o AS b FROM hit, (VALUES (0), (1)) v(o)),
per AS (SELECT doc_id, license_id, b * l AS first_word, count(DISTINCT s) / any_value(n) AS c
        FROM win WHERE b >= 0 GROUP BY doc_id, license_id, b, l HAVING count(DISTINCT s) / any_value(n) >= {SHARE})
SELECT doc_id, license_id, max(c) AS containment, arg_min(first_word, (-c, first_word)) AS first_word, count(*) AS n_windows
FROM per GROUP BY doc_id, license_id"""
