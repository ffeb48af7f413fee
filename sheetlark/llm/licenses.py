"""License scans in DataFrame functions only.

Every template has its own grid of overlapping windows: for n words, stride s = ceil(n / 4) and
length n + s - 1, so a window holds every occurrence in whole. A window with containment 0.75
or more then has a Jaccard similarity to the template of at least about a half. Each of
``BANDS`` bands is one minhash (xxhash64 seeded by the band), so such a window shares no band
with probability below 2^-BANDS, 2.4e-10 by default. Windows that share a band are verified:
distinct shingles of the window are intersected with the template's, exactly on 64-bit shingle
hashes, and kept at ``percent`` of the template's shingles. Notices of sibling licenses share most
of their shingles, so where several siblings fit in one place the one with the largest share is
told there (all of them on a tie).

A band can only be shared if the template's own least shingle of that band stands in the
window, so minhashes are computed for windows around such shingles alone; the others cannot
collide. Texts are split and hashed once in the scan, and what leaves it are short slices of
hashes: nothing is shuffled but the small result.

Words are compared in lower case (A-Z) and without the signs at their edges, and words of signs alone do not count: so
comment marks before the lines of a source file, quotes, and another last sign hide nothing. This holds for templates too.

Null and empty texts, and texts of fewer than five words, match nothing. Very long texts are
searched whole. Results are per id
and license, so rows that repeat an id share them, as rows with a null id do. An empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BANDS, PERCENT = 32, 75
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Notices as the licenses' own texts word them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
        "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
    ),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ),
}

#: Licenses whose notices differ in a word or two.
SIBLINGS: dict[str, tuple[str, ...]] = {"GNU": ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0")}
#: Windows that begin within so many words of each other are about one notice.
NEAR = 20


#: Signs that do not count at the edges of a word.
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”‘’«»–—…•·©®"


def _shingles(text: Column) -> Column:
    """Hashes of the 5-word shingles of a text, in order; none for fewer words."""
    bare = F.transform(F.split(F.translate(text, UPPER, LOWER), SPACE), lambda w: F.xxhash64(F.btrim(w, F.lit(EDGES))))
    words = F.filter(bare, lambda w: w != F.xxhash64(F.lit("")))  # each word is hashed once, shingles from the words' hashes
    hashed = F.transform(F.array(words), lambda w: F.when(F.size(w) >= 5, F.transform(F.sequence(F.lit(1), F.size(w) - 4), lambda i: F.xxhash64(*(F.get(w, i + j - 1) for j in range(5))))))
    return F.coalesce(F.get(hashed, F.lit(0)), F.array().cast("array<bigint>"))


def _band(shingles: Column, band: Column) -> Column:
    return F.array_min(F.transform(shingles, lambda x: F.xxhash64(band, x)))


def templates(spark: SparkSession, texts: dict[str, tuple[str, ...]]) -> DataFrame:
    """``(license, template, shingles, size, stride, length, bands)``; as many rows as templates."""
    rows = [F.struct(F.lit(name).alias("license"), F.lit(f"{name}/{i}").alias("template"), F.lit(text).alias("text")) for name, group in texts.items() for i, text in enumerate(group)]
    t = spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*").withColumn("h", _shingles(F.col("text")))
    n = F.size("h") + 4
    stride = F.ceil(n / 4).cast("int")
    bands = F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda k: F.struct(k.alias("k"), _band(F.col("h"), k).alias("m")))
    return t.where(F.size("h") > 0).select("license", "template", F.array_distinct("h").alias("shingles"), stride.alias("stride"), (n + stride - 1).alias("length"), bands.alias("bands"))


def scan(df: DataFrame, *, id: str = "doc_id", text: str = "text", texts: dict[str, tuple[str, ...]] | None = None, percent: int = PERCENT) -> DataFrame:
    """``(id, license, template, shared, size, first_word, n_windows)``: the best template of each license found in a text.

    ``first_word`` is where the first window that reaches ``shared`` begins.
    """
    spark = df.sparkSession
    known = templates(spark, texts or TEMPLATES)
    least = known.select("template", F.explode("bands").alias("b"), "shingles").select("template", F.explode(F.filter("shingles", lambda x: F.xxhash64(F.col("b.k"), x) == F.col("b.m"))).alias("h")).distinct()
    # one row per template: as small as the list above
    keys = sorted({r.h for r in least.collect()})
    reach = known.agg(F.max("length")).first()[0]
    wanted = F.lit(keys) if keys else F.array().cast("array<bigint>")
    # a one-row explode keeps the hashes from being worked out again wherever they are used
    hashed = df.select(F.col(id).alias("row_id"), F.explode(F.array(_shingles(F.col(text)))).alias("h"))
    found = hashed.select("row_id", "h", F.explode(F.array(F.array_intersect("h", wanted))).alias("hits")).where(F.size("hits") > 0)
    at = F.filter(F.transform("h", lambda x, i: F.when(F.array_contains(F.col("hits"), x), i)), lambda i: i.isNotNull())
    around = F.transform(at, lambda i: F.struct(i.alias("p"), F.get(F.col("h"), i).alias("h"), F.greatest(i - reach, F.lit(0)).alias("base"), F.slice(F.col("h"), F.greatest(i - reach, F.lit(0)) + 1, 2 * reach).alias("near")))
    # places are compared within one text, also where rows share an id
    spots = found.select("row_id", F.xxhash64("h").alias("text_key"), F.explode(around).alias("s")).select("row_id", "text_key", "s.*")
    grid = spots.join(F.broadcast(least), "h").join(F.broadcast(known), "template")
    low = F.greatest(F.lit(0), F.ceil((F.col("p") + 5 - F.col("length")) / F.col("stride"))).cast("int")
    window = grid.withColumn("j", F.explode(F.sequence(low, F.floor(F.col("p") / F.col("stride")).cast("int"))))
    first = F.col("j") * F.col("stride")
    window = window.withColumn("w", F.slice("near", first - F.col("base") + 1, F.col("length") - 4))
    collides = F.exists("bands", lambda b: _band(F.col("w"), b["k"]) == b["m"])
    shared = F.size(F.array_intersect("w", "shingles"))
    size = F.size("shingles")
    fit = window.where(collides).select("row_id", "text_key", "license", "template", "j", first.alias("first_word"), shared.alias("shared"), size.alias("size")).where(100 * F.col("shared") >= percent * F.col("size")).distinct()
    family = F.coalesce(*(F.when(F.col("license").isin(*members), name) for name, members in SIBLINGS.items()), "license")
    share, place = F.col("shared") / F.col("size"), Window.orderBy("first_word").rangeBetween(-NEAR, NEAR)
    own, most = (F.max(share).over(place.partitionBy("row_id", "text_key", key)) for key in ("license", family))
    fit = fit.withColumn("own", own).withColumn("most", most).where("own >= most")
    best = F.max(F.struct((F.col("shared") / F.col("size")).alias("share"), F.col("size"), (-F.col("first_word")).alias("f"), F.col("shared"), F.col("template")))
    return fit.groupBy("row_id", "license").agg(best.alias("m"), F.count("*").alias("n_windows")).select(
        F.col("row_id").alias(id), "license", F.col("m.template").alias("template"), F.col("m.shared").alias("shared"), F.col("m.size").alias("size"), (-F.col("m.f")).alias("first_word"), "n_windows"
    )


def sql_words(text: str) -> str:
    """SQL for the lower-cased words of a text."""
    return f"string_split_regex(trim(translate({text}, '{UPPER}', '{LOWER}'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{SPACE}')"


def _sql_bare_words(text: str) -> str:
    """SQL for the lower-cased words of a text without the signs at their edges."""
    return f"list_filter(list_transform(string_split_regex(translate({text}, '{UPPER}', '{LOWER}'), '{SPACE}'), lambda x: trim(x, '{EDGES.replace(chr(39), chr(39) * 2)}')), lambda x: x <> '')"


def oracle() -> str:
    """The same result in SQL, by counting shared shingles in every window."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ",\n".join(f"({quote(name)}, {quote(f'{name}/{i}')}, {quote(text)})" for name, group in TEMPLATES.items() for i, text in enumerate(group))
    shingles = "list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))"
    siblings = " ".join(f"WHEN license IN ({', '.join(map(quote, members))}) THEN {quote(name)}" for name, members in SIBLINGS.items())
    return f"""
WITH t(license, template, text) AS (VALUES {values}),
tw AS (SELECT license, template, {_sql_bare_words("text")} AS w FROM t),
ts AS (SELECT license, template, len(w) AS n, CAST(ceil(len(w) / 4.0) AS INT) AS stride, unnest(list_distinct({shingles})) AS s FROM tw),
tn AS (SELECT template, count(*) AS size FROM ts GROUP BY template),
dw AS (SELECT DISTINCT doc_id, md5(array_to_string(w, ' ')) AS text_key, w FROM (SELECT doc_id, {_sql_bare_words("text")} AS w FROM documents WHERE text IS NOT NULL)),
ds AS (SELECT doc_id, text_key, unnest({shingles}) AS s, generate_subscripts({shingles}, 1) - 1 AS p FROM dw WHERE len(w) >= 5),
hit AS (SELECT doc_id, text_key, license, template, n, stride, ds.s, p FROM ds JOIN ts USING (s)),
win AS (SELECT *, unnest(range(greatest(0, CAST(ceil((p + 5 - (n + stride - 1)) / CAST(stride AS DOUBLE)) AS BIGINT)), p // stride + 1)) AS j FROM hit),
cnt AS (SELECT doc_id, text_key, license, template, j * stride AS first_word, count(DISTINCT s) AS shared FROM win GROUP BY ALL),
fits AS (SELECT cnt.*, size, shared / CAST(size AS DOUBLE) AS share, CASE {siblings} ELSE license END AS family FROM cnt JOIN tn USING (template) WHERE 100 * shared >= {PERCENT} * size),
near AS (SELECT *, max(share) OVER (PARTITION BY doc_id, text_key, license ORDER BY first_word RANGE BETWEEN {NEAR} PRECEDING AND {NEAR} FOLLOWING) AS own,
  max(share) OVER (PARTITION BY doc_id, text_key, family ORDER BY first_word RANGE BETWEEN {NEAR} PRECEDING AND {NEAR} FOLLOWING) AS most FROM fits),
fit AS (SELECT * FROM near WHERE own >= most),
ranked AS (SELECT *, count(*) OVER (PARTITION BY doc_id, license) AS n_windows,
  row_number() OVER (PARTITION BY doc_id, license ORDER BY share DESC, size DESC, first_word, shared DESC, template DESC) AS r FROM fit)
SELECT doc_id, license, template, CAST(shared AS INT) AS shared, CAST(size AS INT) AS size, CAST(first_word AS INT) AS first_word, n_windows FROM ranked WHERE r = 1
"""
