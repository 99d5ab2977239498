"""Licences of documents: declared in the text, or inherited from the nearest directory above that has a licence file.

Lines, blocks of lines (headers and notices over several lines) and whole texts are compared with licence templates, from one-line
notices to full texts, by the cosine of their TF-IDF vectors. Texts whose words have too little of every template in common to reach the
threshold are out before. Of the others each distinct line, block and text is scored once: its terms meet the templates' in a hash join. A document is a licence file if its name says so, if its whole text is like a template, or if licence lines
hold half of its words. Directories then hand their licence down: a join of each directory's ancestors with the directories that have
one, deepest first.

Weights are whole thousandths, so that sums don't depend on their order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import let, stored

# What licence notices, headers and texts say, by SPDX identifier.
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
    "so, subject to the following conditions: "
)
_MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
    "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
    "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_TWO = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
    "the documentation and/or other materials provided with the distribution. "
)
_BSD_THREE = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission. "
)
_BSD_REST = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES."
)
_GNU_HEADER = (
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as "
    "published by the Free Software Foundation; either version {1} of the License, or (at your option) any later version."
)
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", _BSD_GRANT + _BSD_TWO + _BSD_REST),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD License"),
    ("BSD-3-Clause", _BSD_GRANT + _BSD_TWO + _BSD_THREE + _BSD_REST),
    ("CC-BY-4.0", "Licensed under CC BY 4.0 Creative Commons Attribution"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0 Creative Commons Attribution ShareAlike"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("GPL-2.0", "This program is free software under the terms of the GNU General Public License, version 2"),
    ("GPL-2.0", _GNU_HEADER.format("", "2")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", _GNU_HEADER.format("", "3")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", _GNU_HEADER.format("Lesser ", "3")),
    ("LicenseRef-proprietary", "All rights reserved"),
    ("MIT", "Released under the MIT License"),
    ("MIT", _MIT_GRANT),
    ("MIT", _MIT_GRANT + _MIT_REST),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name in sorted({name for name, _ in TEMPLATES})]

#: Words of any English text, which are no terms.
STOP_WORDS = "a an and any are as at be by for from in is it its not of on or shall such that the this to under was with you".split()

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FILE_NAMES = r"^(licen[cs]e|copying|notice)([._-].*)?$"


def terms(text: str) -> list[str]:
    """Runs of ASCII letters and digits, lower-cased, without stop words."""
    low = text.translate(str.maketrans(UPPER, LOWER))
    return [w for w in "".join(c if c in LOWER or c in "0123456789" else " " for c in low).split() if w not in STOP_WORDS]


@dataclass
class TermWeights:
    """Inverse document frequencies over the templates in thousandths, and each template's vector."""

    idf: dict[str, int]
    rare: int  # of terms that no template has
    vectors: list[tuple[str, dict[str, int]]]

    @classmethod
    def of(cls, templates: list[tuple[str, str]]) -> "TermWeights":
        n = len(templates)
        df: dict[str, int] = {}
        for _, text in templates:
            for t in sorted(set(terms(text))):
                df[t] = df.get(t, 0) + 1
        idf = {t: round(1000 * (math.log((1 + n) / (1 + c)) + 1)) for t, c in df.items()}
        vectors = []
        for name, text in templates:
            own = terms(text)
            vectors.append((name, {t: own.count(t) * idf[t] for t in dict.fromkeys(own)}))
        return cls(idf, round(1000 * (math.log(1 + n) + 1)), vectors)


def _lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _plain(text: Column) -> Column:
    """Lines of lower-case terms with one space between them."""
    return F.trim(F.regexp_replace(F.regexp_replace(_lower(text), "[^a-z0-9\n]+", " "), " *\n *", "\n"))


def _table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table of constants."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(r, names)]) for r in rows])))


def may_hold(words: Column, weights: TermWeights, threshold: float) -> Column:
    """Whether what has some words can be like a template at all: a cosine is no larger than the root of the share that the terms in common
    have of the template's squared weights."""
    every = F.array(*[F.lit(t) for t in sorted(weights.idf)])

    def enough(found: Column) -> Column:
        out = F.lit(False)
        for _, vector in weights.vectors:
            norm = sum(w * w for w in vector.values())
            share = F.create_map(*[F.lit(x) for t, w in vector.items() for x in (t, w * w / norm)])
            out = out | (F.aggregate(found, F.lit(0.0), lambda a, t: a + F.coalesce(F.try_element_at(share, t), F.lit(0.0))) >= threshold * threshold - 1e-9)
        return out

    return let(F.array_intersect(words, every), lambda found: F.when(F.size(found) > 0, enough(found)).otherwise(False))


def text_units(texts: DataFrame, weights: TermWeights, threshold: float) -> DataFrame:
    """`key, kind, words, total, u, terms` of those lines, blocks and wholes of `texts` (key, text) that may be like a template; `u` names
    the terms in their order."""
    plain = texts.select("key", _plain(F.col("text")).alias("plain"))
    unit = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("unit"))
    lines = F.transform(F.split("plain", "\n"), lambda x: unit("line", x))
    blocks = F.transform(F.filter(F.split("plain", "\n\n+"), lambda x: F.contains(x, F.lit("\n"))), lambda x: unit("block", x))
    words = lambda x: F.array_remove(F.split(x, "[ \n]+"), "")
    every = plain.select("key", F.size(words(F.col("plain"))).alias("total"), F.explode(F.concat(lines, blocks, F.array(unit("file", F.col("plain"))))).alias("x"))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    split = every.select("key", "total", "x.kind", words(F.col("x.unit")).alias("all")).select("key", "kind", "total", F.size("all").alias("words"), F.filter("all", lambda w: ~F.array_contains(stop, w)).alias("terms"))
    return split.where(may_hold(F.col("terms"), weights, threshold)).withColumn("u", F.xxhash64("terms"))


def similar_units(units: DataFrame, weights: TermWeights, threshold: float) -> DataFrame:
    """`u, match` (far, license) of each distinct unit that a template is like; of equals the first in name order."""
    spark = units.sparkSession
    idf = _table(spark, list(weights.idf.items()), ["term", "idf"])
    vectors = [(i, t, w) for i, (_, v) in enumerate(weights.vectors) for t, w in v.items()]
    posts = _table(spark, vectors, ["template", "term", "weight"])
    names = _table(spark, [(i, name, math.sqrt(sum(w * w for w in v.values()))) for i, (name, v) in enumerate(weights.vectors)], ["template", "license", "length"])
    each = units.select("u", "terms").dropDuplicates(["u"]).select("u", F.explode("terms").alias("term")).groupBy("u", "term").agg(F.count("*").alias("n"))
    # The tables of constants have as many rows as the templates have terms.
    weighed = each.join(F.broadcast(idf), "term", "left").select("u", "term", (F.col("n") * F.coalesce("idf", F.lit(weights.rare))).cast("double").alias("w"))
    lengths = weighed.groupBy("u").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("own"))
    dots = weighed.join(F.broadcast(posts), "term").groupBy("u", "template").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    near = dots.join(lengths, "u").join(F.broadcast(names), "template").select("u", F.round(F.col("dot") / (F.col("own") * F.col("length")), 4).alias("s"), "license")
    return near.where(F.col("s") >= threshold).groupBy("u").agg(F.min(F.struct((-F.col("s")).alias("far"), "license")).alias("match"))


def declared_licenses(docs: DataFrame, threshold: float = 0.6, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path") -> DataFrame:
    """`doc_id, path, license, similarity, is_file` of every row: the licence of the best line, block or whole, null under the threshold."""
    weights = TermWeights.of(templates)
    text = F.col(text_col)
    # A text is compared once, however many rows have it.
    held = docs.where(may_hold(F.split(F.lower(text), "[^a-z0-9]+"), weights, threshold)).select(F.xxhash64(text).alias("key"), text.alias("text")).dropDuplicates(["key"])
    units = stored(text_units(held, weights, threshold), "license-units")
    hits = units.join(similar_units(units, weights, threshold), "u")
    half = F.coalesce(2 * F.sum(F.when(F.col("kind") == "line", F.col("words"))) >= F.first("total"), F.lit(False))
    by_text = hits.groupBy("key").agg(F.min("match").alias("best"), (half | F.max(F.col("kind") == "file")).alias("whole"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.xxhash64(text).alias("key"))
    named = F.coalesce(_lower(F.element_at(F.split("path", "/"), -1)).rlike(FILE_NAMES), F.lit(False))
    is_file = F.col("best").isNotNull() & (F.coalesce("whole", F.lit(False)) | named)
    return rows.join(by_text, "key", "left").select("doc_id", "path", F.col("best.license").alias("license"), (-F.col("best.far")).alias("similarity"), is_file.alias("is_file"))


def _directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), F.lit("")))


def license_scan(docs: DataFrame, threshold: float = 0.6, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path") -> DataFrame:
    """One row per row of `docs`: `doc_id, path, declared, similarity, inherited_from, license`.

    `declared` is the licence of the text's best line, block of lines or whole (ties: first name), with its cosine to 4 places; null where
    none reaches the threshold, the text is null or empty. Texts of any length are compared whole. `license` is that or else the licence of the nearest directory at or above the document's own
    that has a licence file (of several files the most similar, then the first name); `inherited_from` names that directory. A null path
    inherits nothing; a path without `/` lies in the directory of the empty name, above all others. Ids may repeat or be null and other
    columns are ignored.
    """
    rows = stored(declared_licenses(docs, threshold, templates, id_col, text_col, path_col).withColumn("dir", _directory(F.col("path"))), "licenses")
    owners = rows.where("is_file and dir is not null").groupBy("dir").agg(F.min(F.struct((-F.col("similarity")).alias("far"), "license")).alias("x")).select(F.col("dir").alias("owner"), F.col("x.license").alias("handed"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))), lambda n: F.struct(n.alias("depth"), F.concat_ws("/", F.slice(parts, F.lit(1), n)).alias("owner")))
    # One row a directory and level, however many documents it holds.
    dirs = rows.where("dir is not null").select("dir").distinct().select("dir", F.inline(above))
    nearest = dirs.join(owners, "owner").groupBy("dir").agg(F.max(F.struct("depth", "owner", "handed")).alias("x")).select("dir", F.col("x.owner").alias("inherited_from"), F.col("x.handed").alias("handed"))
    out = rows.join(nearest, "dir", "left")
    own = F.col("license").isNotNull()
    return out.select("doc_id", "path", F.col("license").alias("declared"), "similarity", F.when(~own, F.col("inherited_from")).alias("inherited_from"), F.coalesce("license", "handed").alias("license"))


def duckdb_sql(rows: str, threshold: float = 0.6, templates: list[tuple[str, str]] = TEMPLATES) -> str:
    """The same result in DuckDB SQL, over a query `rows` with `doc_id, path, text`; weights are worked out from the templates' texts."""
    quoted = lambda x: x.replace("'", "''")
    given = ", ".join(f"({i}, '{quoted(name)}', '{quoted(text)}')" for i, (name, text) in enumerate(templates))
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    low = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    plain = lambda x: f"trim(regexp_replace(regexp_replace({low(x)}, '[^a-z0-9\\n]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), ' ')"
    words = lambda x: f"[w FOR w IN string_split(replace({x}, chr(10), ' '), ' ') IF w <> '']"
    return f"""
WITH given(i, name, text) AS (VALUES {given}), stop AS (SELECT [{stop}] AS ws),
tt AS (SELECT i, name, t, count(*) AS n FROM (SELECT i, name, unnest({words(plain("text"))}) AS t FROM given) WHERE NOT list_contains((SELECT ws FROM stop), t) GROUP BY ALL),
size AS (SELECT count(*)::DOUBLE AS n FROM given),
idf AS (SELECT t, round(1000 * (ln((1 + (SELECT n FROM size)) / (1 + count(*))) + 1)) AS w FROM tt GROUP BY t),
rare AS (SELECT round(1000 * (ln(1 + n) + 1)) AS w FROM size),
tv AS (SELECT i, name, t, tt.n * idf.w AS w FROM tt JOIN idf USING (t)),
tn AS (SELECT i, any_value(name) AS name, sqrt(sum(w * w)) AS length FROM tv GROUP BY i),
src AS (SELECT row_number() OVER () AS r, doc_id, path, text FROM ({rows})),
held AS (SELECT min(r) AS k, text, {plain("text")} AS plain FROM src WHERE text IS NOT NULL GROUP BY text),
cut AS (SELECT k, kind, unit FROM (SELECT k, 'line' AS kind, unnest(string_split(plain, chr(10))) AS unit FROM held)
  UNION ALL SELECT k, 'block', unit FROM (SELECT k, unnest(regexp_split_to_array(plain, '\n\n+')) AS unit FROM held) WHERE contains(unit, chr(10))
  UNION ALL SELECT k, 'file', plain FROM held),
un AS (SELECT row_number() OVER () AS u, k, kind, {words("unit")} AS ws FROM cut WHERE unit <> ''),
tf AS (SELECT u, t, count(*) AS n FROM (SELECT u, unnest(ws) AS t FROM un) WHERE NOT list_contains((SELECT ws FROM stop), t) GROUP BY ALL),
vec AS (SELECT u, tf.t, (tf.n * coalesce(idf.w, (SELECT w FROM rare)))::DOUBLE AS w FROM tf LEFT JOIN idf ON tf.t = idf.t),
norm AS (SELECT u, sqrt(sum(w * w)) AS own FROM vec GROUP BY u),
dot AS (SELECT u, i, sum(vec.w * tv.w) AS d FROM vec JOIN tv ON vec.t = tv.t GROUP BY u, i),
sim AS (SELECT u, name, round(d / (own * length), 4) AS s FROM dot JOIN norm USING (u) JOIN tn USING (i)),
best AS (SELECT u, name, s FROM sim WHERE s >= {threshold} QUALIFY row_number() OVER (PARTITION BY u ORDER BY s DESC, name) = 1),
hit AS (SELECT k, kind, len(ws) AS n, name, s FROM best JOIN un USING (u)),
total AS (SELECT k, len(ws) AS n FROM un WHERE kind = 'file'),
by_text AS (SELECT k, first(name ORDER BY s DESC, name) AS name, max(s) AS s, coalesce(2 * sum(hit.n) FILTER (kind = 'line') >= any_value(total.n), false) OR bool_or(kind = 'file') AS whole FROM hit JOIN total USING (k) GROUP BY k),
d AS (SELECT r, doc_id, path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') WHEN path IS NOT NULL THEN '' END AS dir, name, s,
  name IS NOT NULL AND (coalesce(whole, false) OR coalesce(regexp_matches({low("string_split(path, '/')[-1]")}, '{FILE_NAMES}'), false)) AS is_file
  FROM src LEFT JOIN held ON src.text = held.text LEFT JOIN by_text USING (k)),
owners AS (SELECT dir AS owner, name AS handed FROM d WHERE is_file AND dir IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY s DESC, name) = 1),
dirs AS (SELECT dir, depth, array_to_string(string_split(dir, '/')[1:depth], '/') AS owner FROM (SELECT dir, unnest(range(0, CASE WHEN dir = '' THEN 1 ELSE len(string_split(dir, '/')) + 1 END)) AS depth FROM (SELECT DISTINCT dir FROM d WHERE dir IS NOT NULL))),
nearest AS (SELECT dir, owner, handed FROM dirs JOIN owners USING (owner) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY depth DESC) = 1)
SELECT doc_id, path, name AS declared, s AS similarity, CASE WHEN name IS NULL THEN owner END AS inherited_from, coalesce(name, handed) AS license
FROM d LEFT JOIN nearest USING (dir)
"""
