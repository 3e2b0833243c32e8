"""Operator 10 (native): licence scan of files by TF-IDF cosine, with directory inheritance.

A line of a text that names a licence at all (ANCHORS) begins headers: the line alone and with the
lines after it, in windows of WINDOWS lines; a licence file is also taken whole. Headers become
sparse term counts over the templates' vocabulary, weighted by inverse document frequency over the
whole corpus, and are compared to each template by cosine; the best template (first listed on a
tie) at or above the threshold is the file's own licence. Terms that no template has are not in
the vocabulary and drop out, as with any fitted vectoriser. Equal texts are scored once.

A file without a licence of its own inherits from the nearest ancestor directory that holds a
licence file with one (best score, then least path). Ancestors are joined by path, once for each
directory, not for each file.

Only the vocabulary's document frequencies, a fixed number of rows, come to the driver.

Defined results: null and empty texts have no licence of their own. A null path counts as a file
in the root directory and inherits from there only. Rows that repeat a path give a row each. Other
columns are carried along, but for those that have the name of a result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames

#: SPDX identifiers and the notices by which texts declare them.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", 'MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under the Creative Commons Attribution license, CC BY 4.0."),
    ("CC-BY-4.0", "SPDX-License-Identifier: CC-BY-4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: What a line or paragraph has to name to be a header.
ANCHORS = "licen[cs]e|copyright|permission is hereby|redistribution|public domain|free software"
#: Percent of a text's characters on lines that name a licence, from which op10 takes it for a licence file.
SHARE = 10
THRESHOLD = 0.8


def terms(text: str) -> list[str]:
    return [x for x in re.split("[^a-z0-9]+", text.lower()) if x]


COUNTS = [Counter(terms(t)) for _, t in TEMPLATES]
VOCABULARY = sorted(set().union(*COUNTS))


def words_sql(column: str) -> str:
    return f"split(translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+')"


#: Lines of a header, from one that names a licence on.
WINDOWS = (1, 2, 3, 5, 8, 12, 20)


def weights(files: DataFrame) -> list[tuple[str, float, list[float]]]:
    """(term, inverse document frequency, weight in each unit template vector) of the vocabulary; one scan."""
    vocabulary = "array(" + ", ".join(f"'{v}'" for v in VOCABULARY) + ")"
    # the empty term stands for the file itself
    found = F.explode(F.expr(f"array_append(array_intersect({vocabulary}, {words_sql("coalesce(text, '')")}), '')"))
    df = {r.term: r.n for r in files.select(found.alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    idf = [math.log((1 + df.get("", 0)) / (1 + df.get(v, 0))) + 1 for v in VOCABULARY]
    unit = []
    for c in COUNTS:
        v = [c[t] * w for t, w in zip(VOCABULARY, idf)]
        norm = math.sqrt(sum(x * x for x in v))
        unit.append([x / norm for x in v])
    return [(t, w, [u[j] for u in unit]) for j, (t, w) in enumerate(zip(VOCABULARY, idf))]


def best_templates(files: DataFrame, threshold: float) -> DataFrame:
    """(key, f, s, id): the best template at or above the threshold of each distinct text that names a licence."""
    table = files.sparkSession.createDataFrame(weights(files), "term string, idf double, w array<double>")  # the vocabulary: a fixed size
    own = f"filter(sequence(0, size(lines) - 1), i -> lower(lines[i]) rlike '{ANCHORS}')"
    windows = f"flatten(transform({own}, i -> transform(array_distinct(transform(array{WINDOWS}, w -> least(w, size(lines) - i))), w -> array_join(slice(lines, i + 1, w), ' '))))"
    units = (
        files.where("named")
        .select("key", F.col("is_licence_file").alias("f"), F.split("text", "\n").alias("lines"))
        .select("key", "f", F.expr(f"array_distinct(if(f, array_append({windows}, array_join(lines, ' ')), {windows}))").alias("units"))
        .groupBy("key", "f")
        .agg(F.first("units").alias("units"))
    )
    counts = (
        units.select("key", "f", F.posexplode("units").alias("u", "unit"))
        .select("key", "f", "u", F.explode(F.expr(words_sql("unit"))).alias("term"))
        .join(F.broadcast(table), "term")
        .groupBy("key", "f", "u", "term")
        .agg((F.count("*") * F.first("idf")).alias("x"), F.first("w").alias("w"))
    )
    dots = [F.sum(F.col("x") * F.col("w")[k]).alias(f"d{k}") for k in range(len(TEMPLATES))]
    scored = counts.groupBy("key", "f", "u").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), *dots)
    each = ", ".join(f"named_struct('s', round(d{k} / norm, 9), 'first', {-k}, 'id', '{t}')" for k, (t, _) in enumerate(TEMPLATES))
    best = scored.select("key", "f", F.expr(f"array_max(array({each}))").alias("best")).groupBy("key", "f").agg(F.max("best").alias("best"))
    return best.where(F.col("best.s") >= threshold - 1e-9).select("key", "f", "best.s", "best.id")


RESULTS = ["licence", "score", "how", "licence_path"]


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """files(path, is_licence_file, text, ...) with licence, score, how and licence_path added."""
    rest = [c for c in files.columns if c not in ("path", "is_licence_file", "text", *RESULTS)]
    named = F.coalesce(F.expr(f"lower(text) rlike '{ANCHORS}'"), F.lit(False))
    packed = files.select("path", F.coalesce("is_licence_file", F.lit(False)).alias("is_licence_file"), "text", F.struct(*rest).alias("extra") if rest else F.lit(None).alias("extra"), named.alias("named"))
    # texts that name no licence have keys that meet nothing, but are spread like the others
    packed = packed.withColumn("key", F.when(F.col("named"), F.md5("text")).otherwise(F.concat(F.lit("-"), F.xxhash64("path", "text").cast("string"))))
    best = frames.cut(best_templates(packed, threshold), "best")
    own = (
        packed.join(frames.broadcast_if_small(best.withColumnRenamed("f", "is_licence_file")), ["key", "is_licence_file"], "left")
        .withColumn("dir", F.expr("regexp_replace(coalesce(path, ''), '[^/]*$', '')"))
    )
    sources = own.where("is_licence_file and id is not null").groupBy(F.col("dir").alias("above")).agg(F.min(F.expr("struct(-s as s, path as path, id as id)")).alias("source"))
    dirs = own.where("id is null").select("dir").distinct()
    # every directory above, itself included: "a/b/" has "a/b/", "a/" and ""
    steps = "transform(sequence(0, size(split(dir, '/')) - 1), i -> if(i = 0, '', concat(array_join(slice(split(dir, '/'), 1, i), '/'), '/')))"
    nearest = dirs.select("dir", F.explode(F.expr(steps)).alias("above")).join(sources, "above").groupBy("dir").agg(F.max_by("source", F.length("above")).alias("source"))
    nearest = frames.cut(nearest, "nearest")
    return own.join(frames.broadcast_if_small(nearest), "dir", "left").select(
        "path",
        "is_licence_file",
        "text",
        *[F.col("extra").getField(c).alias(c) for c in rest],
        F.expr("coalesce(id, source.id)").alias("licence"),
        F.expr("if(id is null, null, round(s, 6))").alias("score"),
        F.expr("case when id is not null then 'own' when source is not null then 'inherited' else 'none' end").alias("how"),
        F.expr("case when id is not null then path else source.path end").alias("licence_path"),
    )


def op10(spark, sf_dir: str) -> DataFrame:
    """All of documents as files. The table has no paths, so a document stands at source/lang/block/id;
    one of whose characters SHARE percent stand on lines that name a licence is a licence file of source/lang."""
    docs = frames.table(spark, sf_dir, "documents")
    # most texts name no licence, and end with the first test
    share = f"coalesce(lower(text) rlike '{ANCHORS}' and 100 * aggregate(filter(split(text, '\\n'), x -> lower(x) rlike '{ANCHORS}'), 0L, (a, x) -> a + length(x)) >= {SHARE} * length(text), false)"
    files = docs.select("doc_id", "text", "source", "lang", F.expr(share).alias("is_licence_file"))
    end = F.expr("if(is_licence_file, concat('LICENSE-', coalesce(doc_id, '')), concat(coalesce(doc_id div 64, ''), '/', coalesce(doc_id, '')))")
    files = files.select("doc_id", "text", "is_licence_file", F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), end).alias("path"))
    return scan(files).select("doc_id", "path", "licence", "score", "how", "licence_path")


def _sql() -> str:
    templates = ", ".join(f"({i}, '{k}', {[c[t] for t in VOCABULARY]})" for i, ((k, _), c) in enumerate(zip(TEMPLATES, COUNTS)))
    words = "regexp_split_to_array(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+')"
    return f"""
WITH t(k, id, c) AS (VALUES {templates}), v AS (SELECT unnest({VOCABULARY}) AS v, unnest(range(1, {len(VOCABULARY) + 1})) AS j),
r AS (SELECT *, coalesce(regexp_matches(lower(text), '{ANCHORS}'), false) AS named, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
d AS (SELECT doc_id, coalesce(text, '') AS text, a, named, named AND 100 * coalesce(list_sum(list_transform(list_filter(a, lambda x: regexp_matches(lower(x), '{ANCHORS}')), lambda x: length(x))), 0) >= {SHARE} * length(text) AS f, coalesce(source, '') || '/' || coalesce(lang, '') || '/' AS top FROM r),
p AS (SELECT *, top || CASE WHEN f THEN '' ELSE (doc_id // 64) || '/' END AS dir, top || CASE WHEN f THEN 'LICENSE-' || doc_id ELSE (doc_id // 64) || '/' || doc_id END AS path FROM d),
w AS (SELECT DISTINCT doc_id, unnest({words.format('text')}) AS v FROM d),
i AS (SELECT v.v, j, ln((1 + (SELECT count(*) FROM d)) / (1 + count(w.doc_id))) + 1 AS idf FROM v LEFT JOIN w USING (v) GROUP BY 1, 2),
q AS (SELECT id, k, j, c[j] * idf AS x FROM t, i),
qn AS (SELECT k, sqrt(sum(x * x)) AS norm FROM q GROUP BY 1),
h AS (SELECT doc_id, a, i FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM p WHERE named) WHERE regexp_matches(lower(a[i]), '{ANCHORS}')),
l AS (SELECT doc_id, array_to_string(a[i:i + z - 1], ' ') AS line FROM (SELECT DISTINCT doc_id, a, i, least(z, len(a) - i + 1) AS z FROM h, (SELECT unnest({list(WINDOWS)}) AS z)) UNION ALL SELECT doc_id, array_to_string(a, ' ') FROM p WHERE f),
m AS (SELECT doc_id, row_number() OVER () AS n, line FROM l),
x AS (SELECT n, doc_id, unnest({words.format('line')}) AS v FROM m),
y AS (SELECT n, doc_id, j, count(*) * idf AS x FROM x JOIN i USING (v) GROUP BY n, doc_id, j, idf),
yn AS (SELECT n, sqrt(sum(x * x)) AS norm FROM y GROUP BY 1),
s AS (SELECT y.doc_id, y.n, q.k, q.id, round(sum(y.x * q.x) / any_value(yn.norm) / any_value(qn.norm), 9) AS s FROM y JOIN q USING (j) JOIN yn USING (n) JOIN qn USING (k) GROUP BY 1, 2, 3, 4),
b AS (SELECT doc_id, arg_max(id, (s, -k)) AS id, max(s) AS s FROM s GROUP BY 1),
o AS (SELECT p.doc_id, path, dir, top, f, CASE WHEN s >= {THRESHOLD} - 1e-9 THEN id END AS id, CASE WHEN s >= {THRESHOLD} - 1e-9 THEN s END AS s FROM p LEFT JOIN b USING (doc_id)),
z AS (SELECT top AS dir, arg_min(path, (-s, path)) AS path, arg_min(id, (-s, path)) AS id FROM o WHERE f AND id IS NOT NULL GROUP BY 1)
SELECT o.doc_id, o.path, coalesce(o.id, z.id) AS licence, round(o.s, 6) AS score, CASE WHEN o.id IS NOT NULL THEN 'own' WHEN z.id IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
  CASE WHEN o.id IS NOT NULL THEN o.path ELSE z.path END AS licence_path FROM o LEFT JOIN z ON z.dir = o.top
"""


SQL = _sql()
