"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory; native.

Every line and every paragraph of several lines that holds a term of licence talk is a candidate header; a text that
is one paragraph is compared as a whole. Tokens are weighted by the templates' inverse document frequency, tokens that no template has by the largest weight, and its cosine to each
template follows from a join with the templates' normalised weights. A licence file decides for its directory; a
document without a licence of its own takes that of the nearest directory above it.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

# Short headers of common licences, by SPDX identifier; SPDX lines of the same identifiers are added below.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the software without restriction."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted. Released under the BSD License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright; dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(name for name, _ in TEMPLATES)]
#: What parts paragraphs.
PARAGRAPH = r"\n[ \t\r]*\n"
#: A line without any of these is no header.
TALK = r"(?i)licen[cs]e|redistribut|public domain|permission is hereby|copyright|spdx"
TOKEN_BREAKS = r"[^a-z0-9]+"
MIN_COSINE, FILE_SHARE = 0.55, 0.5


def weights() -> list[tuple[int, str, str, float, float]]:
    """(template, licence, token, idf, unit weight): smooth idf over the templates, weights of unit length a template."""
    bags = [Counter(t for t in re.split(TOKEN_BREAKS, text.lower()) if t) for _, text in TEMPLATES]
    df = Counter(t for b in bags for t in b)
    idf = {t: round(math.log((1 + len(bags)) / (1 + n)) + 1, 9) for t, n in df.items()}
    out = []
    for i, ((name, _), bag) in enumerate(zip(TEMPLATES, bags)):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in bag.items()))
        out += [(i, name, t, idf[t], round(n * idf[t] / norm, 9)) for t, n in sorted(bag.items())]
    return out


def unknown_idf() -> float:
    return round(math.log((1 + len(TEMPLATES)) / 2) + 1, 9)


def headers(docs: DataFrame) -> DataFrame:
    """(key, line, block, line_id, n): distinct candidate lines of docs (key, text), and paragraphs of several lines (block)."""
    mark = lambda block: lambda x: F.struct(x.alias("line"), F.lit(block).alias("block"))
    lines = F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike(TALK)), mark(False))
    blocks = F.transform(F.filter(F.split("text", PARAGRAPH), lambda x: x.rlike(TALK) & x.contains("\n")), mark(True))
    return docs.filter(F.col("text").rlike(TALK)).select("key", F.explode(F.array_distinct(F.concat(lines, blocks))).alias("h")).select("key", "h.*", F.xxhash64("h.line", F.length("h.line")).alias("line_id"), F.length("h.line").alias("n"))


def score(lines: DataFrame) -> DataFrame:
    """(line_id, license, score) of the best template of each distinct line, whatever its score. lines: (line_id, line).

    Tokens carry the line's id, not its text, so a long paragraph costs no more than its distinct tokens.
    """
    spark = lines.sparkSession
    table = F.broadcast(spark.createDataFrame(weights(), "template int, license string, token string, idf double, unit double"))  # a few hundred rows
    tokens = lines.select("line_id", "line").dropDuplicates(["line_id"]).select("line_id", F.explode(F.filter(F.split(F.lower("line"), TOKEN_BREAKS), lambda t: t != "")).alias("token")).groupBy("line_id", "token").agg(F.count("*").alias("n"))
    idf = F.broadcast(spark.createDataFrame(sorted({(t, w) for _, _, t, w, _ in weights()}), "token string, idf double"))
    weighed = tokens.join(idf, "token", "left").withColumn("w", F.col("n") * F.coalesce("idf", F.lit(unknown_idf()))).select("line_id", "token", "w")
    norms = weighed.groupBy("line_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(table.select("template", "license", "token", "unit"), "token").groupBy("line_id", "template", "license").agg(F.sum(F.col("w") * F.col("unit")).alias("dot"))
    best = dots.groupBy("line_id").agg(F.max(F.struct("dot", (-F.col("template")).alias("t"), "license")).alias("b"))
    return best.join(norms, "line_id").select("line_id", F.col("b.license").alias("license"), F.round(F.col("b.dot") / F.col("norm"), 6).alias("score"))


def scan(docs: DataFrame, path: Column, file_share: float = FILE_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, path, license and score (own, null if none), inherited, inherited_from and effective.

    Own: the best header of cosine MIN_COSINE or more (ties by name). A document is its directory's licence file if
    it has a licence and its headers (all lines, or one paragraph) hold at least file_share of its characters, or its file name says so (LICENSE,
    COPYING, UNLICENSE); of several in a directory the best score, then the smallest name decides. Paths are
    slash-separated; a null path belongs to no directory and inherits nothing. Null and empty texts have no licence.
    Repeated rows repeat; other columns are ignored.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), path.alias("path"))
    d = d.withColumn("key", F.xxhash64("doc_id", "path", "text"))
    lines = common.stored(headers(d), "license-lines")
    scored = lines.select("key", "line_id", "block", "n").join(score(lines), "line_id").filter(F.col("score") >= MIN_COSINE)
    # A key's lines are those of equal rows; distinct before counting their characters.
    chars = F.greatest(F.sum(F.when(F.col("block"), 0).otherwise(F.col("n"))), F.max(F.when(F.col("block"), F.col("n")).otherwise(0)))
    own = scored.select("key", "line_id", "block", "n", "license", "score").distinct().groupBy("key").agg(F.max_by(F.struct("license", "score"), F.struct("score", "license")).alias("own"), chars.alias("chars"))
    own = common.stored(own, "license-own")
    base = d.select("doc_id", "path", "key", F.length("text").alias("n_chars"), F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", "([^/]*)$", 1).alias("file"))
    base = base.withColumn("dir", F.when(F.col("path").contains("/"), F.col("dir")).when(F.col("path").isNotNull(), F.lit("")))
    rows = base.join(own, "key", "left").select("doc_id", "path", "dir", "file", "n_chars", "chars", F.col("own.license").alias("license"), F.col("own.score").alias("score"))
    named = F.col("file").rlike(r"(?i)^(un)?licen[cs]e|^copying")
    decides = rows.filter("license is not null and dir is not null").filter(named | (F.col("chars") >= file_share * F.col("n_chars")))
    licensed = common.stored(decides.groupBy("dir").agg(F.min_by("license", F.struct(-F.col("score"), F.col("license"))).alias("inherited")), "license-dirs")
    # Ancestors of each distinct directory, itself first; the nearest licensed one wins.
    dirs = base.select("dir").filter("dir is not null").distinct().withColumn("parts", F.split("dir", "/"))
    up = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size("parts")), lambda k: F.array_join(F.slice("parts", 1, k), "/"))).alias("above")).distinct()
    near = up.join(licensed.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max_by(F.struct("inherited", F.col("above").alias("inherited_from")), F.length("above")).alias("near"))
    return rows.join(near, "dir", "left").select(
        "doc_id", "path", "license", "score",
        F.when(F.col("license").isNull(), F.col("near.inherited")).alias("inherited"),
        F.when(F.col("license").isNull(), F.col("near.inherited_from")).alias("inherited_from"),
        F.coalesce("license", "near.inherited").alias("effective"),
    )


#: Documents have no files; the query gives each a place by source, language and the hundreds of its id.
PATH = "concat(source, '/', lang, '/', cast(doc_id div 100 as string), '/', cast(doc_id as string), '.txt')"


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of documents by PATH; nulls, ties and repeats as in `scan`."""
    return scan(common.table(spark, sf_dir, "documents"), F.expr(PATH))


def oracle_sql() -> str:
    values = ", ".join(f"({i}, '{n}', '{t}', {w!r}, {u!r})" for i, n, t, w, u in weights())
    return rf"""
WITH tw(template, license, token, idf, unit) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, source || '/' || lang || '/' || CAST(doc_id // 100 AS VARCHAR) AS dir FROM documents),
ln AS (SELECT DISTINCT rid, line, block FROM (
         SELECT rid, unnest(string_split(text, chr(10))) AS line, false AS block FROM d
         UNION ALL SELECT rid, line, true FROM (SELECT rid, unnest(string_split_regex(text, '{PARAGRAPH}')) AS line FROM d) WHERE contains(line, chr(10))
       ) WHERE regexp_matches(line, '{TALK}')),
tk AS (SELECT line, token, count(*) AS n FROM (SELECT line, unnest(string_split_regex(lower(line), '{TOKEN_BREAKS}')) AS token FROM (SELECT DISTINCT line FROM ln)) WHERE token <> '' GROUP BY ALL),
wt AS (SELECT line, token, n * coalesce((SELECT max(idf) FROM tw WHERE tw.token = tk.token), {unknown_idf()!r}) AS w FROM tk),
nm AS (SELECT line, sqrt(sum(w * w)) AS norm FROM wt GROUP BY line),
dt AS (SELECT line, template, license, sum(w * unit) AS dot FROM wt JOIN tw USING (token) GROUP BY ALL),
bs AS (SELECT line, license, dot FROM dt QUALIFY row_number() OVER (PARTITION BY line ORDER BY dot DESC, template) = 1),
sc AS (SELECT line, license, round(dot / norm, 6) AS score FROM bs JOIN nm USING (line)),
ow AS (SELECT rid, arg_max(license, (score, license)) AS license, max(score) AS score, greatest(sum(CASE WHEN block THEN 0 ELSE length(line) END), max(CASE WHEN block THEN length(line) ELSE 0 END)) AS chars FROM ln JOIN sc USING (line) WHERE score >= {MIN_COSINE} GROUP BY rid),
r AS (SELECT d.rid, doc_id, dir, ow.license, ow.score, coalesce(chars, 0) >= {FILE_SHARE} * length(text) AND ow.license IS NOT NULL AS decides FROM d LEFT JOIN ow USING (rid)),
ld AS (SELECT dir, arg_min(license, (-score, license)) AS inherited FROM r WHERE decides GROUP BY dir),
nr AS (SELECT a.dir, arg_max(ld.inherited, length(ld.dir)) AS inherited, arg_max(ld.dir, length(ld.dir)) AS inherited_from
       FROM (SELECT DISTINCT dir FROM d) a JOIN ld ON a.dir = ld.dir OR starts_with(a.dir, ld.dir || '/') OR ld.dir = '' GROUP BY a.dir)
SELECT doc_id, dir || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, license, score,
       CASE WHEN license IS NULL THEN inherited END AS inherited, CASE WHEN license IS NULL THEN inherited_from END AS inherited_from, coalesce(license, inherited) AS effective
FROM r LEFT JOIN nr USING (dir)
"""


SQL = oracle_sql()
