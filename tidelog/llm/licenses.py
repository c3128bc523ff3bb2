"""License scans: sparse TF-IDF cosine of text units to license templates, then inheritance from the nearest directory.

Native DataFrame functions only. Units are the lines and the paragraphs of every whole text, and whole licence files. A
unit can only reach the threshold if it has one of the anchor terms, which are derived from the templates' weights; other
units are left out by one regular expression without losing a match.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import cut, small, take

#: The notices that the licences' publishers ask for, and their usual short forms. Of templates with equal
#: scores the first wins, so that a clause which only the stricter licence has stands before what both have.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
THRESHOLD = 0.7
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
#: Words that most English text has; they become anchors only if the other terms do not suffice.
COMMON = frozenset("a an and any are as at be by can do for from have if in is it may not of on or so that the this to was were will with you your".split())
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.-].*)?$"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = 4


class Vectors:
    """TF-IDF vectors of the templates: idf = ln((1 + n) / (1 + df)) + 1 over templates; unknown terms have df 0."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        tf = [(name, Counter(re.findall(TERM, text.translate(str.maketrans(UPPER, UPPER.lower()))))) for name, text in templates]
        df = Counter(t for _, c in tf for t in c)
        self.unknown = math.log(1 + len(tf)) + 1
        self.idf = {t: math.log((1 + len(tf)) / (1 + n)) + 1 for t, n in sorted(df.items())}
        self.rows: list[tuple[str, int, str, float]] = []  # term, template, license, weight / norm
        anchors = set()
        for i, (name, c) in enumerate(tf):
            w = {t: n * self.idf[t] for t, n in c.items()}
            norm = math.sqrt(sum(x * x for x in w.values()))
            self.rows += [(t, i, name, x / norm) for t, x in sorted(w.items())]
            rest = norm * norm
            for t in sorted(w, key=lambda t: (t in COMMON, -w[t] * len(t), t)):  # rare terms first, so that few other units have one
                if math.sqrt(max(rest, 0)) / norm < threshold:
                    break
                anchors.add(t)
                rest -= w[t] * w[t]
        self.anchors = sorted(anchors)
        self.anchor_regex = "(?i)(?<![a-z0-9])(?:" + "|".join(re.escape(a) for a in self.anchors) + ")(?![a-z0-9])"


def _table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table of literals, so that no Python rows reach the executors."""
    items = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names, strict=True)]) for r in rows])
    return spark.range(1).select(F.explode(items).alias("r")).select("r.*")


def _lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def parent(path: Column) -> Column:
    """The directory of a path: what stands before its last slash, else the root (empty)."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def scan(files: DataFrame, *, key: str = "doc_id", path: str = "path", text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """key, path, license, score, origin, origin_path for each row of files.

    origin `own`: the best unit of the file reaches the threshold (ties: the template that stands first). `inherited`: the
    nearest directory above it has a licence file with a license (of several: best score, then the path that sorts first).
    Else all null. Null and empty texts have no units, texts of any length are read whole; null paths are in no directory
    and inherit nothing. Repeated rows are all kept, an empty table gives an empty result, other columns are ignored.
    """
    v, spark = Vectors(templates, threshold), files.sparkSession
    rows = take(files, key=key, path=path, text=text).withColumn("path", F.col("path").cast("string"))
    base = F.regexp_extract("path", r"[^/]*$", 0)
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    paragraphs = F.filter(F.split(F.coalesce("text", F.lit("")), r"\n[ \t\r]*\n"), lambda p: F.instr(p, "\n") > 0)
    licence_file = F.coalesce(base.rlike(LICENCE_FILE), F.lit(False))
    units = F.concat(F.filter(lines, lambda x: x.rlike(v.anchor_regex)), F.filter(paragraphs, lambda x: x.rlike(v.anchor_regex)), F.when(licence_file, F.array(F.col("text"))).otherwise(F.array().cast("array<string>")))
    units = F.when(F.coalesce(F.col("text").rlike(v.anchor_regex), F.lit(False)), _reachable(units, v, threshold)).otherwise(F.array().cast("array<string>"))
    held = cut(rows.select(F.monotonically_increasing_id().alias("row"), "key", "path", licence_file.alias("licence_file"), units.alias("units")), "licenses")
    return _inherit(held, _best(held, v, spark, threshold))


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(_lower(text), F.lit(f"({TERM})"), 1)


def _reachable(units: Column, v: Vectors, threshold: float) -> Column:
    """The units whose terms hold enough of some template's vector: a cosine is at most the length of what is shared."""
    known = F.array(*[F.lit(t) for t in v.idf])
    by: dict[int, list[tuple[str, float]]] = {}
    for term, template, _, weight in v.rows:
        by.setdefault(template, []).append((term, weight * weight))

    def reach(shared: Column) -> Column:
        sums = [sum((F.when(F.array_contains(shared, t), w).otherwise(0.0) for t, w in terms), F.lit(0.0)) for terms in by.values()]
        return F.greatest(*sums) >= (threshold - 1e-3) ** 2

    held = F.transform(units, lambda t: F.struct(t.alias("t"), F.array_intersect(_terms(t), known).alias("s")))
    return F.transform(F.filter(held, lambda x: reach(x["s"])), lambda x: x["t"])


def _best(held: DataFrame, v: Vectors, spark: SparkSession, threshold: float) -> DataFrame:
    """row, license, score of the best unit that reaches the threshold."""
    vectors = _table(spark, v.rows, ["term", "template", "license", "weight"])
    idf = _table(spark, list(v.idf.items()), ["term", "idf"])
    terms = held.select("row", F.posexplode("units").alias("unit", "text")).select("row", "unit", F.explode(_terms(F.col("text"))).alias("term"))
    # Both tables hold the templates' terms only: their size is fixed by the templates.
    tf = terms.groupBy("row", "unit", "term").agg(F.count(F.lit(1)).alias("tf")).join(F.broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(v.unknown)))
    norms = tf.groupBy("row", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = tf.join(F.broadcast(vectors), "term").groupBy("row", "unit", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, ["row", "unit"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), DIGITS)).where(F.col("score") >= threshold)
    return scored.groupBy("row").agg(F.max_by("license", F.struct("score", -F.col("template"))).alias("license"), F.max("score").alias("score"))


def _inherit(held: DataFrame, best: DataFrame) -> DataFrame:
    own = held.drop("units").join(best, "row", "left").withColumn("dir", parent(F.col("path")))
    own = cut(own, "license-own")
    roots = own.where("licence_file and license is not null").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("low"), "path", "license")).alias("r")).select(F.col("dir").alias("above"), F.struct("r.license", (-F.col("r.low")).alias("score"), "r.path").alias("r"))
    # Every directory once, with all directories above it; the nearest one that has a license decides.
    dirs = own.where("license is null and path is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))))
    found = dirs.select("dir", F.posexplode(above).alias("depth", "above")).join(roots, "above").groupBy("dir").agg(F.max_by("r", "depth").alias("r"))
    # One row a directory: broadcast while its size allows; beyond that Spark splits a hot directory's rows.
    out = own.join(small(cut(found, "license-dirs")), "dir", "left")
    mine = F.col("license").isNotNull()
    named = F.col("r").isNotNull() & F.col("path").isNotNull()
    return out.select(
        "key", "path", F.coalesce("license", F.when(named, F.col("r.license"))).alias("license"), F.when(mine, F.col("score")).when(named, F.col("r.score")).alias("score"),
        F.when(mine, "own").when(named, "inherited").alias("origin"), F.when(mine, F.col("path")).when(named, F.col("r.path")).alias("origin_path"),
    )


def report(docs: DataFrame) -> DataFrame:
    """doc_id, path, license, score, origin, origin_path.

    The documents stand for a tree of sources and languages in which every eighth one is a licence file of its source, every
    eighth one of its language, and the others lie a directory deeper.
    """
    d = take(docs, doc_id="doc_id", text="text", source="source", lang="lang")
    name, source, lang = F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none"))
    turn = F.coalesce(F.pmod("doc_id", F.lit(8)), F.lit(1))
    path = F.when(turn == 0, F.concat(source, F.lit("/LICENSE-"), name)).when(turn == 4, F.concat(source, F.lit("/"), lang, F.lit("/COPYING-"), name))
    path = path.otherwise(F.concat(source, F.lit("/"), lang, F.lit("/"), turn.cast("string"), F.lit("/"), name, F.lit(".txt")))
    return scan(d.select("doc_id", path.alias("path"), "text")).withColumnRenamed("key", "doc_id")


def report_sql() -> str:
    """report() in DuckDB's SQL."""
    v = Vectors()
    vectors = ", ".join(f"('{t}', {i}, '{n}', {w!r}::DOUBLE)" for t, i, n, w in v.rows)
    idf = ", ".join(f"('{t}', {x!r}::DOUBLE)" for t, x in v.idf.items())
    lower = lambda x: f"translate({x}, '{UPPER}', '{UPPER.lower()}')"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, text, CASE coalesce(doc_id % 8, 1)
    WHEN 0 THEN coalesce(source, 'none') || '/LICENSE-' || doc_id
    WHEN 4 THEN coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/COPYING-' || doc_id
    ELSE coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || coalesce(doc_id % 8, 1) || '/' || coalesce(doc_id::VARCHAR, 'none') || '.txt' END AS path
  FROM documents),
p AS (SELECT r, doc_id, text, path, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_matches(regexp_extract(path, '[^/]*$'), '{LICENCE_FILE}') AS licence_file FROM d),
vec(term, template, license, weight) AS (VALUES {vectors}),
idf(term, idf) AS (VALUES {idf}),
units AS (
  SELECT r, 0 AS kind, generate_subscripts(u, 1) AS unit, unnest(u) AS t FROM (SELECT r, string_split(text, chr(10)) AS u FROM d)
  UNION ALL
  SELECT r, 1, generate_subscripts(u, 1), unnest(u) FROM (SELECT r, list_filter(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n'), lambda p: contains(p, chr(10))) AS u FROM d)
  UNION ALL
  SELECT r, 2, 1, text FROM p WHERE licence_file),
terms AS (SELECT r, kind, unit, unnest(regexp_extract_all({lower("t")}, '{TERM}')) AS term FROM units),
tf AS (SELECT r, kind, unit, term, count(*) * coalesce(any_value(idf), {v.unknown!r}::DOUBLE) AS w FROM terms LEFT JOIN idf USING (term) GROUP BY ALL),
norms AS (SELECT r, kind, unit, sqrt(sum(w * w)) AS norm FROM tf GROUP BY ALL),
scores AS (SELECT r, template, license, round(sum(w * weight) / any_value(norm), {DIGITS}) AS score FROM tf JOIN vec USING (term) JOIN norms USING (r, kind, unit) GROUP BY r, kind, unit, template, license),
best AS (SELECT r, license, score FROM scores WHERE score >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, template) = 1),
own AS (SELECT r, doc_id, path, dir, licence_file, license, score FROM p LEFT JOIN best USING (r)),
roots AS (SELECT dir AS above, license, score, path FROM own WHERE licence_file AND license IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, path) = 1),
above AS (SELECT DISTINCT dir, dir AS above, 2 AS depth FROM own UNION ALL SELECT DISTINCT dir, regexp_replace(dir, '/[^/]*$', ''), 1 FROM own UNION ALL SELECT DISTINCT dir, regexp_replace(regexp_replace(dir, '/[^/]*$', ''), '/[^/]*$', ''), 0 FROM own),
found AS (SELECT dir, license, score, path FROM above JOIN roots USING (above) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY depth DESC) = 1)
SELECT o.doc_id, o.path, coalesce(o.license, f.license) AS license, CASE WHEN o.license IS NOT NULL THEN o.score ELSE f.score END AS score,
  CASE WHEN o.license IS NOT NULL THEN 'own' WHEN f.license IS NOT NULL THEN 'inherited' END AS origin, CASE WHEN o.license IS NOT NULL THEN o.path ELSE f.path END AS origin_path
FROM own o LEFT JOIN found f USING (dir)
"""
