"""Scan of texts for licences: Dice coefficient of word bigrams against templates.

Text is normalised to lower-case words. A whole text and each of its lines are compared
with each template by twice the shared distinct bigrams over the sum of both counts. A
coefficient of at least t needs bigram counts within a factor t / (2 - t) of each other,
so the counts rule most templates out; the templates are constants in the plan, and
nothing is shuffled.

Passages, which share their lines with other words or run over several lines, are sought
as well. A passage that reaches t holds at least t / (2 - t) of a template's bigrams, so
texts without one of a template's anchors, a few more than the bigrams that may be
missing, are left out first. In the rest each window of words that begins and ends with a
bigram of the template is compared; for templates of 32 bigrams and more the windows
begin with the first and end with the last such bigram of each sixteenth of its size.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spinledger.llm.common import materialize

# Notices and opening clauses of public licences.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "bsd-3-clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version."
    ),
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions."
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def complete_texts() -> dict[str, str]:
    """Whole licence texts by name, without the names of copyright holders."""
    return {path.stem: path.read_text("utf-8") for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def template_bigrams(text: str) -> list[str]:
    words = re.findall(r"[^\W_]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def usable(templates: dict[str, str]) -> dict[str, list[str]]:
    """The bigrams of each template that has any."""
    known = {name: template_bigrams(text) for name, text in templates.items()}
    return {name: grams for name, grams in known.items() if grams}


def pairs(text: Column) -> Column:
    """Word bigrams of a text in order, as hashes; a text of one word has none."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.xxhash64(a, b))


def bigrams(text: Column) -> Column:
    """Distinct word bigrams of a text, as hashes."""
    return F.array_distinct(pairs(text))


def hashes(spark: SparkSession, known: dict[str, list[str]]) -> dict[str, list[int]]:
    """The bigrams of each template as ``pairs`` hashes them."""
    split = [F.split(F.lit("\n".join(grams)), "\n").alias(name) for name, grams in known.items()]
    hashed = [F.transform(F.col(f"`{name}`"), lambda g: F.xxhash64(F.split(g, " ")[0], F.split(g, " ")[1])).alias(name) for name in known]
    return spark.sql("SELECT 1").select(*split).select(*hashed).first().asDict()


def constant(values: list[int]) -> Column:
    return F.split(F.lit(" ".join(map(str, values))), " ").cast("array<bigint>")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def best_template(grams: Column, hashed: dict[str, list[int]], near: float) -> Column:
    """Struct (dice, license, n_shared) of the nearest template; ties go to the smaller name."""
    size = F.size(grams)

    def compared(name: str) -> Column:
        n = len(hashed[name])
        within = (size >= n * near - 1e-9) & (size <= n / near + 1e-9)
        shared = F.size(F.array_intersect(grams, constant(hashed[name])))
        dice = 2 * shared / (size + n)
        return F.when(within, F.struct(dice.alias("dice"), F.lit(name).alias("license"), shared.alias("n_shared")))

    def better(best: Column, other: Column) -> Column:
        return F.when(best.isNull() | (other["dice"] > best["dice"]), other).otherwise(best)

    found = F.array(*[compared(name) for name in sorted(hashed)])
    start = F.lit(None).cast("struct<dice:double,license:string,n_shared:int>")
    return F.aggregate(found, start, lambda best, other: F.when(other.isNull(), best).otherwise(better(best, other)))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """Rows (doc_id, line, license, dice, n_shared): the best template of each line that reaches ``threshold``.

    Line -1 is the whole text, given where it has several lines. Ties go to the smaller
    name. Null and empty texts and lines of one word give nothing; repeated rows give
    repeated rows; a null id is kept; other columns are not read.
    """
    known = usable(TEMPLATES if templates is None else templates)
    schema = "doc_id bigint, line int, license string, dice double, n_shared int"
    if not known:
        return docs.sparkSession.createDataFrame([], schema)
    near = threshold / (2 - threshold)
    sizes = [len(grams) for grams in known.values()]
    hashed = hashes(docs.sparkSession, known)
    parts = F.split("text", "\n")
    units = F.transform(parts, lambda part, i: F.struct(i.alias("line"), part.alias("unit")))
    whole = F.when(F.size(parts) > 1, F.array(F.struct(F.lit(-1).alias("line"), F.col("text").alias("unit"))))
    both = F.concat(F.coalesce(whole, F.array().cast("array<struct<line:int,unit:string>>")), units)
    rows = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .filter(F.col("text").isNotNull())
        .select("doc_id", F.explode(both).alias("u"))
        .select("doc_id", "u.line", "u.unit")
        # n characters hold at most n / 2 words, so shorter lines cannot have the bigrams of the smallest template
        .filter(F.length("unit") > 2 * min(sizes) * near)
        .select("doc_id", "line", F.explode(F.array(bigrams(F.col("unit")))).alias("grams"))  # generated, so computed once
        .filter(F.size("grams").between(min(sizes) * near - 1e-9, max(sizes) / near + 1e-9))
    )
    reached = F.filter(F.array(best_template(F.col("grams"), hashed, near)), lambda b: b["dice"] >= threshold)
    return rows.select("doc_id", "line", F.explode(reached).alias("best")).select(
        "doc_id", "line", "best.license", "best.dice", "best.n_shared"
    )


def scan_texts(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """The rows of ``scan_licenses``, also for complete licence texts, and those of ``scan_passages``."""
    texts = TEMPLATES | complete_texts() if templates is None else templates
    near = materialize(possible_texts(docs, texts, threshold), "possible")
    return scan_licenses(near, texts, threshold).unionByName(scan_passages(near, texts, threshold))


def possible_texts(docs: DataFrame, templates: dict[str, str], threshold: float = 0.8) -> DataFrame:
    """The rows (doc_id, text) of ``docs`` in which any line, passage or the whole text may reach ``threshold``.

    What reaches it has one of a template's anchors, and all bigrams of a line or passage
    are bigrams of its whole text, so no match is lost.
    """
    known = usable(templates)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(F.col("text").isNotNull())
    if not known:
        return own.limit(0)
    rare = anchors_of(known, hashes(docs.sparkSession, known), needed(known, threshold))
    return own.filter(F.exists(pairs(F.col("text")), lambda g: g.isin(*rare)))


def needed(known: dict[str, list[str]], threshold: float) -> dict[str, int]:
    """How many of a template's bigrams a text that reaches ``threshold`` shares at least."""
    near = threshold / (2 - threshold)
    return {name: -int(-(len(grams) * near - 1e-9) // 1) for name, grams in known.items()}


def anchors_of(known: dict[str, list[str]], hashed: dict[str, list[int]], need: dict[str, int]) -> list[int]:
    """For each template a few more bigrams than may be missing; one of them is in each text that reaches the threshold."""
    anchors: set[int] = set()
    for name, grams in known.items():
        rare = sorted(range(len(grams)), key=lambda i: (-len(grams[i]), grams[i]))  # noqa: B023
        anchors.update(hashed[name][i] for i in rare[: len(grams) - need[name] + 1])
    return sorted(anchors)


def scan_passages(docs: DataFrame, templates: dict[str, str], threshold: float = 0.8) -> DataFrame:
    """Rows (doc_id, line, license, dice, n_shared) of passages that reach ``threshold``, without overlaps.

    ``line`` is that of the first word. A passage is given where it shares more bigrams
    with its template than the whole text and every line that it touches do with theirs,
    as far as they reach ``threshold``; of passages that overlap, the one that shares most
    bigrams stays.
    """
    known = usable(templates)
    if not known:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, line int, license string, dice double, n_shared int")
    hashed = hashes(docs.sparkSession, known)
    full = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(F.col("text").isNotNull())
    near = threshold / (2 - threshold)
    need = needed(known, threshold)
    anchors = anchors_of(known, hashed, need)
    template = F.array(
        *[
            F.struct(
                F.lit(name).alias("license"),
                constant(hashed[name]).alias("grams"),
                F.lit(need[name]).alias("need"),
                F.lit(int(len(grams) / near + 1e-9)).alias("most"),
                F.lit(max(1, len(grams) // 16 if len(grams) >= 32 else 1)).alias("step"),
            )
            for name, grams in known.items()
        ]
    )
    ordered = F.col("pairs")

    def block(at: Column, t: Column) -> Column:
        return F.floor(at / t["step"])

    def windows(t: Column, at: Column) -> Column:
        starts = F.filter(at, lambda p, i: (i == 0) | (block(p, t) != block(F.get(at, i - 1), t)))
        ends = F.filter(at, lambda p, i: (i == F.size(at) - 1) | (block(p, t) != block(F.get(at, i + 1), t)))
        every = bound(ends, lambda e: F.flatten(F.transform(starts, lambda a: F.transform(
            F.filter(e, lambda b: (b - a + 1).between(t["need"], t["most"])), lambda b: F.struct(a.alias("first"), b.alias("last"))
        ))))

        def score(w: Column, own: Column) -> Column:
            shared = F.size(F.array_intersect(own, t["grams"]))
            return bound(shared, lambda n: F.struct(
                (-n).alias("less"), (-2 * n / (F.size(own) + F.size(t["grams"]))).alias("far"), t["license"].alias("license"), w["first"].alias("first"), w["last"].alias("last")
            ))

        scored = F.transform(every, lambda w: bound(F.array_distinct(F.slice(ordered, w["first"], w["last"] - w["first"] + 1)), lambda own: score(w, own)))
        return F.filter(scored, lambda w: -w["far"] >= threshold)

    def of_template(t: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.size(ordered)), lambda i: F.array_contains(t["grams"], F.element_at(ordered, i)))
        return bound(at, lambda places: windows(t, places))

    possible = F.filter(template, lambda t: F.size(F.array_intersect(ordered, t["grams"])) >= t["need"])
    every = F.array_sort(F.flatten(F.transform(possible, of_template)))
    apart = F.aggregate(
        every,
        F.array().cast("array<struct<less:int,far:double,license:string,first:int,last:int>>"),
        lambda kept, w: F.when(F.exists(kept, lambda k: (k["first"] <= w["last"]) & (w["first"] <= k["last"])), kept).otherwise(F.concat(kept, F.array(w))),
    )
    plain = F.transform(F.split("text", "\n"), lambda part: F.trim(F.regexp_replace(F.lower(part), r"[^\p{L}\p{N}]+", " ")))
    counts = F.transform(plain, lambda part: F.when(part == "", 0).otherwise(F.size(F.split(part, " "))))
    spans = F.aggregate(
        F.col("counts"),
        F.array().cast("array<struct<before:int,words:int>>"),
        lambda seen, n: F.concat(seen, F.array(F.struct(F.coalesce(F.get(seen, F.size(seen) - 1)["before"] + F.get(seen, F.size(seen) - 1)["words"], F.lit(0)).alias("before"), n.alias("words")))),
    )

    def shared_of(grams: Column) -> Column:
        return bound(grams, lambda g: bound(best_template(g, hashed, near), lambda b: F.when(b["dice"] >= threshold, b["n_shared"]).otherwise(0)))

    first, last = F.col("w.first"), F.col("w.last")
    touched = F.filter("spans", lambda s: (s["words"] > 1) & (s["before"] + 1 <= last) & (s["before"] + s["words"] - 1 >= first))
    of_lines = F.transform(touched, lambda s: shared_of(F.array_distinct(F.slice(ordered, s["before"] + 1, s["words"] - 1))))
    of_whole = F.when(F.size("spans") > 1, shared_of(F.array_distinct(ordered))).otherwise(0)
    line = F.size(F.filter("spans", lambda s: s["before"] + s["words"] < first))
    return (
        full.filter(F.length("text") > 2 * min(need.values()))
        .select("doc_id", "text", F.explode(F.array(pairs(F.col("text")))).alias("pairs"))
        .filter(F.exists("pairs", lambda g: g.isin(*anchors)))
        .select("doc_id", "text", "pairs", F.explode(apart).alias("w"))
        .select("doc_id", "pairs", "w", F.explode(F.array(counts)).alias("counts"))
        .select("doc_id", "pairs", "w", F.explode(F.array(spans)).alias("spans"))
        .filter(-F.col("w.less") > F.greatest(F.coalesce(F.array_max(of_lines), F.lit(0)), of_whole))
        .select("doc_id", line.alias("line"), "w.license", (-F.col("w.far")).alias("dice"), (-F.col("w.less")).alias("n_shared"))
    )


def oracle(templates: dict[str, str] | None = None, threshold: float = 0.8) -> str:
    """``scan_licenses`` for DuckDB over a view ``documents``, without size bounds."""
    known = TEMPLATES if templates is None else templates
    values = ", ".join(
        f"('{name}', [{', '.join(repr(g) for g in template_bigrams(text))}])" for name, text in known.items() if template_bigrams(text)
    )
    return f"""
WITH template(license, grams) AS (VALUES {values}),
unit AS (
  SELECT doc_id, -1 AS line, text AS unit FROM documents WHERE len(string_split(text, chr(10))) > 1
  UNION ALL
  SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS unit FROM documents
), word AS (
  SELECT doc_id, line, string_split(trim(regexp_replace(lower(unit), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS words FROM unit
), gram AS (
  SELECT doc_id, line, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS grams FROM word
), compared AS (
  SELECT doc_id, line, license, len(list_intersect(g.grams, t.grams)) AS n_shared,
         2.0::DOUBLE * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS dice
  FROM gram g, template t
)
SELECT doc_id, CAST(line AS INTEGER) AS line, license, dice, CAST(n_shared AS INTEGER) AS n_shared FROM compared
WHERE dice >= {threshold} QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, license) = 1
"""
