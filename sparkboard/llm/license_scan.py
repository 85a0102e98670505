"""Licence scan: normalised text against templates by Dice coefficient over word bigrams.

A document's units are its lines, its paragraphs and the whole text, in lower-cased
runs of ASCII letters and digits. Dice of multisets of a and b bigrams is at most
2 min(a, b) / (a + b), so a template is a candidate only for units whose number of
bigrams lies within fixed bounds of its own; the join is on that number, and units
out of all bounds are dropped before. A unit that reaches the threshold also shares so
many bigrams with a template that it cannot do without all of a few key words, which
are chosen from the templates by rule: texts without any of them are left out first,
which loses no match. Only DataFrame functions are used.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Short licence statements and notices as they are commonly written.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
THRESHOLD = 0.8
#: English words that almost every text has: the last to serve as key words.
COMMON = frozenset("a an and as at be by for from in is it not of on or that the this to under with you".split())
WORD = "[A-Za-z0-9]+"
PARAGRAPH = "\n[ \t\r]*\n"


def template_rows(templates: tuple[tuple[str, str], ...], threshold: float) -> list[tuple[int, int, str, list[str], list[int], int]]:
    """(unit bigrams, template, licence, its bigrams, their counts, their number) for each number of unit bigrams that can reach the threshold."""
    rows = []
    for k, (name, text) in enumerate(templates):
        words = [w.lower() for w in re.findall(WORD, text)]
        pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
        kinds = sorted(set(pairs))
        low, high = math.ceil(len(pairs) * threshold / (2 - threshold) - 1e-9), math.floor(len(pairs) * (2 - threshold) / threshold + 1e-9)
        rows += [(n, k, name, kinds, [pairs.count(x) for x in kinds], len(pairs)) for n in range(max(1, low), high + 1)]
    return rows


def key_words(templates: tuple[tuple[str, str], ...], threshold: float) -> list[str]:
    """Words of which a text must have one to match any template: of each template so many
    bigrams hold one of them that without these too few are left for the threshold."""
    bags, needed = [], []
    for _, text in templates:
        words = [w.lower() for w in re.findall(WORD, text)]
        pairs = list(zip(words, words[1:]))
        bags.append(pairs)
        needed.append(len(pairs) - math.ceil(len(pairs) * threshold / (2 - threshold) - 1e-9) + 1)

    def short(chosen: list[str]) -> list[int]:
        return [n - sum(any(w in chosen for w in p) for p in pairs) for pairs, n in zip(bags, needed, strict=True)]

    chosen: list[str] = []
    while any(m > 0 for m in short(chosen)):
        gain: dict[str, float] = {}
        for pairs, m in zip(bags, short(chosen), strict=True):
            left = [p for p in pairs if not any(w in chosen for w in p)]
            for w in {x for p in left for x in p} if m > 0 else ():
                gain[w] = gain.get(w, 0.0) + min(m, sum(w in p for p in left)) * (0.01 if w in COMMON else len(w) ** 2)
        chosen.append(max(sorted(gain), key=lambda w: gain[w]))
    for w in sorted(chosen, key=lambda w: (w not in COMMON, len(w), w)):  # common and short words go if the others do
        rest = [x for x in chosen if x != w]
        if all(m <= 0 for m in short(rest)):
            chosen = rest
    return chosen


def scan_licenses(documents: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per doc_id: license, score (Dice, six decimals) and n_units.

    license is that of the best template of all units, ties falling to the first
    name, null if no unit reaches ``threshold``; n_units counts the distinct units
    that reach it. A null or empty text matches nothing. Rows with one doc_id are
    taken as one document, rows with a null doc_id too. Other columns play no part.
    """
    rows = template_rows(templates, threshold)
    # a fixed table: as many rows as the templates' size bounds span
    table = F.broadcast(documents.sparkSession.createDataFrame(rows, "n int, template int, license string, kinds array<string>, times array<int>, own int"))
    least, most = min(r[0] for r in rows), max(r[0] for r in rows)
    text = F.col("text").cast("string")
    counted = lambda x: F.regexp_count(x, F.lit(WORD)) - 1
    units = F.array_distinct(F.concat(F.split(text, "\n", -1), F.split(text, PARAGRAPH, -1), F.array(text)))
    keys = rf"(?i)(?:{'|'.join(key_words(templates, threshold))})(?![A-Za-z0-9])"
    found = documents.where(text.rlike(keys)).select("doc_id", F.explode(F.filter(units, lambda x: counted(x).between(least, most))).alias("unit"))
    found = found.withColumn("words", F.regexp_extract_all("unit", F.lit(WORD), F.lit(0))).withColumn("n", F.size("words") - 1)
    found = found.withColumn("pairs", F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.lower(F.concat(F.element_at("words", i), F.lit(" "), F.element_at("words", i + 1)))))
    joined = found.join(table, "n")
    common = F.aggregate(F.zip_with("kinds", "times", lambda b, c: F.least(c, F.size(F.filter("pairs", lambda x: x == b)))), F.lit(0), lambda a, x: a + x)
    scored = joined.select("doc_id", "unit", "license", (2.0 * common / (F.col("n") + F.col("own"))).alias("dice")).where(F.col("dice") >= threshold)
    best = scored.groupBy("doc_id").agg(F.min(F.struct((-F.col("dice")).alias("d"), "license")).alias("best"), F.count_distinct("unit").alias("n_units"))
    best = best.select(F.col("doc_id").alias("_id"), F.col("best.license").alias("license"), F.round(-F.col("best.d"), 6).alias("score"), "n_units")
    every = documents.select("doc_id").distinct()
    return every.join(best, every["doc_id"].eqNullSafe(best["_id"]), "left").select("doc_id", "license", "score", F.coalesce("n_units", F.lit(0).cast("long")).alias("n_units"))


def oracle() -> str:
    rows = template_rows(TEMPLATES, THRESHOLD)
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({k}, {quote(name)})" for k, (name, _) in enumerate(TEMPLATES))
    pairs = ", ".join(sorted({f"({k}, {quote(b)}, {c}, {own})" for _, k, _, kinds, times, own in rows for b, c in zip(kinds, times, strict=True)}))
    low, high = THRESHOLD / (2 - THRESHOLD), (2 - THRESHOLD) / THRESHOLD
    return f"""
WITH t(template, license) AS (VALUES {values}),
tp(template, pair, times, own) AS (VALUES {pairs}),
u AS (SELECT doc_id, unnest(list_distinct(list_concat(string_split(text, chr(10)), list_concat(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n'), [text])))) AS unit FROM documents),
w AS (SELECT doc_id, unit, regexp_extract_all(unit, '[A-Za-z0-9]+') AS words FROM u),
b AS (SELECT doc_id, unit, len(words) - 1 AS n, unnest(list_transform(range(1, len(words)), lambda i: lower(words[i] || ' ' || words[i + 1]))) AS pair FROM w WHERE len(words) >= 2),
c AS (SELECT doc_id, unit, n, pair, count(*) AS times FROM b GROUP BY ALL),
d AS (SELECT c.doc_id, c.unit, tp.template, 2.0::DOUBLE * sum(least(c.times, tp.times)) / (c.n + tp.own) AS dice FROM c JOIN tp ON c.pair = tp.pair AND c.n >= tp.own * CAST({low} AS DOUBLE) - CAST(1e-9 AS DOUBLE) AND c.n <= tp.own * CAST({high} AS DOUBLE) + CAST(1e-9 AS DOUBLE) GROUP BY c.doc_id, c.unit, c.n, tp.own, tp.template),
m AS (SELECT d.doc_id, d.unit, d.dice, t.license FROM d JOIN t USING (template) WHERE dice >= {THRESHOLD}),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, license) AS k FROM m),
n AS (SELECT doc_id, count(DISTINCT unit) AS n_units FROM m GROUP BY doc_id)
SELECT x.doc_id, r.license, round(r.dice, 6) AS score, coalesce(n.n_units, 0) AS n_units
FROM (SELECT DISTINCT doc_id FROM documents) x LEFT JOIN r ON r.doc_id = x.doc_id AND r.k = 1 LEFT JOIN n ON n.doc_id = x.doc_id"""
