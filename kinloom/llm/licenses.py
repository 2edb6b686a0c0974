"""Licence phrases and notices in texts, by diagonal voting: DataFrame and SQL functions only.

Words of every text meet the templates' words by a Spark join on hashes of rolling
k-grams. A match at word ``at`` of a text and word ``t`` of a template votes for
the diagonal ``at - t``, where the template would begin. Votes are counted by
diagonal; of notices, diagonals that words put in or left out have moved apart
are merged; spans that hold enough of their template are verified and stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.llm.common import ascii_lower, stored, words_of

_BETWEEN = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
WORD = f"[^{_BETWEEN}]+"
#: Words of a gram of phrases and of notices.
PHRASE_GRAM, NOTICE_GRAM = 2, 4
#: Diagonals of a notice so near (and within a quarter of its words, so that repeats stay apart), and spans of it so near in the text, are one occurrence with words put in or left out.
NEAR_DIAGONAL, NEAR_WORDS = 12, 40
#: A notice's occurrence counts if it is at least so like its template: words in common over the mean of both lengths.
LIKE = 0.6
#: Template grams that are broadcast; a larger library is joined by a shuffle.
BROADCAST_GRAMS = 500_000

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Public licence notices, by label.
NOTICES = {
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.""",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc": "licensed under CC BY-NC 4.0",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be
useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies.""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    exact: bool  # a phrase: all its words in a row; else a notice, which may be changed


LIBRARY = [*(Template(label, text, True) for text, label in PHRASES.items()), *(Template(label, text, False) for label, text in NOTICES.items())]


def words(text: Column) -> Column:
    return words_of(ascii_lower(F.coalesce(text, F.lit(""))), _BETWEEN)


def _grams(w: Column) -> Column:
    """The gram that begins at each word: (a, b, c, d), null past the text's end."""
    later = lambda k: F.slice(w, F.lit(k + 1), F.greatest(F.size(w) - k, F.lit(0)))
    return F.arrays_zip(w.alias("a"), *(later(k).alias(x) for k, x in enumerate("bcd", 1)))


def template_grams(spark: SparkSession, library: list[Template] = LIBRARY) -> DataFrame:
    """template, label, exact, length, t (the gram's place), its words a to d, and the hash of the first two. Phrases of two words or more have grams of two words, notices grams of four; a shorter template has none."""
    rows = F.array(*(F.struct(F.lit(k).alias("template"), F.lit(x.label).alias("label"), F.lit(x.exact).alias("exact"), F.lit(x.text).alias("text")) for k, x in enumerate(library)))
    all_ = spark.range(1).select(F.explode(rows).alias("x")).select("x.template", "x.label", "x.exact", words(F.col("x.text")).alias("w"))
    each = all_.select("template", "label", "exact", F.size("w").alias("length"), F.posexplode(_grams(F.col("w"))).alias("t", "g")).select("*", "g.*").drop("g")
    each = each.where(F.when(F.col("exact"), F.col("b").isNotNull()).otherwise(F.col("d").isNotNull()))
    return each.withColumn("hash", F.xxhash64("a", "b"))


def matches(docs: DataFrame, grams: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc, key, n_words, and a row for each gram of a text that a template holds: template, label, exact, length, t, at. Each text also has one row with template null.

    One narrow pass over the texts: all rolling grams are joined to the templates' by hash, and their words are compared. A text's own row
    comes through the same join, as the gram before its first word, so that texts are read and cut once.
    """
    own = F.array(F.struct(F.lit("").alias("a"), F.lit("").alias("b"), F.lit("").alias("c"), F.lit("").alias("d")))  # no word is empty
    cut = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.length(text_col)).alias("key"), words(F.col(text_col)).alias("w"))
    each = cut.select("doc", "key", F.size("w").alias("n_words"), F.posexplode(F.concat(own, _grams(F.col("w")))).alias("at", "g"))
    each = each.select("doc", "key", "n_words", (F.col("at") - 1).alias("at"), F.xxhash64("g.a", "g.b").alias("hash"), *(F.col(f"g.{x}").alias(f"g_{x}") for x in "abcd"))
    mark = grams.sparkSession.range(1).select(*(F.lit(None).cast(grams.schema[c].dataType).alias(c) if c not in "abcd" else F.lit("").alias(c) for c in grams.columns))
    table = grams.unionByName(mark.withColumn("hash", F.xxhash64("a", "b")))
    if grams.count() <= BROADCAST_GRAMS:
        table = F.broadcast(table)
    same = (F.col("g_a") == F.col("a")) & (F.col("g_b") == F.col("b")) & (F.coalesce(F.col("exact"), F.lit(True)) | ((F.col("g_c") == F.col("c")) & (F.col("g_d") == F.col("d"))))
    return each.join(table, "hash").where(same).select("doc", "key", "n_words", "template", "label", "exact", "length", "t", "at")


def spans(found: DataFrame) -> DataFrame:
    """doc, key, template, label, exact, start, stop (words, stop exclusive), votes, likeness: verified occurrences of matches().

    Votes are counted by diagonal. A phrase needs every gram of one diagonal. Of a notice, diagonals are put in the text's order, and those
    next to each other that are near both across and along the text are one occurrence; its likeness is the Dice coefficient of the words that its grams
    cover, as many as both sides have, and LIKE or more is kept. Repeated rows of a text vote once.
    """
    votes = found.where("template is not null").select("doc", "key", "template", "label", "exact", "length", "t", "at").distinct().withColumn("diagonal", F.col("at") - F.col("t"))
    who = ["doc", "key", "template", "label", "exact", "length"]
    lines = votes.groupBy(*who, "diagonal").agg(F.count(F.lit(1)).alias("votes"), F.min("at").alias("start"), (F.max("at")).alias("last"), F.array_sort(F.collect_list("t")).alias("places"))  # a diagonal has as many places as its template at most
    phrases = lines.where(F.col("exact") & (F.col("votes") == F.col("length") - (PHRASE_GRAM - 1)))
    phrases = phrases.select(*who, "start", (F.col("start") + F.col("length")).alias("stop"), "votes", F.lit(1.0).alias("likeness"))
    order = Window.partitionBy("doc", "key", "template").orderBy("start", "diagonal")
    near = (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) <= F.least(F.lit(NEAR_DIAGONAL), F.expr("length div 4"))) & (F.col("start") - F.lag("last").over(order) <= NEAR_WORDS)
    merged = lines.where(~F.col("exact")).withColumn("new", F.when(near, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    merged = merged.groupBy(*who, "run").agg(F.sum("votes").alias("votes"), F.min("start").alias("start"), (F.max("last") + NOTICE_GRAM).alias("stop"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"))
    # words of the template that grams at these places cover: a gram's length, less its overlap with the one before
    covered = F.aggregate(F.arrays_zip(F.col("places").alias("p"), F.concat(F.array(F.lit(-NOTICE_GRAM)), F.col("places")).alias("q")), F.lit(0), lambda n, x: n + F.when(x["p"].isNull(), 0).otherwise(F.least(F.lit(NOTICE_GRAM), x["p"] - x["q"])))
    like = 2 * covered / (F.col("length") + F.greatest(F.col("stop") - F.col("start"), covered))
    notices = merged.withColumn("likeness", like).where(F.col("likeness") >= LIKE).select(*who, "start", "stop", "votes", "likeness")
    return phrases.unionByName(notices)


def scan(docs: DataFrame, library: list[Template] = LIBRARY, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Verified spans of every text: doc, key, template, label, exact, length, start, stop, votes, likeness."""
    return spans(matches(docs, template_grams(docs.sparkSession, library), text_col, id_col))


def report(docs: DataFrame, library: list[Template] = LIBRARY, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    n_base counts places of phrases, which may overlap; first_word and last_word are the smallest and largest of their starts, null without any. labels
    are those of phrases and notices; both lists are '' when empty. score is the largest likeness of a span, 0 without one. Null text is empty; a null or repeated id is a document like
    others, repeated rows each get their row. Other columns are ignored; an empty table gives an empty result.

    Texts are read once; their matches, few beside their words, are stored. All groups are within one text and template.
    """
    found = stored(matches(docs, template_grams(docs.sparkSession, library), text_col, id_col))
    texts = found.where("template is null").select("doc", "key", "n_words")
    base = F.col("exact")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    by_text = spans(found).groupBy("doc", "key").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        listed(F.when(base, F.col("label"))).alias("base_labels"), listed("label").alias("labels"), F.max("likeness").alias("score"),
    )
    side = by_text.select(F.col("doc").alias("d"), F.col("key").alias("k"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    out = texts.join(side, texts["doc"].eqNullSafe(side["d"]) & (texts["key"] == side["k"]), "left")
    none = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return out.select(F.col("doc").alias(id_col), F.col("n_words").cast("long").alias("n_words"), none("n_base", 0), "first_word", "last_word", none("base_labels", ""), none("labels", ""), none("score", 0.0))


def oracle(library: list[Template] = LIBRARY) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    cut = lambda c: f"regexp_extract_all(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')"
    rows = ", ".join(f"({k}, {quoted(x.label)}, {x.exact}, {quoted(x.text)})" for k, x in enumerate(library))
    grams = "w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, w[i + 3] AS d"
    return f"""
WITH lib(template, label, exact, text) AS (VALUES {rows}),
tw AS (SELECT template, label, exact, {cut("text")} AS w FROM lib),
tg AS (SELECT template, label, exact, len(w) AS length, i - 1 AS t, {grams} FROM (SELECT *, unnest(generate_series(1, len(w))) AS i FROM tw) WHERE CASE WHEN exact THEN i < len(w) ELSE i + 3 <= len(w) END),
docs AS (SELECT row_number() OVER () AS id, doc_id, {cut("coalesce(text, '')")} AS w FROM documents),
dg AS (SELECT id, i - 1 AS pos, {grams} FROM (SELECT id, w, unnest(generate_series(1, len(w) - 1)) AS i FROM docs)),
votes AS (SELECT id, template, label, exact, length, t, pos, pos - t AS diagonal FROM dg JOIN tg ON dg.a = tg.a AND dg.b = tg.b AND (exact OR (dg.c = tg.c AND dg.d = tg.d))),
phrases AS (SELECT id, label, min(pos) AS start FROM votes WHERE exact GROUP BY id, template, label, length, diagonal HAVING count(*) = length - {PHRASE_GRAM - 1}),
lines AS (SELECT id, template, label, length, diagonal, min(pos) AS start, max(pos) AS last FROM votes WHERE NOT exact GROUP BY ALL),
gaps AS (SELECT *, CASE WHEN abs(diagonal - lag(diagonal) OVER o) <= least({NEAR_DIAGONAL}, length // 4) AND start - lag(last) OVER o <= {NEAR_WORDS} THEN 0 ELSE 1 END AS new FROM lines WINDOW o AS (PARTITION BY id, template ORDER BY start, diagonal)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY id, template ORDER BY start, diagonal) AS run FROM gaps),
places AS (SELECT DISTINCT r.id, r.template, r.run, v.t FROM runs r JOIN votes v ON v.id = r.id AND v.template = r.template AND v.diagonal = r.diagonal),
steps AS (SELECT *, t - lag(t, 1, -{NOTICE_GRAM}) OVER (PARTITION BY id, template, run ORDER BY t) AS step FROM places),
covered AS (SELECT id, template, run, sum(least({NOTICE_GRAM}, step))::BIGINT AS n FROM steps GROUP BY ALL),
notices AS (SELECT r.id, r.label, 2 * c.n / (r.length + greatest(max(r.last) + {NOTICE_GRAM} - min(r.start), c.n)) AS likeness FROM runs r JOIN covered c USING (id, template, run) GROUP BY r.id, r.label, r.length, template, run, c.n),
spans AS (SELECT id, label, start, 1.0::DOUBLE AS likeness FROM phrases UNION ALL SELECT id, label, NULL, likeness FROM notices WHERE likeness >= {LIKE}),
found AS (SELECT id, count(start) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (start IS NOT NULL) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(likeness) AS score FROM spans GROUP BY id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score FROM docs LEFT JOIN found USING (id)
"""
