"""License scans: exact set-similarity join of text blocks with license templates.

Blocks are the lines of a text and its paragraphs of several lines (runs of lines up
to a blank one), as licenses are often wrapped. Templates are statements and whole
paragraphs of licenses. Both are sets of words. A block of any size matches a template
when it holds at least `threshold` of the template's words.
Words are put in one global order, rarest in the corpus first; a block that matches
must hold one of the first words of the template in that order (prefix filter), must
have enough words (length filter), and from the shared word on, both sides must have
enough words left (position filter). What passes is verified with the full
intersection.

Defined results: a null or empty text has no words, no places and no labels; a
block without words never matches; rows that share a doc_id share their method
labels; repeated rows are answered each; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII that is in no word becomes a blank, and A-Z become a-z.
BLANKS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
PLAIN, CLEAN = BLANKS + UPPER, " " * len(BLANKS) + LOWER

#: Phrases of consecutive words and the label that each one gives.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Statements that licenses and their users commonly write, paragraphs of public licenses, and their labels (fixed values).
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "this work is licensed under a creative commons attribution license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "this library is licensed under the gnu lesser general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("reserved", "all rights reserved"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at http www apache org licenses license 2 0",
    ),
    (
        "apache-2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing "
        "permissions and limitations under the license",
    ),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    ),
    (
        "mit",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable "
        "for any claim damages or other liability",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "bsd",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    ),
    (
        "bsd",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published "
        "by the free software foundation either version 3 of the license or at your option any later version",
    ),
    (
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as "
        "published by the free software foundation either version 2 1 of the license or at your option any later version",
    ),
    (
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this "
        "file you can obtain one at https mozilla org mpl 2 0",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages "
        "arising from the use of this software",
    ),
]
THRESHOLD = 0.9
PARAGRAPH_END = r"\n[ \t\r]*\n"


def words(text: Column) -> Column:
    """The words of a text in order, A-Z in lower case; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), PLAIN, CLEAN), " "), "")


def places(found: Column, phrase: str) -> Column:
    """Word indexes where the phrase starts; searched only where its words occur."""
    parts = phrase.split()

    def starts(i: Column) -> Column:
        test = F.get(found, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            test &= F.get(found, i + k) == part
        return test

    occur = F.lit(True)
    for part in parts:
        occur &= F.array_contains(found, part)
    everywhere = F.sequence(F.lit(0), F.size(found) - 1)
    return F.when(occur, F.filter(everywhere, starts)).otherwise(F.array().cast("array<int>"))


def base_phrases(docs: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word and the phrases' labels."""
    held = docs.select("doc_id", words(F.col("text")).alias("words"))
    held = held.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        *[places(F.col("words"), p).alias(f"at_{k}") for k, p in enumerate(phrases)],
    )
    every = F.concat(*[f"at_{k}" for k in range(len(phrases))])
    labels = F.array_compact(
        F.array(*[F.when(F.size(f"at_{k}") > 0, F.lit(v)) for k, v in enumerate(phrases.values())])
    )
    return held.select(
        "doc_id",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(labels)).alias("base"),
    )


def word_ranks(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """word, rank: the templates' words by the number of documents that hold them, rarest first.

    The result has as many rows as the templates have words, whatever the corpus.
    """
    wanted = F.array(*map(F.lit, vocabulary))
    seen = docs.select(
        F.explode(F.array_intersect(words(F.col("text")), wanted)).alias("word")
    )
    counted = seen.groupBy("word").count()
    known = docs.sparkSession.createDataFrame([(w,) for w in vocabulary], "word string")
    order = Window.orderBy(F.coalesce("count", F.lit(0)), "word")
    return known.join(counted, "word", "left").select("word", (F.row_number().over(order) - 1).alias("rank"))


def license_matches(
    docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """doc_id, block (lines from 0 on, then paragraphs), label, template, containment of every match."""
    spark = docs.sparkSession
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    rank = {r.word: r.rank for r in word_ranks(docs, vocabulary).collect()}  # bounded by the templates
    rows, prefixes = [], []
    for k, (label, text) in enumerate(templates):
        ordered = sorted(set(text.split()), key=rank.__getitem__)
        need = math.ceil(threshold * len(ordered) - 1e-9)
        rows.append((k, label, text, ordered, need))
        prefixes += [(k, w, p) for p, w in enumerate(ordered[: len(ordered) - need + 1])]
    table = spark.createDataFrame(rows, "t int, label string, template string, t_words array<string>, need int")
    starts = spark.createDataFrame(prefixes, "t int, word string, t_pos int")
    first = F.array(*[F.lit(w) for w in sorted({w for _, w, _ in prefixes})])
    by_rank = F.array(*[F.lit(w) for w in sorted(vocabulary, key=rank.__getitem__)])

    texts = docs.select("doc_id", "text").where(F.arrays_overlap(words(F.col("text")), first))
    lines = F.split("text", "\n")
    paragraphs = F.filter(F.split("text", PARAGRAPH_END), lambda x: F.contains(x, F.lit("\n")))
    blocks = texts.select("doc_id", F.posexplode(F.concat(lines, paragraphs)).alias("block", "b"))
    # Only words of some template can count, kept in the global order: by_rank leads the intersection.
    blocks = blocks.select("doc_id", "block", F.array_intersect(by_rank, words(F.col("b"))).alias("b_words"))
    blocks = blocks.where(F.arrays_overlap("b_words", first))
    hits = (
        blocks.select("doc_id", "block", "b_words", F.posexplode("b_words").alias("b_pos", "word"))
        .join(F.broadcast(starts), "word")
        .join(F.broadcast(table), "t")
        .where(F.size("b_words") >= F.col("need"))
        .where(F.least(F.size("t_words") - F.col("t_pos"), F.size("b_words") - F.col("b_pos")) >= F.col("need"))
    )
    shared = F.size(F.array_intersect("b_words", "t_words"))
    return (
        hits.where(shared >= F.col("need"))
        .select("doc_id", "block", "label", "template", (shared / F.size("t_words")).alias("containment"))
        .distinct()
    )


def license_scan(
    docs: DataFrame,
    templates: list[tuple[str, str]] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document: places of the phrases, labels of phrases and templates, best containment."""
    found = (
        license_matches(docs, templates, threshold)
        .groupBy(F.col("doc_id").alias("m_id"))
        .agg(F.collect_set("label").alias("method"), F.max("containment").alias("best"))
    )
    joined = base_phrases(docs, phrases).join(found, F.col("doc_id").eqNullSafe(F.col("m_id")), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("method", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """Every line and paragraph against every template, without filters."""
    values = ",\n".join(f"({k}, '{label}', '{text}')" for k, (label, text) in enumerate(TEMPLATES))
    place = []
    for phrase, label in PHRASES.items():
        test = " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(phrase.split()))
        place.append(f"SELECT doc_id, i - 1 AS pos, '{label}' AS label FROM spots WHERE {test}")
    return rf"""
WITH templates(t, label, txt) AS (VALUES {values}),
tw AS (SELECT t, label, list_distinct(string_split(txt, ' ')) AS tw FROM templates),
low AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS l FROM documents),
w AS (SELECT doc_id, regexp_extract_all(l, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
spots AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
places AS ({" UNION ALL ".join(place)}),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS bl FROM places GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(l, chr(10))) AS line FROM low UNION ALL
    SELECT doc_id, p FROM (SELECT doc_id, unnest(regexp_split_to_array(l, '\n[ \t\r]*\n')) AS p FROM low) WHERE contains(p, chr(10))),
bw AS (SELECT doc_id, list_distinct(regexp_extract_all(line, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS b FROM lines),
hit AS (SELECT doc_id, label, len(list_intersect(b, tw)) / len(tw)::DOUBLE AS c FROM bw, tw
        WHERE len(list_intersect(b, tw)) >= ceil({THRESHOLD} * len(tw) - 1e-9)),
found AS (SELECT doc_id, list(DISTINCT label) AS ml, max(c) AS best FROM hit GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(array_to_string(list_sort(bl), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bl, []::VARCHAR[]), coalesce(ml, []::VARCHAR[])))), ','), '') AS labels,
  CASE WHEN coalesce(n_base, 0) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""
