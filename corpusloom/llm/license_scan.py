"""License scans by diagonal voting. DataFrame functions only.

All rolling word 3-grams of a text are hashed and Spark-joined to the positions of the same 3-grams in license
templates. A hit votes for the diagonal document position - template position; neighbouring diagonals, which differ by
inserted or dropped words, are merged; a merged span is verified by how many of the template's words its hits cover.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, UPPER, table

GRAM = 3
#: Diagonals at most this far apart are one span.
MERGE = 2
#: Share of a template's words that a span must cover.
MIN_COVER = 0.8
#: A span is at most this many times as long as its template.
MAX_STRETCH = 1.5
#: Fixed: what separates words.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Templates: opening words of public license texts and usual one-line notices.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
)


#: Words of the column text. What a lambda refers to is bound by a lambda around it (a one-element array takes the
#: place of a let), so no rewrite of the plan can make it evaluate a text's words once for each word.
_WORDS = f"filter(split(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), r'{NO_WORD}'), w -> w != '')"


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def template_grams(spark, templates) -> DataFrame:
    """(h, template, at, label, length): every 3-gram of every template."""
    rows = [(t, label, i, len(w), *w[i : i + GRAM]) for t, (label, text) in enumerate(templates) for w in [text.split()] for i in range(len(w) - GRAM + 1)]
    grams = spark.createDataFrame(rows, "template int, label string, at int, length int, a string, b string, c string")
    grams = grams.select(F.xxhash64("a", "b", "c").alias("h"), "template", "label", "at", "length")
    return F.broadcast(grams) if len(rows) <= BROADCAST_ROWS else grams


def license_spans(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Verified spans (doc_id, __text, label, template, first, last, votes, cover) in docs (doc_id, text)."""
    grams = F.expr(f"transform(array({_WORDS}), w -> if(size(w) < {GRAM}, null, transform(sequence(0, size(w) - {GRAM}), i -> xxhash64(w[i], w[i + 1], w[i + 2]))))[0]")
    # the outer form, as Spark would compute the array once more to leave out empty ones
    rolling = docs.select("doc_id", text_hash().alias("__text"), F.posexplode_outer(grams).alias("pos", "h"))
    hits = rolling.join(template_grams(docs.sparkSession, templates), "h")
    key = ["doc_id", "__text", "template", "label", "length"]
    # a repeated row votes in the same places again: sets, not counts
    diagonals = hits.groupBy(*key, (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    within = Window.partitionBy(*key).orderBy("diagonal")
    cut = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(within) > MERGE, F.lit(True)).cast("int")
    islands = diagonals.withColumn("cut", cut).withColumn("island", F.sum("cut").over(within))
    spans = islands.groupBy(*key, "island").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("ats"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum(F.size("ats")).alias("votes")
    )
    covered = F.expr(f"aggregate(ats, struct(-{GRAM} AS last, 0 AS n), (acc, i) -> struct(i AS last, acc.n + least({GRAM}, i - acc.last) AS n), acc -> acc.n)")
    spans = spans.withColumn("cover", covered / F.col("length")).withColumn("last", F.col("last") + GRAM - 1)
    good = (F.col("cover") >= MIN_COVER) & (F.col("last") - F.col("first") + 1 <= F.col("length") * MAX_STRETCH)
    return spans.where(good).select("doc_id", "__text", "label", "template", "first", "last", "votes", "cover")


def phrase_places(phrases=PHRASES) -> Column:
    """struct(n: words, places: array of (at, label) where a phrase's words stand one after another) of the column text.
    Only texts with the word that all phrases share are searched for places."""
    shared = set.intersection(*(set(p.split()) for p, _ in phrases))
    parts = []
    for phrase, label in phrases:
        words = phrase.split()
        same = " AND ".join(f"get(w, i + {k}) <=> '{x}'" for k, x in enumerate(words))
        parts.append(f"transform(filter(sequence(0, greatest(size(w) - {len(words)}, 0)), i -> {same}), i -> struct(i AS at, '{label}' AS label))")
    rare = " AND ".join(f"array_contains(w, '{x}')" for x in sorted(shared)) or "true"
    return F.expr(f"""transform(array({_WORDS}), w -> struct(
        size(w) AS n,
        if({rare} , concat({", ".join(parts)}), cast(array() AS array<struct<at: int, label: string>>)) AS places))[0]""")


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs (doc_id, text).

    The score is the best cover of a verified span, 1 where a phrase stands, else 0. Null and empty texts have no word
    and no label.
    """
    spans = license_spans(docs, templates).groupBy(F.col("doc_id").alias("__id"), F.col("__text").alias("__hash")).agg(F.collect_set("label").alias("found"), F.max("cover").alias("cover"))
    base = docs.select("doc_id", text_hash().alias("__text"), phrase_places(phrases).alias("__base"))
    base = base.select("doc_id", "__text", F.col("__base.n").cast("long").alias("n_words"), F.col("__base.places").alias("__places"))
    joined = base.join(spans, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__hash")), "left")
    own = F.array_distinct(F.col("__places.label"))
    every = F.array_distinct(F.concat(own, F.coalesce("found", F.array().cast("array<string>"))))
    n = F.size("__places")
    return joined.select(
        "doc_id", "n_words", n.cast("long").alias("n_base"), F.array_min("__places.at").cast("long").alias("first_word"), F.array_max("__places.at").cast("long").alias("last_word"),
        F.array_join(F.sort_array(own), ",").alias("base_labels"), F.array_join(F.sort_array(every), ",").alias("labels"),
        F.greatest(F.coalesce("cover", F.lit(0.0)), F.when(n > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql() -> str:
    grams = ", ".join(f"({t}, '{label}', {i}, {len(w)}, '{w[i]}', '{w[i + 1]}', '{w[i + 2]}')" for t, (label, text) in enumerate(TEMPLATES) for w in [text.split()] for i in range(len(w) - 2))
    places = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS ofs, '{label}' AS label FROM u WHERE " + " AND ".join(f"{c} = '{w}'" for c, w in zip("abc", phrase.split())) for phrase, label in PHRASES
    )
    return rf"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
u AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
places AS ({places}),
base AS (SELECT doc_id, count(*) AS n, min(ofs) AS p0, max(ofs) AS p1, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY 1),
grams(template, label, ofs, length, a, b, c) AS (VALUES {grams}),
diagonals AS (SELECT doc_id, template, label, length, i - 1 - ofs AS diagonal, list(DISTINCT ofs) AS ats, min(i - 1) AS p0, max(i - 1) AS p1 FROM u JOIN grams USING (a, b, c) GROUP BY ALL),
cuts AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {MERGE} THEN 0 ELSE 1 END AS cut FROM diagonals),
islands AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS island FROM cuts),
cover AS (SELECT doc_id, template, label, length, island, count(DISTINCT p) AS n, max(p1) + {GRAM} - min(p0) AS stretch
  FROM (SELECT doc_id, template, label, length, island, p0, p1, unnest(flatten([[x, x + 1, x + 2] FOR x IN ats])) AS p FROM islands) GROUP BY ALL),
found AS (SELECT doc_id, label, CAST(n AS DOUBLE) / length AS cover FROM cover WHERE CAST(n AS DOUBLE) / length >= {MIN_COVER} AND stretch <= length * {MAX_STRETCH}),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS cover
  FROM (SELECT doc_id, label, cover FROM found UNION ALL SELECT doc_id, label, 1.0 FROM places) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base, CAST(base.p0 AS BIGINT) AS first_word, CAST(base.p1 AS BIGINT) AS last_word,
  coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels, CAST(coalesce(every.cover, 0) AS DOUBLE) AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id)"""


SQL = {"op7_license_scan": _sql()}
