"""License scans by diagonal voting.

Every rolling word k-gram of every document is joined, by its hash, to the positions at which templates
hold it. A hit votes for the diagonal (position in the document less position in the template);
neighbouring diagonals merge, since a word more or less shifts the rest by one; a merged diagonal is a
license where its distinct votes cover enough of the template and its span is about as long as it.

Built-in functions only. Templates are a fixed list, so their grams are broadcast. Texts are read once: the
words of each are counted, and of its grams those are written that begin like a template's; the join, the
votes and the result rest on these short rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodegraph.llm.common import GAP, durable, table
from lodegraph.llm.native_spans import let

#: The phrases of the base form and their labels; every place counts, word for word.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Notices, by label.
NOTICES = (
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
#: Words of a gram in phrases and in notices; diagonals this near merge; the share of a notice's grams that must vote, and the span it may take, as shares of its length.
PHRASE_GRAM, NOTICE_GRAM, NEAR, COVER, SPAN_SHARES = 2, 4, 4, 0.5, (0.5, 2.0)


def words(text: Column) -> Column:
    """Words with A-Z in lower case. lower() also folds other letters, which moves no word's bounds."""
    return F.filter(F.split(F.lower(text), GAP, -1), lambda w: w != "")


def gram_hashes(w: Column) -> Column:
    """For each word: its position i, the word, and the hashes of the short and the long gram that begin there."""
    ahead = lambda ws, i, n: [F.get(ws, i + j) for j in range(n)]
    return let(w, lambda ws: F.transform(ws, lambda x, i: F.struct(i.alias("i"), x.alias("w"), F.xxhash64(*ahead(ws, i, PHRASE_GRAM)).alias("h2"), F.xxhash64(*ahead(ws, i, NOTICE_GRAM)).alias("h4"))))


def grams_due(ws: Column, short: list[int]) -> Column:
    """gram_hashes of the words at which one of the short grams begins: the rolling hash of every word's gram is taken, the rest only where it is one of these."""
    ahead = lambda i, n: [F.get(ws, i + j) for j in range(n)]
    rolled = F.transform(ws, lambda x, i: F.struct(i.alias("i"), F.xxhash64(*ahead(i, PHRASE_GRAM)).alias("h2")))
    return F.transform(F.filter(rolled, lambda g: g["h2"].isin(*short)), lambda g: F.struct(g["i"].alias("i"), F.get(ws, g["i"]).alias("w"), g["h2"].alias("h2"), F.xxhash64(*ahead(g["i"], NOTICE_GRAM)).alias("h4")))


def template_grams(spark: SparkSession) -> DataFrame:
    """A row for each gram of each template: tid, label, base, t (its position), grams (of the template), size (its words), tw, t2, t4 (null in phrases)."""
    texts = [(p, label, True) for p, label in PHRASES] + [(n, label, False) for label, n in NOTICES]
    literal = F.array(*(F.struct(F.lit(k).alias("tid"), F.lit(text).alias("text"), F.lit(label).alias("label"), F.lit(base).alias("base")) for k, (text, label, base) in enumerate(texts)))
    rows = spark.range(1).select(F.inline(literal)).withColumn("w", words(F.col("text")))
    rows = rows.withColumn("size", F.size("w")).withColumn("grams", F.col("size") - F.when(F.col("base"), PHRASE_GRAM).otherwise(NOTICE_GRAM) + 1)
    rows = rows.withColumn("g", F.explode(F.slice(gram_hashes(F.col("w")), F.lit(1), F.col("grams"))))
    return rows.select("tid", "label", "base", "size", "grams", F.col("g.i").alias("t"), F.col("g.w").alias("tw"), F.col("g.h2").alias("t2"), F.when(~F.col("base"), F.col("g.h4")).alias("t4"))


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of base phrases, first_word and last_word are the least and greatest of their
    starts (null without any). Labels are distinct, sorted and comma-joined ("" if none). score is the
    largest share of a template that was found. Null texts count as empty. Rows are told apart by id and
    text; rows equal in both get equal results; a null id is an id like others. Other columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    t = F.coalesce(F.col(text_col), F.lit(""))
    templates = template_grams(spark)
    short = [r["t2"] for r in templates.select("t2").distinct().collect()]  # of the fixed list
    key = ["id", "k1", "k2"]
    read = docs.select(F.col(id_col).alias("id"), F.xxhash64(t).alias("k1"), F.hash(t).alias("k2"), let(words(t), lambda ws: F.struct(F.size(ws).cast("long").alias("n"), grams_due(ws, short).alias("g"))).alias("x"))
    row = durable(read.select(*key, F.col("x.n").alias("n_words"), F.col("x.g").alias("due")), "grams")
    grams = row.select(*key, F.explode("due").alias("g")).select(*key, "g.i", "g.w", "g.h2", "g.h4")
    tg = F.broadcast(templates)
    hits = grams.join(tg, (F.col("h2") == F.col("t2")) & (F.col("w") == F.col("tw")) & (F.col("t4").isNull() | (F.col("h4") == F.col("t4"))))
    # a set of template positions, so that equal rows of docs vote once
    lines = hits.groupBy(*key, "tid", "label", "base", "size", "grams", (F.col("i") - F.col("t")).alias("diagonal")).agg(F.collect_set("t").alias("ts"))

    places = lines.where(F.col("base") & (F.size("ts") == F.col("grams")))
    based = places.groupBy(*key).agg(F.count("*").alias("n_base"), F.min("diagonal").cast("long").alias("first_word"), F.max("diagonal").cast("long").alias("last_word"), F.collect_set("label").alias("base_labels"))

    by_diagonal = Window.partitionBy(*key, "tid").orderBy("diagonal")
    fresh = F.when(F.col("diagonal") - F.lag("diagonal").over(by_diagonal) <= NEAR, 0).otherwise(1)
    merged = lines.where(~F.col("base")).withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(by_diagonal))
    merged = merged.select(*key, "tid", "label", "size", "grams", "run", "diagonal", F.explode("ts").alias("at"))
    spans = merged.groupBy(*key, "tid", "label", "size", "grams", "run").agg(
        (F.countDistinct("at") / F.first("grams")).alias("cover"), ((F.max(F.col("diagonal") + F.col("at")) - F.min(F.col("diagonal") + F.col("at")) + NOTICE_GRAM) / F.first("size")).alias("stretch")
    )
    noticed = spans.where((F.col("cover") >= COVER) & F.col("stretch").between(*SPAN_SHARES)).groupBy(*key).agg(F.collect_set("label").alias("notice_labels"), F.max("cover").alias("cover"))

    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["k1"] == b["k1"]) & (a["k2"] == b["k2"])
    out = row.select(*key, "n_words").alias("d")
    out = out.join(based.alias("b"), same(out, based), "left").select("d.*", "n_base", "first_word", "last_word", "base_labels")
    noticed = noticed.select(F.col("id").alias("nid"), F.col("k1").alias("n1"), F.col("k2").alias("n2"), "notice_labels", "cover")
    out = out.join(noticed, out["id"].eqNullSafe(noticed["nid"]) & (out["k1"] == noticed["n1"]) & (out["k2"] == noticed["n2"]), "left")
    none = F.array().cast(T.ArrayType(T.StringType()))
    base_labels, more = F.coalesce("base_labels", none), F.coalesce("notice_labels", none)
    joined = lambda a: F.array_join(F.array_sort(a), ",")
    return out.select(
        F.col("id").cast(kind).alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        joined(base_labels).alias("base_labels"), joined(F.array_union(base_labels, more)).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"),
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(table(spark, sf_dir, "documents"))


def _words_sql(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '{GAP}'), lambda x: x <> '')"


def _oracle() -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    phrases = " UNION ALL ".join(f"SELECT r, unnest(list_filter(range(0, len(w) - {len(p.split()) - 1}), lambda i: w[i + 1 : i + {len(p.split())}] = {p.split()!r})) AS place, '{label}' AS label FROM d" for p, label in PHRASES)
    notices = ", ".join(f"({k}, '{label}', {quoted(text)})" for k, (label, text) in enumerate(NOTICES))
    gram = lambda w, i: f"array_to_string({w}[{i} + 1 : {i} + {NOTICE_GRAM}], ' ')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words_sql("coalesce(text, '')")} AS w FROM documents),
p AS ({phrases}),
based AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list_distinct(list(label))) AS base_labels FROM p GROUP BY r),
t AS (SELECT tid, label, {_words_sql("text")} AS w FROM (VALUES {notices}) AS v(tid, label, text)),
tg AS (SELECT tid, label, len(w) AS size, len(w) - {NOTICE_GRAM - 1} AS grams, t, {gram("w", "t")} AS g FROM (SELECT *, unnest(range(0, len(w) - {NOTICE_GRAM - 1})) AS t FROM t)),
dg AS (SELECT r, i, {gram("w", "i")} AS g FROM (SELECT r, w, unnest(range(0, len(w) - {NOTICE_GRAM - 1})) AS i FROM d)),
h AS (SELECT DISTINCT r, tid, label, size, grams, i - t AS diagonal, t FROM dg JOIN tg USING (g)),
q AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, tid ORDER BY diagonal) <= {NEAR} THEN 0 ELSE 1 END AS fresh FROM (SELECT DISTINCT r, tid, diagonal FROM h)),
runs AS (SELECT r, tid, diagonal, sum(fresh) OVER (PARTITION BY r, tid ORDER BY diagonal) AS run FROM q),
s AS (SELECT r, label, count(DISTINCT t) / grams AS cover, (max(diagonal + t) - min(diagonal + t) + {NOTICE_GRAM}) / size AS stretch FROM h JOIN runs USING (r, tid, diagonal) GROUP BY r, tid, label, size, grams, run),
noticed AS (SELECT r, list_distinct(list(label)) AS notice_labels, max(cover) AS cover FROM s WHERE cover >= {COVER} AND stretch BETWEEN {SPAN_SHARES[0]} AND {SPAN_SHARES[1]} GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(base_labels, ','), '') AS base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base_labels, []), coalesce(notice_labels, [])))), ','), '') AS labels, (CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(cover, 0.0) END)::DOUBLE AS score
FROM d LEFT JOIN based USING (r) LEFT JOIN noticed USING (r)
"""


QUERIES = {"op6_licenses": op6_licenses}
ORACLES = {"op6_licenses": _oracle()}
