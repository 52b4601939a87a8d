"""License scans by diagonal voting, in DataFrame operations only.

All rolling runs of ``GRAM`` words of all texts are hashed and joined to the positions at which license
templates hold the same run. A hit votes for a diagonal: the word at which the template would start in
the text. Votes are summed up by document, template and diagonal as a bit set of template positions;
diagonals within ``SLACK`` words are merged, which bridges inserted or missing words. A merged span is
verified by the share of the template's runs that stand there word for word: all of them for base phrases
and templates of fewer than ``FUZZY_FROM`` runs, else ``MIN_SHARE``. As the diagonals of a span differ by
``SLACK`` at most, its runs stand in at most ``SLACK`` words more than the template has, each within ``SLACK``
words of its place; runs that are strewn over a longer text don't add up. Spans that follow each other
closely are reported as one, by the best of them.

The templates are a fixed, short list, so their positions are broadcast; a longer list given by the
caller is joined without a hint where it has more than ``BROADCAST_GRAMS`` runs.

Edge cases: null and empty texts have no words; repeated rows get the same result each; overlapping
places count each; null ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.llm.common import words_alnum

GRAM, SLACK, FUZZY_FROM, MIN_SHARE = 2, 3, 5, 0.8
BROADCAST_GRAMS = 100_000

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Words of public license notices and their labels; at most 60 words each.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license": "apache",
    "licensed under the gnu general public license version 3": "gpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under a creative commons attribution": "cc",
    "all rights reserved": "reserved",
}


def positions(base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> list[tuple]:
    """``(template, label, base, n, at, gram)`` of every run of every template."""
    out = []
    for number, (phrase, label) in enumerate([*base.items(), *notices.items()]):
        words = phrase.split()
        if not GRAM <= len(words) <= 60:
            raise ValueError(f"a template has {GRAM} to 60 words: {phrase!r}")
        n = len(words) - GRAM + 1
        out += [(number, label, number < len(base), n, i, " ".join(words[i : i + GRAM])) for i in range(n)]
    return out


def _templates(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    names = ("template", "label", "base", "n", "at", "gram")
    values = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(names, r, strict=True)]) for r in rows])
    table = spark.range(1).select(F.inline(values)).withColumn("template_hash", F.xxhash64("gram"))
    return F.broadcast(table) if len(rows) <= BROADCAST_GRAMS else table


def spans(documents: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """Merged diagonals: ``doc_id, text_hash, template, label, base, share, first_word, n_full, first_full, last_full, accepted``."""
    rows = positions(base, notices)
    text = F.col("text").cast("string")
    source = documents.select("doc_id", F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), words_alnum(text).alias("words")).where(F.size("words") >= GRAM)
    run = F.transform(F.sequence(F.lit(0), F.size("words") - GRAM), lambda i: F.concat_ws(" ", *[F.get("words", i + j) for j in range(GRAM)]))
    runs = source.select("doc_id", "text_hash", F.posexplode(run).alias("word", "run"))
    hits = runs.join(_templates(documents.sparkSession, rows), (F.xxhash64("run") == F.col("template_hash")) & (F.col("run") == F.col("gram")))
    by = ["doc_id", "text_hash", "template", "label", "base", "n"]
    # A bit set of template positions: repeated rows of a document add nothing.
    diagonals = hits.groupBy(*by, (F.col("word") - F.col("at")).alias("diagonal")).agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("seen"))
    full = F.col("seen") == F.expr("shiftleft(1L, n) - 1")
    order = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    apart = F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= SLACK, 0).otherwise(1)
    together = F.bit_count(F.bit_or("seen").over(order.rangeBetween(0, SLACK)))
    islands = diagonals.withColumn("apart", apart).withColumn("island", F.sum("apart").over(order)).withColumn("votes", together)
    merged = islands.groupBy(*by, "island").agg(
        F.max("votes").alias("votes"),
        F.min("diagonal").cast("long").alias("first_word"),
        F.sum(full.cast("long")).alias("n_full"),
        F.min(F.when(full, F.col("diagonal"))).cast("long").alias("first_full"),
        F.max(F.when(full, F.col("diagonal"))).cast("long").alias("last_full"),
    )
    share = F.col("votes") / F.col("n")
    fuzzy = ~F.col("base") & (F.col("n") >= FUZZY_FROM)
    accepted = F.when(fuzzy, share >= MIN_SHARE).otherwise(F.col("n_full") > 0)
    return merged.withColumn("share", share).withColumn("accepted", accepted)


def scan(documents: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """One row per document with its number of words, base places, labels and score."""
    only_base = F.col("base") & (F.col("n_full") > 0)
    found = spans(documents, base, notices).where("accepted").groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(
        F.sum(F.when(only_base, F.col("n_full"))).alias("n_base"),
        F.min(F.when(only_base, F.col("first_full"))).alias("first_word"),
        F.max(F.when(only_base, F.col("last_full"))).alias("last_word"),
        F.collect_set(F.when(only_base, F.col("label"))).alias("base_labels"),
        F.collect_set("label").alias("labels"),
        F.max("share").alias("score"),
    )
    text = F.col("text").cast("string")
    sizes = documents.select("doc_id", F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), F.size(words_alnum(text)).cast("long").alias("n_words"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    joined = lambda c: F.coalesce(F.array_join(F.sort_array(c), ","), F.lit(""))
    return sizes.join(found, same, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        joined("base_labels").alias("base_labels"),
        joined("labels").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    """Contract columns over all documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = rf"""
WITH t(template, label, base, n, spot, gram) AS (VALUES {", ".join(f"({t}, '{l}', {b}, {n}, {a}, '{g}')" for t, l, b, n, a, g in positions())}),
d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM documents
), g AS (
  SELECT doc_id, i - 1 AS word, words[i] || ' ' || words[i + 1] AS gram FROM d, unnest(range(1, len(words))) AS u(i)
), h AS (
  SELECT DISTINCT doc_id, template, label, base, n, word - spot AS diagonal, spot FROM g JOIN t ON g.gram = t.gram
), dg AS (
  SELECT doc_id, template, label, base, n, diagonal, bit_or(CAST(1 AS BIGINT) << spot) AS seen FROM h GROUP BY ALL
), ap AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {SLACK} THEN 0 ELSE 1 END AS apart FROM dg
), isl AS (
  SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS island, seen = (CAST(1 AS BIGINT) << n) - 1 AS full_,
         bit_count(bit_or(seen) OVER (PARTITION BY doc_id, template ORDER BY diagonal RANGE BETWEEN CURRENT ROW AND {SLACK} FOLLOWING)) AS together
  FROM ap
), m AS (
  SELECT doc_id, template, label, base, n, island, max(together) AS votes, sum(CAST(full_ AS BIGINT)) AS n_full,
         min(diagonal) FILTER (full_) AS first_full, max(diagonal) FILTER (full_) AS last_full
  FROM isl GROUP BY ALL
), ok AS (
  SELECT *, CAST(votes AS DOUBLE) / n AS share FROM m
  WHERE CASE WHEN NOT base AND n >= {FUZZY_FROM} THEN CAST(votes AS DOUBLE) / n >= {MIN_SHARE} ELSE n_full > 0 END
), f AS (
  SELECT doc_id, sum(n_full) FILTER (base AND n_full > 0) AS n_base, min(first_full) FILTER (base) AS first_word, max(last_full) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND n_full > 0) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM ok GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN f ON d.doc_id = f.doc_id
"""
