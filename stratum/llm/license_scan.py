"""License scans by diagonal voting, on DataFrame functions alone.

Every place of a text gives the hash of the two words that start there; those of all templates are joined to
them. A hit at word p of a text and word q of a template votes for diagonal p - q. Diagonals that lie within a
few words of each other are merged, so that an inserted or dropped word does not split a notice, and what is
left is verified: a span counts if enough of the template's word pairs were found on it, and no more than twice the
template's words apart (diagonals that follow one another can wander off). Base phrases are exact: all pairs, on one
diagonal.

Templates are a fixed list, far below any broadcast limit. The only shuffles carry one narrow row per document
and one per hit; texts are read once and never moved.

Cases: null and empty texts give zero counts and empty labels; repeated rows give repeated results (rows are
grouped by id, text hash and their number); very long texts are scanned whole; a null id is an id of its own; an empty
table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_hash

#: What parts words, and the base phrases with their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: The method's own templates.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-2.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
#: Least share of a template's word pairs on a span, and how far apart diagonals may be to merge.
COVERED, DRIFT = 0.75, 3


def lower_ascii(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def template_pairs() -> list[tuple[int, int, str, str, int, int, str]]:
    """(template, position, word, next word, pairs in the template, 1 for a base phrase, label)."""
    rows = []
    for tid, (phrase, label) in enumerate((*BASE, *TEMPLATES)):
        words = phrase.split(" ")
        for q, (a, b) in enumerate(zip(words, words[1:])):
            rows.append((tid, q, a, b, len(words) - 1, int(tid < len(BASE)), label))
    return rows


def scan_licenses(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    pairs = spark.createDataFrame(template_pairs(), "tid int, q int, a string, b string, t_pairs int, t_base int, label string")
    pairs = F.broadcast(pairs.select("*", F.xxhash64("a", "b").alias("gram")))
    words = F.regexp_extract_all(lower_ascii(F.col(text)), F.lit(WORD), F.lit(0))
    rows = docs.select(F.col(key).alias("k"), text_hash(text).alias("h"), words.alias("words"))
    rows = rows.select("k", "h", F.size("words").cast("long").alias("n_words"), F.arrays_zip(F.col("words").alias("a"), F.expr("slice(words, 2, greatest(size(words), 1))").alias("b")).alias("grams"))
    rows = rows.select("k", "h", "n_words", F.posexplode_outer("grams").alias("p", "g"))
    rows = rows.select("k", "h", "n_words", F.coalesce("p", F.lit(0)).alias("p"), F.col("g.a").alias("x"), F.col("g.b").alias("y"), F.xxhash64("g.a", "g.b").alias("gram"))
    hits = rows.join(pairs, (rows.gram == pairs.gram) & (rows.x == pairs.a) & (rows.y == pairs.b), "left")
    # The first place of each text stays even without a hit; its count tells how often the same row is there.
    hits = hits.where("tid IS NOT NULL OR p = 0").groupBy("k", "h", "n_words", "p", "tid", "q", "t_pairs", "t_base", "label").agg(F.count("*").alias("n"))
    by = ["k", "h", "n_words"]
    diagonals = hits.groupBy(*by, "tid", "t_pairs", "t_base", "label", (F.col("p") - F.col("q")).alias("diagonal")).agg(
        F.max(F.when(F.col("p") == 0, F.col("n"))).alias("n"), F.min("p").alias("start"), F.max("p").alias("stop"), F.collect_set("q").alias("qs")
    )
    along = Window.partitionBy(*by, "tid").orderBy("diagonal")
    near = (F.col("t_base") == 0) & (F.col("diagonal") - F.lag("diagonal").over(along) <= DRIFT)
    merged = diagonals.withColumn("apart", F.when(near, 0).otherwise(1)).withColumn("span", F.sum("apart").over(along))
    spans = merged.groupBy(*by, "tid", "t_pairs", "t_base", "label", "span").agg(
        F.max("n").alias("n"), F.min("start").cast("long").alias("start"), F.max("stop").alias("stop"), F.size(F.array_distinct(F.flatten(F.collect_list("qs")))).alias("found")
    )
    share = F.col("found") / F.col("t_pairs")
    good = F.when(F.col("t_base") == 1, F.col("found") == F.col("t_pairs")).otherwise((share >= COVERED) & (F.col("stop") - F.col("start") < 2 * (F.col("t_pairs") + 1)))
    base = good & (F.col("t_base") == 1)
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = spans.groupBy(*by).agg(
        F.max("n").alias("n"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        listed(F.when(base, F.col("label"))).alias("base_labels"),
        listed(F.when(good, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(good, share)), F.lit(0.0)).alias("score"),
    )
    return out.select(
        F.col("k").alias(key), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy")
    ).drop("copy")


def scan_licenses_sql(docs: str = "documents") -> str:
    """The same in DuckDB SQL; repeated rows of one id must not occur."""
    values = ", ".join(f"({t}, {q}, '{a}', '{b}', {n}, {base}, '{label}')" for t, q, a, b, n, base, label in template_pairs())
    word = WORD.replace("'", "''")
    return f"""
WITH pairs(tid, q, a, b, t_pairs, t_base, label) AS (VALUES {values}),
texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{word}') AS words FROM {docs}),
places AS (SELECT doc_id, unnest(words) AS x, generate_subscripts(words, 1) - 1 AS p FROM texts),
grams AS (SELECT doc_id, p, x, lead(x) OVER (PARTITION BY doc_id ORDER BY p) AS y FROM places),
diagonals AS (
  SELECT doc_id, tid, t_pairs, t_base, label, p - q AS diagonal, min(p) AS start, max(p) AS stop, list(DISTINCT q) AS qs
  FROM grams JOIN pairs ON x = a AND y = b GROUP BY ALL),
marked AS (
  SELECT *, CASE WHEN t_base = 0 AND diagonal - lag(diagonal) OVER (PARTITION BY doc_id, tid ORDER BY diagonal) <= {DRIFT} THEN 0 ELSE 1 END AS apart FROM diagonals),
merged AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, tid ORDER BY diagonal) AS span FROM marked),
spans AS (
  SELECT doc_id, tid, t_pairs, t_base, label, span, min(start) AS start, max(stop) AS stop, len(list_distinct(flatten(list(qs)))) AS found FROM merged GROUP BY ALL),
good AS (
  SELECT *, found::DOUBLE / t_pairs AS share FROM spans
  WHERE CASE WHEN t_base = 1 THEN found = t_pairs ELSE found::DOUBLE / t_pairs >= {COVERED} AND stop - start < 2 * (t_pairs + 1) END),
each AS (
  SELECT doc_id, count(*) FILTER (t_base = 1) AS n_base, min(start) FILTER (t_base = 1) AS first_word, max(start) FILTER (t_base = 1) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (t_base = 1) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM good GROUP BY doc_id)
SELECT t.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM texts t LEFT JOIN each USING (doc_id)"""
