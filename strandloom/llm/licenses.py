"""License scan by diagonal voting.

All rolling word k-grams of all texts are hashed and joined by Spark with the
positions of the same k-grams in the templates (a constant table of a few
hundred rows, so it is broadcast). Each match votes for the diagonal (position
in the text minus position in the template); votes are counted by diagonal,
neighbouring diagonals are merged, and spans are verified: a short phrase needs
every vote on one diagonal, a longer notice ``COVER`` of its votes.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Phrases and notices beyond the base; a notice may be reworded in part.
PHRASES = {
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "mozilla public license": "mpl",
    "gnu lesser general public license": "lgpl",
    "bsd license": "bsd",
}
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-notice",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-notice",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-notice",
}
#: A k-gram of these words alone casts no vote in a notice.
STOP = set("a and any as at by for in is it may of on or that the this to under with you".split())
K = 2
COVER, SLACK = 0.8, 3

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def templates() -> list[tuple[int, str, str, int, list[tuple[int, list[str]]]]]:
    """(number, kind, label, votes, [(position, k-gram)])."""
    out = []
    for kind, known in (("base", BASE), ("phrase", PHRASES), ("notice", NOTICES)):
        for phrase, label in known.items():
            w = phrase.split()
            grams = [(p, w[p : p + K]) for p in range(len(w) - K + 1)]
            if kind == "notice":
                grams = [(p, g) for p, g in grams if not STOP.issuperset(g)]
            out.append((len(out), kind, label, len(grams), grams))
    return out


def template_positions(spark: SparkSession) -> DataFrame:
    rows = [(n, kind, label, votes, p, *g) for n, kind, label, votes, grams in templates() for p, g in grams]
    names = ", ".join(f"({n}, '{kind}', '{label}', {votes}, {p}, '{a}', '{b}')" for n, kind, label, votes, p, a, b in rows)
    known = spark.sql(f"SELECT * FROM VALUES {names} AS t(template, kind, label, votes, tpos, w1, w2)")
    # One row that every text meets once, so that texts without matches stay.
    text_row = spark.sql("SELECT -1 AS template, 'text' AS kind, '' AS label, 1 AS votes, 0 AS tpos, '' AS w1, '' AS w2")
    return known.union(text_row).withColumn("h", F.xxhash64("w1", "w2"))


def scan_licenses(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's key, n_words, its places of templates and its labels.

    places: array of (kind, label, start, coverage) of verified spans, start in
    words; labels: all verified labels. Null counts as empty and has no words.
    Repeated rows each get their own row; rows of one key with other texts are
    kept apart. Texts are read whole. One shuffle, of matches only.
    """
    spark = docs.sparkSession
    # Lower-casing beyond A-Z can't change which words are equal to a phrase's or where words begin.
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SEPARATORS), "")
    split = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("t"), words.alias("w"))
    grams = F.transform("w", lambda x, i: F.struct(i.alias("pos"), x.alias("a"), F.get("w", i + 1).alias("b")))
    grams = F.transform(F.filter(grams, lambda g: g["b"].isNotNull()), lambda g: F.struct(g["pos"].alias("pos"), F.xxhash64(g["a"], g["b"]).alias("h")))
    whole = F.array(F.struct(F.size("w").alias("pos"), F.xxhash64(F.lit(""), F.lit("")).alias("h")))
    every = split.select("k", "t", "w", F.explode(F.concat(whole, grams)).alias("g"))
    known = F.broadcast(template_positions(spark))
    same = (F.col("template") < 0) | ((F.get("w", F.col("g.pos")) == F.col("w1")) & (F.get("w", F.col("g.pos") + 1) == F.col("w2")))
    votes = every.join(known, every["g.h"] == known["h"]).where(same).select("k", "t", "template", "kind", "label", "votes", "tpos", (F.col("g.pos") - F.col("tpos")).alias("diagonal"))
    votes = votes.repartition("k", "t")

    lines = votes.groupBy("k", "t", "template", "kind", "label", "votes", "diagonal").agg(F.collect_set("tpos").alias("seen"), F.count("*").alias("n"))
    order = Window.partitionBy("k", "t", "template").orderBy("diagonal")
    apart = (F.col("kind") != "notice") | (F.col("diagonal") - F.lag("diagonal", 1, -(1 << 30)).over(order) > SLACK)
    lines = lines.withColumn("__new", apart.cast("int")).withColumn("island", F.sum("__new").over(order))
    spans = lines.groupBy("k", "t", "template", "kind", "label", "votes", "island").agg(F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"), F.min("diagonal").alias("start"), F.max("n").alias("n"))
    spans = spans.withColumn("coverage", F.size("seen") / F.col("votes"))
    verified = F.when(F.col("kind") == "notice", F.col("coverage") >= COVER).otherwise(F.col("coverage") == 1.0)
    place = F.when(verified & (F.col("kind") != "text"), F.struct("kind", "label", F.greatest("start", F.lit(0)).cast("long").alias("start"), "coverage"))
    own = F.col("kind") == "text"
    found = spans.groupBy("k", "t").agg(
        F.max(F.when(own, F.col("start"))).cast("long").alias("n_words"),
        F.max(F.when(own, F.col("n"))).alias("__copies"),
        F.collect_list(place).alias("places"),
    )
    found = found.withColumn("__c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return found.select(F.col("k").alias(key), "n_words", F.array_sort("places").alias("places"), F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"]))).alias("labels"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the base phrases in every document, and all labels."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["kind"] == "base")
    starts = F.transform(base, lambda p: p["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda p: p["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["coverage"])), F.lit(0.0)).alias("score"),
    )


def brute_places(text: str | None, phrases: dict[str, str]) -> list[tuple[str, int]]:
    """Every place of every phrase, word by word; for tests."""
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return [(label, k) for phrase, label in phrases.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]


def _sql() -> str:
    """The base phrases and the further phrases; no notice is in the tables."""
    w = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    known = ", ".join(f"('{k}', '{p}', '{label}', {len(p.split())})" for k, of in (("base", BASE), ("phrase", PHRASES)) for p, label in of.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {w} AS w FROM documents),
p(kind, phrase, label, n) AS (VALUES {known}),
g AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS k FROM d),
o AS (SELECT g.r, p.kind, p.label, g.k - 1 AS k FROM g JOIN p ON g.w[g.k] = split_part(p.phrase, ' ', 1) AND array_to_string(g.w[g.k : g.k + p.n - 1], ' ') = p.phrase),
s AS (SELECT r, count(*) FILTER (kind = 'base') AS n_base, min(k) FILTER (kind = 'base') AS first_word, max(k) FILTER (kind = 'base') AS last_word,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kind = 'base') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM o GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN labels IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS score
FROM d LEFT JOIN s ON d.r = s.r"""


SQL = {"op10_licenses": _sql()}
