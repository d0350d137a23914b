"""License scans by diagonal voting.

Every rolling word pair of every text votes, where a template has the same pair, for the diagonal
``position in the text - position in the template``. A phrase stands wherever all its pairs vote
for one diagonal. For longer notices neighbouring diagonals (a word added or lost) are merged and
the span is verified by the share of the notice's pairs that it holds.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerweave.llm.common import query, table, words

# The phrases of the contract and openings of public licence notices.
PHRASES = [
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
]
NOTICES = [
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
    ),
    (
        "apache",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
    ),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc", "licensed under a creative commons attribution 4 0 international license"),
]

DRIFT, COVERAGE = 3, 0.6


def template_pairs(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row per word pair of each template: a fixed table of a few hundred rows."""
    rows = []
    for t, (label, text) in enumerate([*phrases, *notices]):
        w = re.findall("[a-z0-9]+", text)
        for i in range(len(w) - 1):
            rows.append((t, label, t < len(phrases), len(w) - 1, i, w[i], w[i + 1]))
    pairs = spark.createDataFrame(
        rows, "template int, label string, phrase boolean, n_pairs int, at int, w1 string, w2 string"
    )
    return pairs.withColumn("hash", F.xxhash64("w1", "w2"))


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    drift: int = DRIFT,
    coverage: float = COVERAGE,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    notices: Sequence[tuple[str, str]] = NOTICES,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans`` holds (label, start, end, coverage) of every verified span, words from 0, end
    exclusive. ``score`` is the best coverage of a verified span, 0 without one. Null or empty
    text has no words and no spans, an empty table no rows. Texts are scanned whole, in time linear in their
    length; of spans that tie in all but the template both are listed. Rows with equal or null ids keep
    rows of their own; other columns are ignored. The votes of one text meet in one task, as its words do.
    ``phrases`` and ``notices`` are (label, text in lower-case words) pairs.
    """
    pairs = F.broadcast(template_pairs(docs.sparkSession, phrases, notices))  # the caller's list
    w = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), words(F.col(text_col)).alias("_w")
    )
    # a pair carries its two words, so no exploded row carries the text
    rolling = F.transform(
        "_w",
        lambda a, i: F.struct(
            F.xxhash64(a, F.get("_w", i + 1)).alias("hash"), a.alias("first"), F.get("_w", i + 1).alias("second")
        ),
    )
    # one more element per text, so that a text without votes still leaves a row
    none = F.array(F.lit(None).cast("struct<hash:bigint,first:string,second:string>"))
    rolled = w.select("_row", "_id", F.size("_w").cast("long").alias("n_words"), F.concat(rolling, none).alias("_pairs"))
    rolled = rolled.select("_row", "_id", "n_words", F.posexplode("_pairs").alias("_pos", "_pair"))
    same = (
        (F.col("_pair.hash") == F.col("hash"))
        & (F.col("_pair.first") == F.col("w1"))
        & (F.col("_pair.second") == F.col("w2"))
    )
    votes = (
        rolled.join(pairs, same, "left")
        .filter(F.col("template").isNotNull() | (F.col("_pos") == F.col("n_words")))
        .select("_row", "_id", "n_words", "template", "label", "phrase", "n_pairs", "at", "_pos")
    )
    keys = ["_row", "_id", "n_words", "template", "label", "phrase", "n_pairs"]
    diagonals = (
        votes.withColumn("diagonal", F.when(F.col("template").isNotNull(), F.col("_pos") - F.col("at")))
        .repartition("_row")
        .groupBy(*keys, "diagonal")
        .agg(F.min("_pos").alias("lo"), F.max("_pos").alias("hi"), F.collect_set("at").alias("ats"))
    )
    along = Window.partitionBy("_row", "template").orderBy("diagonal")
    apart = F.when(F.col("phrase"), 0).otherwise(drift)
    near = F.col("diagonal") - F.lag("diagonal").over(along) <= apart
    merged = (
        diagonals.withColumn("_new", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1))
        .withColumn("_group", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_group")
        .agg(
            F.min("lo").cast("long").alias("start"),
            (F.max("hi") + 2).cast("long").alias("end"),
            F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("held"),
        )
    )
    share = F.col("held") / F.col("n_pairs")
    # a span may be longer than its template by what the drift allows, else its votes are scattered
    fits = F.col("end") - F.col("start") <= (F.col("n_pairs") + 1) * 1.5 + drift
    verified = F.when(F.col("phrase"), F.col("held") == F.col("n_pairs")).otherwise((share >= coverage) & fits)
    ok = F.coalesce(verified, F.lit(False))
    base = ok & F.col("phrase")
    found = merged.groupBy("_row").agg(
        F.first("_id").alias(id_col),
        F.max("n_words").alias("n_words"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(ok, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(ok, share)), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(ok, F.struct("label", "start", "end", share.alias("coverage"))))).alias(
            "spans"
        ),
    )
    return found.drop("_row")


@query("op1_license_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")
