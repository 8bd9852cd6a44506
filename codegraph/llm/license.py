"""License scan by diagonal voting: word bigrams of every text joined to template positions.

Each joined pair votes for the diagonal (position in the text less position in the template); votes are sets of
template positions, so repeated texts or words cannot inflate them. Diagonals of longer templates merge with those up
to DRIFT beside them, which allows for words put in or left out and keeps the template's order, however many diagonals
a long text has in a row. A merged span is verified: enough of its template's pairs stand there, and all that decide
(those with a number, as of a version, or with a word that tells the licence from its relatives). The join compares the
words themselves beside their hash, so spans hold no hash collisions. DataFrame operations only.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .shared import key_of, materialise, text_of

# Phrases that count wherever their words stand consecutively, and their labels.
PHRASES = [
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
]
# Wordings of public licences, found where most of their word pairs stand in order. Words in capitals decide.
TEMPLATES = [
    ("licensed under the APACHE license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("released under the MIT license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the GNU GENERAL public license version 3", "gpl-3.0"),
    ("either version 3 of the license or at your option any later version", "gpl-3.0"),
    ("licensed under the GNU GENERAL public license version 2", "gpl-2.0"),
    ("either version 2 of the license or at your option any later version", "gpl-2.0"),
    ("licensed under the gnu LESSER general public license version 3", "lgpl-3.0"),
    ("licensed under the gnu AFFERO general public license version 3", "agpl-3.0"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software"
        " to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"
        " and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "mit",
    ),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that", "bsd"),
    ("this source code form is subject to the terms of the MOZILLA public license", "mpl-2.0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("licensed under a creative commons ATTRIBUTION 4 0 international license", "cc-by-4.0"),
    ("licensed under a creative commons attribution SHAREALIKE 4 0 international license", "cc-by-sa-4.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]
COVERAGE, DRIFT = 0.75, 2
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of ASCII letters, digits and non-ASCII characters, lower-cased.

    lower() also changes non-ASCII capitals; that moves no word boundary and turns nothing into the letters of a phrase
    above (only the Kelvin sign becomes an ASCII letter, k, which no base phrase has).
    """
    return F.array_remove(F.split(F.lower(text), SPLIT, -1), "")


def templates(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Word pairs (_a, _b, _tid, _tpos) and one row per template (_tid, _need, _label, _base, _size, _must): constants of a few hundred rows.

    Words in capitals and numbers decide. _must holds sets of pairs of which one has to stand: the pair of two such words
    side by side, and either pair of one that stands alone.
    """
    pairs, heads = [], []

    def must(decides: list[bool]) -> list[list[int]]:
        last = len(decides) - 1
        alone = [i for i, d in enumerate(decides) if d and not any(decides[max(0, i - 1) : i] + decides[i + 1 : i + 2])]
        return [[i] for i in range(last) if decides[i] and decides[i + 1]] + [[j for j in (i - 1, i) if 0 <= j < last] for i in alone]

    for tid, (phrase, label) in enumerate(PHRASES + TEMPLATES):
        said, base = phrase.split(), tid < len(PHRASES)
        words, decides = phrase.lower().split(), [w.isupper() or w.isdigit() for w in said]
        size = len(words) - 1
        pairs += [(a, b, tid, i) for i, (a, b) in enumerate(zip(words, words[1:]))]
        heads.append((tid, size if base else math.ceil(COVERAGE * size), label, base, size, [] if base else must(decides)))

    def constant(rows: list[tuple], schema: str) -> DataFrame:
        names = [field.split()[0] for field in schema.split(", ")]
        text = json.dumps([dict(zip(names, row, strict=True)) for row in rows])  # one literal, however many rows
        return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>")))

    known = constant(pairs, "_a string, _b string, _tid int, _tpos int").withColumn("_gram", F.xxhash64("_a", "_b"))
    return known, constant(heads, "_tid int, _need int, _label string, _base boolean, _size int, _must array<array<int>>")


def license_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Spans per distinct text: _k1, _k2 (its key), _tid, _label, _base, start (word, from 0), votes, coverage."""
    known, heads = templates(docs.sparkSession)
    text = text_of(text_col)
    words = docs.select(*key_of(text), words_of(text).alias("_w"))
    pairs = words.select("_k1", "_k2", F.posexplode(F.arrays_zip(F.col("_w").alias("x"), F.slice("_w", F.lit(2), F.greatest(F.size("_w"), F.lit(1))).alias("y"))))
    grams = pairs.select("_k1", "_k2", F.col("pos").alias("_pos"), F.col("col.x").alias("_x"), F.col("col.y").alias("_y"))
    grams = grams.withColumn("_g", F.xxhash64("_x", "_y"))
    hit = (F.col("_g") == F.col("_gram")) & (F.col("_x") == F.col("_a")) & (F.col("_y") == F.col("_b"))
    votes = (
        grams.join(F.broadcast(known), hit)
        .withColumn("_diag", F.col("_pos") - F.col("_tpos"))
        .groupBy("_k1", "_k2", "_tid", "_diag")
        .agg(F.collect_set("_tpos").alias("_seen"))  # at most the template's positions
        .join(F.broadcast(heads), "_tid")
    )
    base = votes.filter(F.col("_base") & (F.size("_seen") == F.col("_need")))
    free = votes.filter(~F.col("_base"))
    order = Window.partitionBy("_k1", "_k2", "_tid").orderBy("_diag")
    own, all_ = F.size("_seen"), F.size("_all")
    sound = (
        free.withColumn("_all", F.array_distinct(F.flatten(F.collect_list("_seen").over(order.rangeBetween(-DRIFT, DRIFT)))))
        .filter((all_ >= F.col("_need")) & F.forall("_must", lambda m: F.arrays_overlap(m, F.col("_all"))))
        .withColumn("_gap", F.col("_diag") - F.lag("_diag").over(order))
        .withColumn("_run", F.sum(F.when(F.col("_gap") <= DRIFT, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("_k1", "_k2", "_tid", "_run")
        .agg(F.max(all_).alias("votes"), F.max_by("_diag", F.struct(own, -F.col("_diag"))).cast("long").alias("start"))
        .join(F.broadcast(heads), "_tid")
    )
    columns = ["_k1", "_k2", "_tid", "_label", "_base", "start", "votes"]
    whole = base.withColumn("start", F.col("_diag").cast("long")).withColumn("votes", own)
    return whole.select(*columns, F.lit(1.0).alias("coverage")).unionByName(sound.select(*columns, (F.col("votes") / F.col("_size")).alias("coverage")))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: its id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts every place of a base phrase; score is the best coverage of any span, 0.0 without one. Null text
    counts as empty: no words, null first_word and last_word, empty labels. Repeated rows each get the result of their
    text, whatever their ids; an empty table gives an empty result.
    """
    base_start = F.when(F.col("_base"), F.col("start"))
    found = (
        license_spans(docs, text_col)
        .groupBy("_k1", "_k2")
        .agg(
            F.count(base_start).alias("n_base"),
            F.min(base_start).alias("first_word"),
            F.max(base_start).alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("_base"), F.col("_label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set("_label")), ",").alias("labels"),
            F.max("coverage").alias("score"),
        )
    )
    found = materialise(found, "spans")  # so that the planner may split the rows of a text that many documents share
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("_id"), *key_of(text), F.size(words_of(text)).cast("long").alias("n_words"))
    return rows.join(found, ["_k1", "_k2"], "left").select(
        F.col("_id").alias(id_col),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
