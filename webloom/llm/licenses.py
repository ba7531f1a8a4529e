"""License scans by diagonal voting.

Every rolling k-gram of a text's words is hashed and joined with the k-grams of the license templates. A match at
word p of the text and word q of a template votes for the diagonal p - q, the place where the template would begin.
Votes are counted by diagonal, neighbouring diagonals (a few words put in or left out) are merged, and the merged
span is verified: each vote by its words, the span by the share of the template's words that it covers.

The base phrases are templates too; they have to be covered whole on a single diagonal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 3

# The phrases and labels of the base.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
# Sentences of well-known licenses.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text whose A-Z are lower-cased: runs of digits, letters and characters beyond ASCII."""
    # lower() changes more than A-Z, but not in texts of ASCII alone.
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def template_grams(spark, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """Rows (hash, template, label, phrase, length, place, w0 .. w2): the k-grams of all templates; their number is fixed by the lists above."""
    rows = []
    for number, (label, phrase, text) in enumerate([(a, True, b) for a, b in phrases] + [(a, False, b) for a, b in templates]):
        words = text.split()
        rows += [f"({number}, '{label}', {str(phrase).lower()}, {len(words)}, {i}, " + ", ".join(f"'{w}'" for w in words[i : i + K]) + ")" for i in range(len(words) - K + 1)]
    names = [f"w{i}" for i in range(K)]
    table = spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(template, label, phrase, length, place, {', '.join(names)})")
    return table.withColumn("hash", F.xxhash64(*names))


def license_scan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", slack: int = 3, least: float = 0.6, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``slack``: diagonals of one template at most this far apart are merged. ``least``: a span that covers this share
    of its template's words gives the template's label; ``score`` is the largest share covered in the document.
    A null text counts as empty: no words, no labels, score 0. Repeated rows and rows of one id each get their row, a
    null id stays null, an empty table gives no rows, other columns are ignored. Rows are told apart by a number given
    on reading, so ``df`` has to read the same rows in the same order when a task is repeated, as files do.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), words_of(text).alias("words")).withColumn("row", F.monotonically_increasing_id())
    gram = lambda w, i: F.struct(F.xxhash64(w, *[F.get("words", i + j) for j in range(1, K)]).alias("hash"), w.alias("word"))
    none = F.array(F.struct(F.lit(None).cast("long").alias("hash"), F.lit(None).cast("string").alias("word")))
    # The first element, without a hash, stands for the document itself and outlives the join.
    grams = F.concat(none, F.slice(F.transform("words", gram), 1, F.greatest(F.size("words") - (K - 1), F.lit(0))))
    rolled = docs.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.posexplode(grams).alias("at", "gram"))
    rolled = rolled.select("row", "doc_id", "n_words", (F.col("at") - 1).alias("at"), F.col("gram.hash").alias("hash"), F.col("gram.word").alias("word"))
    known = F.broadcast(template_grams(df.sparkSession, phrases, templates))
    votes = rolled.join(known, (rolled["hash"] == known["hash"]) & (rolled["word"] == known["w0"]), "left").where(F.col("at").eqNullSafe(-1) | F.col("template").isNotNull())
    votes = votes.select("row", F.when(F.col("at") == -1, F.col("doc_id")).alias("doc_id"), F.when(F.col("at") == -1, F.col("n_words")).alias("n_words"), "template", "label", "phrase", "length", "place", (F.col("at") - F.col("place")).alias("diagonal"))
    votes = votes.repartition("row")  # all that follows is by row, so this is the only exchange
    diagonals = votes.groupBy("row", "template", "diagonal").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.max("label").alias("label"), F.max("phrase").alias("phrase"), F.max("length").alias("length"), F.collect_set("place").alias("places"))
    by_template = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("phrase") | (F.col("diagonal") - F.lag("diagonal").over(by_template) > slack)
    merged = diagonals.withColumn("span", F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(by_template))
    spans = merged.groupBy("row", "template", "span").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.max("label").alias("label"), F.max("phrase").alias("phrase"), F.max("length").alias("length"), F.min("diagonal").alias("diagonal"), F.flatten(F.collect_list("places")).alias("places"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (K - 1))))))
    spans = spans.withColumn("share", F.when(F.col("length").isNotNull(), covered / F.col("length")).otherwise(F.lit(0.0)))
    base = F.col("phrase") & (F.col("share") == 1)
    found = base | (~F.col("phrase") & (F.col("share") >= least))
    joined = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    return spans.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("diagonal"))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(found).alias("labels"),
        F.max("share").alias("score"),
    ).drop("row")
