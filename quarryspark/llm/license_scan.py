"""License mentions and notices by diagonal voting, in SQL expressions alone.

Every word of every text begins a k-gram; the hashes of all of them are joined to those of
the templates' k-grams, a small fixed table. A hit votes for the diagonal ``position in the
text - position in the template`` on which the rest of the template would lie. Votes are
gathered by diagonal; neighbouring diagonals, which words put in or left out part, are merged;
and a span counts if it is verified: hits are confirmed word by word as they are joined, and
the words that a span's votes cover must be enough of the template, in a span not much longer.

Templates of two kinds:

* phrases: every word must stand there, in order, with nothing between. All k-grams vote for
  one diagonal then, so a full diagonal is one place. k is 2.
* notices: ``min_cover`` of the words must be covered, with up to ``gap`` words more or fewer
  between parts. Looked up by the hash of two words like phrases; a hit must agree on
  ``notice_gram`` words.

Rows are told apart by a 128-bit hash of id and text, so what is said of a row depends on
these two; equal rows get equal results. Texts are read once; what is kept of them, and
shuffled, are hits, few, and one small row a document. Memory is bounded by one text and the templates.

Cases: null and empty texts, and texts without words, have no labels, a score of 0 and null
positions; equal rows are answered each; null ids stay null; ties cannot arise, as all spans
count; an empty table gives no rows; columns other than id and text are not read, so they may
have any name. A template of fewer than two words is a ValueError.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryspark.runtime import materialize, quoted

#: what a word is once A-Z are lower-cased, and what parts words
WORD, BETWEEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False


#: fixed values: phrases and their labels
PHRASES = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
)
#: fixed values: opening sentences of well-known notices
NOTICES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"),
    Template("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the license"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3"),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
)
LICENSES = PHRASES + NOTICES


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null of null. Splitting is linear, where extracting all matches copies the text for each."""
    return F.array_remove(F.split(F.translate(text, ascii_uppercase, ascii_lowercase), BETWEEN), "")


def template_grams(spark: SparkSession, templates: tuple[Template, ...], notice_gram: int = 4) -> DataFrame:
    """(template, label, phrase, size, at, pair, gram): a row for each k-gram of each template."""
    for t in templates:
        if len(re.findall(WORD, t.text.lower())) < 2:
            raise ValueError(f"a template has two words at least: {t.text!r}")
    rows = json.dumps([{"template": k, "label": t.label, "phrase": t.phrase, "text": t.text} for k, t in enumerate(templates)])
    t = spark.range(1).select(F.explode(F.from_json(F.lit(rows), "array<struct<template int, label string, phrase boolean, text string>>")).alias("t")).select("t.*").withColumn("w", words(F.col("text")))
    size = F.size("w")
    k = F.when(F.col("phrase"), 2).otherwise(F.least(size, F.lit(notice_gram)))
    grams = t.select("template", "label", "phrase", size.alias("size"), "w", k.alias("k"), F.explode(F.sequence(F.lit(0), size - k)).alias("at"))
    first = lambda n: F.get("w", F.col("at") + n)
    return grams.select("template", "label", "phrase", "size", "at", F.xxhash64(first(0), first(1)).alias("pair"), F.slice("w", F.col("at") + 1, F.col("k")).alias("gram"))


def _keys(id_col: str, text_col: str) -> list[Column]:
    """128 bits of a row's id and text."""
    i, t = quoted([id_col, text_col])
    return [F.xxhash64(F.lit(1), i, t).alias("_k1"), F.xxhash64(F.lit(2), t, i).alias("_k2")]


def marked_words(docs: DataFrame, templates: tuple[Template, ...] = LICENSES, *, notice_gram: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_k1, _k2, _id, n_words, template, label, phrase, size, k, at, pos): a row for each k-gram hit, and one without template for each row of ``docs``.

    One pass over the texts. A place before the first word, which nothing matches, stands for the row.
    """
    grams = template_grams(docs.sparkSession, templates, notice_gram)
    i, text = (F.col(c) for c in quoted([id_col, text_col]))
    split = docs.select(*_keys(id_col, text_col), i.alias("_id"), F.coalesce(words(text), F.array().cast("array<string>")).alias("w"))
    placed = split.select("_k1", "_k2", "_id", "w", F.posexplode_outer(F.concat(F.array(F.lit(None).cast("string")), "w")).alias("pos", "word"))
    pair = F.xxhash64("word", F.get("w", F.col("pos")))
    same = (F.col("pos") > 0) & (pair == F.col("pair")) & (F.slice("w", F.greatest("pos", F.lit(1)), F.size("gram")) == F.col("gram"))
    # the templates are the call's arguments, so their table is no larger than the call
    hits = placed.join(F.broadcast(grams), same, "left").filter("pos = 0 OR template IS NOT NULL")
    return hits.select("_k1", "_k2", F.when(F.col("pos") == 0, F.col("_id")).alias("_id"), F.size("w").alias("n_words"), "template", "label", "phrase", "size", F.size("gram").alias("k"), "at", (F.col("pos") - 1).alias("pos"))


def license_spans(marked: DataFrame, *, min_cover: float = 0.6, gap: int = 5) -> DataFrame:
    """(_k1, _k2, label, phrase, first, last, score) of ``marked_words``: verified spans, words counted from 0."""
    row = ["_k1", "_k2", "template", "label", "phrase", "size", "k"]
    # equal rows vote alike, so a diagonal's votes are a set
    votes = marked.filter("template IS NOT NULL").groupBy(*row, (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("hits"))
    line = Window.partitionBy("_k1", "_k2", "template").orderBy("diagonal")
    apart = F.col("phrase") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(line) > gap, F.lit(True))
    merged = votes.withColumn("_new", apart.cast("int")).withColumn("part", F.sum("_new").over(line))
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda a: F.sequence(a, a + F.col("k") - 1))))
    stands = F.col("diagonal") + F.col("at")
    each = merged.select(*row, "part", "diagonal", F.explode(covered).alias("at")).groupBy(*row, "part", "at").agg(F.min(stands).alias("first"), F.max(stands).alias("last"))
    spans = each.groupBy(*row, "part").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    score = F.col("n") / F.greatest(F.col("size"), F.col("last") - F.col("first") + 1)
    enough = F.when(F.col("phrase"), F.col("n") == F.col("size")).otherwise(score >= min_cover)
    return spans.filter(enough).select("_k1", "_k2", "label", "phrase", "first", "last", score.alias("score"))


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = LICENSES, *, min_cover: float = 0.6, gap: int = 5, notice_gram: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans) of every row; ``base``: phrases."""
    marked = materialize(marked_words(docs, templates, notice_gram=notice_gram, id_col=id_col, text_col=text_col))
    base = F.when(F.col("phrase"), F.col("first"))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = license_spans(marked, min_cover=min_cover, gap=gap).groupBy(F.col("_k1").alias("_f1"), F.col("_k2").alias("_f2")).agg(
        F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"), listed(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"), listed("label").alias("labels"), F.max("score").alias("score"), F.count(F.lit(1)).alias("n_spans"),
    )
    rows = marked.filter("pos = -1").select("_k1", "_k2", "_id", "n_words")
    out = rows.join(found, (F.col("_k1") == F.col("_f1")) & (F.col("_k2") == F.col("_f2")), "left")
    or_none = lambda c, none: F.coalesce(F.col(c), F.lit(none)).alias(c)
    return out.select(
        F.col("_id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), or_none("n_base", 0).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        or_none("base_labels", ""), or_none("labels", ""), or_none("score", 0.0), or_none("n_spans", 0).cast("long").alias("n_spans"),
    )
