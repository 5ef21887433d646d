"""License scan with a positional index of rare words.

Templates are short characteristic passages of licenses; places where a number or an address stands are
left open. Their words are indexed with template and position. For each file and each template whose
mandatory phrases the file holds, all words of the template are looked up; each occurrence votes for the
template at a relative position, with the weight of the word's rarity in the corpus. Positions up to
``DRIFT`` words apart vote together, so that words put in, left out or replaced don't lose the rest. A
template counts as found where several distinct words agree, hold half of the template's weight, and its
mandatory phrases stand nearby. No template takes the words of another, and none is left out.

Only DataFrame functions are used. A word's document frequency is counted over all documents. The
index has a fixed size and is broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.session import land

# The base phrases and their labels.
PHRASES = {
    "mit": ("mit", "license"),
    "apache": ("apache", "license"),
    "gpl": ("general", "public", "license"),
}

# Passages of public licenses, and phrases that must stand in or near them. * is any word.
TEMPLATES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and"
        " associated documentation files the software to deal in the software without restriction including"
        " without limitation the rights to use copy modify merge publish distribute sublicense and or sell"
        " copies of the software",
        ("free of charge", "without restriction"),
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is"
        " hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ("with or without fee", "hereby granted"),
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided"
        " that the following conditions are met * redistributions of source code must retain the above copyright"
        " notice this list of conditions and the following disclaimer",
        ("source and binary forms", "following conditions"),
    ),
    "apache": (
        "you may not use this file except in compliance with the license you may obtain a copy of the license at"
        " * * * * * * * * unless required by applicable law or agreed to in writing software distributed under the license is"
        " distributed on an as is basis without warranties or conditions of any kind either express or implied",
        ("in compliance with the license", "as is basis"),
    ),
    "gpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu"
        " general public license as published by the free software foundation either version * of the license or"
        " at your option any later version",
        ("free software foundation", "general public license"),
    ),
    "lgpl": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu"
        " lesser general public license as published by the free software foundation either version"
        " * * of the license or at your option any later version",
        ("lesser general public license",),
    ),
    "mpl": (
        "this source code form is subject to the terms of the mozilla public license v * * if a copy of the mpl was"
        " not distributed with this file you can obtain one at",
        ("mozilla public license",),
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify"
        " publish use compile sell or distribute this software either in source code form or as a compiled binary",
        ("unencumbered software", "public domain"),
    ),
    "gpl-notice": ("this work is licensed under the gnu general public license version", ("gnu general public license",)),
    "apache-notice": ("licensed under the apache license version", ("apache license",)),
    "mit-notice": ("released under the mit license", ("mit license",)),
    "cc-by-nc": ("licensed under cc by nc", ("cc by nc",)),
    "cc-by": (
        "this work is licensed under a creative commons attribution international license",
        ("creative commons attribution",),
    ),
}
# Words too common to identify a passage.
COMMON = "* a an and any are as at be by for from if in is it its may not of on one or that the this to was with you".split()

WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Distinct words of a template that must agree, and their part of the weight of all its words.
MIN_VOTES = 3
MIN_SHARE = 0.5
#: Words by which relative positions may differ and still vote together.
DRIFT = 8
#: Words that may lie between a passage and its mandatory phrase.
SLACK = 8


def _vocabulary() -> list[str]:
    words = {w for text, _ in TEMPLATES.values() for w in text.split()}
    return sorted(words - set(COMMON))


def words_of(text: Column) -> Column:
    """The words of a text in order: maximal runs of a-z, 0-9 and characters beyond ASCII, A-Z lowered."""
    # Only the first and the last part can be empty; _trim takes them off.
    return F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), WORD_BREAK, -1)


def _trim(parts: Column) -> Column:
    lead = (F.get(parts, F.lit(0)) == "").cast("int")
    tail = (F.get(parts, F.size(parts) - 1) == "").cast("int")
    n = F.greatest(F.size(parts) - lead - tail, F.lit(0))
    return F.slice(parts, lead + 1, n)


def _phrase_places(words: Column, phrase: tuple[str, ...]) -> Column:
    """Positions of words where the phrase begins."""
    last = F.size(words) - len(phrase)
    there = lambda i: _all([F.get(words, i + k) == w for k, w in enumerate(phrase)])
    found = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), there)
    # Most texts hold none of the phrase's last word, and need no further look.
    return F.when((last >= 0) & F.array_contains(words, phrase[-1]), found).otherwise(F.array().cast("array<int>"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _index(spark: SparkSession, weights: dict[str, float]) -> DataFrame:
    """(word, template, at, weight, total): every place of every vocabulary word, and the template's whole weight."""
    rows = []
    for name in TEMPLATES:
        total = sum(weights[w] for w in _words_in(name))
        words = enumerate(TEMPLATES[name][0].split())
        rows += [(w, name, i, weights[w], total) for i, w in words if w not in COMMON]
    return spark.createDataFrame(rows, "word string, template string, at int, weight double, total double")


def _words_in(name: str) -> list[str]:
    return sorted(set(TEMPLATES[name][0].split()) - set(COMMON))


def _weights(split: DataFrame) -> dict[str, float]:
    """The rarity of each vocabulary word: 1 where all documents hold it, and more the fewer do."""
    # The word "*" is in no text; it counts the documents.
    there = F.concat(F.array_intersect(F.array(*[F.lit(w) for w in _vocabulary()]), F.col("words")), F.array(F.lit("*")))
    seen = split.select(F.explode(there).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    df = {r["word"]: r["n"] for r in seen.collect()}  # a row for each vocabulary word
    return {w: 1 + math.log((df.get("*", 0) + 1) / (df.get(w, 0) + 1)) for w in _vocabulary()}


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, base (array of start and label), found (labels with share).

    base: every place of a base phrase, as (start word, label), in order. found: (label, share) of the
    templates found, where share is the part of the weight of the template's words that agrees.
    Null and empty texts have no words. Repeated rows and rows with a null doc_id are scanned like
    any other. Other columns are ignored.
    """
    spark = docs.sparkSession
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    weights = _weights(split)
    trimmed = split.select("doc_id", _trim(F.col("words")).alias("words"))
    words = F.col("words")

    def base(label: str, phrase: tuple[str, ...]) -> Column:
        return F.transform(
            _phrase_places(words, phrase), lambda i: F.struct(i.alias("start"), F.lit(label).alias("label"))
        )

    phrases = sorted({tuple(p.split()) for _, ps in TEMPLATES.values() for p in ps})
    verified = [F.transform(_phrase_places(words, p), _struct_of(" ".join(p))) for p in phrases]
    rows = trimmed.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.array_sort(F.concat(*[base(k, p) for k, p in PHRASES.items()])).alias("base"),
        F.concat(*verified).alias("phrases"),
        "words",
    )
    # A template without its mandatory phrases can't be found, whatever its votes.
    asked = [F.when(_all([F.exists("phrases", _is_phrase(p)) for p in TEMPLATES[name][1]]), F.lit(name)) for name in TEMPLATES]
    rows = rows.withColumn("asked", F.when(F.size("phrases") > 0, F.array_compact(F.array(*asked))))
    theirs = [F.when(F.array_contains("asked", name), F.array(*[F.lit(w) for w in _words_in(name)])) for name in TEMPLATES]
    rows = rows.withColumn("wanted", F.array_distinct(F.flatten(F.array_compact(F.array(*theirs)))))
    looked_at = F.filter(
        F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("word"))),
        lambda h: F.array_contains(F.col("wanted"), h["word"]),
    )
    rows = land(rows.withColumn("hits", F.when(F.size("asked") > 0, looked_at)).drop("words", "wanted"))
    index = F.broadcast(_index(spark, weights))  # fixed size
    hits = rows.where(F.size("asked") > 0).select("row", "asked", F.explode("hits").alias("h"))
    votes = hits.join(index, F.col("h.word") == F.col("word")).where(F.array_contains("asked", F.col("template")))
    first = F.col("h.at") - F.col("at")
    # Two rows of bands, half a band apart: positions up to DRIFT apart share one.
    bands = [F.floor((first + shift) / (2 * DRIFT)) * 2 + i for i, shift in enumerate((0, DRIFT))]
    votes = votes.select("row", "template", "total", "word", "weight", first.alias("first"), F.explode(F.array(*bands)).alias("band"))
    by_word = votes.groupBy("row", "template", "total", "band", "word", "weight")
    by_word = by_word.agg(F.min("first").alias("first"), F.max("first").alias("last"))
    voted = by_word.groupBy("row", "template", "total", "band").agg(
        F.count(F.lit(1)).alias("votes"), F.sum("weight").alias("weight"),
        F.min("first").alias("first"), F.max("last").alias("last"),
    )
    share = F.least(F.col("weight") / F.col("total"), F.lit(1.0))
    voted = voted.withColumn("share", share).where((F.col("votes") >= MIN_VOTES) & (F.col("share") >= MIN_SHARE))
    near = voted.join(rows.select("row", "phrases"), "row")
    found = near.where(_mandatory()).groupBy("row", "template").agg(F.max("share").alias("share"))
    found = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("template", "share"))).alias("found"))
    none = F.array().cast("array<struct<template:string,share:double>>")
    out = rows.select("row", "doc_id", "n_words", "base").join(found, "row", "left")
    return out.select("doc_id", "n_words", "base", F.coalesce("found", none).alias("found"))


def _is_phrase(phrase: str):
    return lambda x: x["phrase"] == phrase


def _struct_of(phrase: str):
    return lambda i: F.struct(i.alias("at"), F.lit(phrase).alias("phrase"))


def _mandatory() -> Column:
    """Every mandatory phrase of the voted template stands between its ends, with some slack."""
    ok = F.lit(False)
    for name, (text, phrases) in TEMPLATES.items():
        last = F.col("last") + len(text.split()) + SLACK
        each = [
            F.exists(
                "phrases",
                _phrase_between(p, F.col("first") - SLACK, last),
            )
            for p in phrases
        ]
        ok = ok | ((F.col("template") == name) & _all(each))
    return ok


def _phrase_between(phrase: str, low: Column, high: Column):
    return lambda x: (x["phrase"] == phrase) & (x["at"] >= low) & (x["at"] <= high)
