"""License scan: exact phrases, and licence texts found through a positional index of rare words.

Index. Each template is a licence sentence; its distinctive words are posted with their positions. For a file, every
licence word it holds is looked up; a posting (template, q) of a word at p puts the template at p - q; template and place
with enough of the template's IDF weight (inverse document frequency over all files) are candidates, and count only if the
template's mandatory key phrases stand at that very place.

Words are runs of ASCII letters and digits and of non-ASCII characters, with A-Z lower-cased. DataFrame operations only;
the vocabulary is a constant, so the table of document frequencies (all that is collected) has a fixed size.

Defined results: a null or empty text has no words, no labels and score 0; null or repeated doc_ids are rows of their own;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import ascii_lower, let, staged

# Licence phrases and the label of each.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Label, template sentence, key phrases that must stand in place.
TEMPLATES = [
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge", "obtaining a copy of this software"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify and or distribute this software"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license", ["gnu affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", ["eclipse public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("boost-1.0", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc0-1.0", "dedicated to the public domain under cc0 1 0 universal", ["cc0 1 0"]),
    ("mit-notice", "released under the mit license", ["released under the mit license"]),
    ("mit-notice", "licensed under the mit license", ["licensed under the mit license"]),
    ("all-rights-reserved", "copyright all rights reserved", ["all rights reserved"]),
]
# Words of the templates too common in prose of some language to be looked up.
COMMON = set("a all and any are by following for free in into is made mit of or person public purpose sa source subject that the this to under use v version with without 0 1 2 3 4".split())
#: Share of a template's IDF weight that must stand in place.
ENOUGH = 0.6

VOCABULARY = sorted({w for _, text, _ in TEMPLATES for w in text.split()} - COMMON)
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def file_words(text: Column) -> Column:
    """Words as they are written; see ascii_lower."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), APART), lambda w: w != "")


def _vocabulary() -> Column:
    return F.array(*map(F.lit, VOCABULARY))


def _base_places(ws: Column) -> Column:
    """Structs (start, label) of all places of the base phrases in the lower-cased words ``ws``."""

    def at(w: Column, i: Column) -> Column:
        out = F.lit(None).cast("struct<start:bigint,label:string>")
        for phrase, label in BASE.items():
            rest = phrase.split()
            match = w == rest[0]
            for k, word in enumerate(rest[1:], 1):
                match = match & (F.get(ws, i + k) == word)
            out = F.when(match, F.struct(i.cast("long").alias("start"), F.lit(label).alias("label"))).otherwise(out)
        return out

    return F.filter(F.transform(ws, at), lambda x: x.isNotNull())


def _index(spark, idf: dict[str, float]) -> DataFrame:
    """Postings (w, t, q, idf) and the weight of each template; a constant number of rows."""
    rows = []
    for t, (_, text, _) in enumerate(TEMPLATES):
        posts = [(w, t, q, idf[w]) for q, w in enumerate(text.split()) if w in idf]
        total = sum(p[3] for p in posts)
        rows += [(*p, total) for p in posts]
    return spark.createDataFrame(rows, "w string, t int, q int, idf double, total double")


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    raw = F.col("text")
    # words are kept only where they hold a licence word; Unicode lower-casing finds those and more
    held = let(file_words(F.lower(F.coalesce(raw, F.lit("")))), lambda ws: F.size(F.array_intersect(ws, _vocabulary())) > 0)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.size(file_words(raw)).cast("long").alias("n_words"), F.when(held, file_words(ascii_lower(raw))).alias("ws"))
    rows = staged(rows)
    some = rows.where("ws is not null").select("rid", "ws", F.array_intersect("ws", _vocabulary()).alias("present"))

    n = rows.count()
    df = {r["w"]: r["n"] for r in some.select(F.explode("present").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    idf = {w: math.log((n + 2) / (df.get(w, 0) + 1)) for w in VOCABULARY}
    index = F.broadcast(_index(spark, idf))

    hits = some.select("rid", F.posexplode("ws").alias("p", "w")).where(F.col("w").isin(VOCABULARY))
    placed = hits.join(index, "w").groupBy("rid", "t", (F.col("p") - F.col("q")).alias("at")).agg(F.sum("idf").alias("got"), F.first("total").alias("total"))
    placed = placed.where(F.col("got") >= ENOUGH * F.col("total")).join(some.select("rid", "ws"), "rid")
    in_place = F.lit(False)
    for t, (_, text, phrases) in enumerate(TEMPLATES):
        every = F.col("t") == t
        for phrase in phrases:
            q, k = f" {text} ".index(f" {phrase} "), len(phrase.split())
            q = len(text[:q].split())
            start = F.col("at") + q
            every = every & (start >= 0) & (F.slice("ws", F.greatest(start, F.lit(0)) + 1, k) == F.array(*map(F.lit, phrase.split())))
        in_place = in_place | every
    label = F.element_at(F.array(*(F.lit(x[0]) for x in TEMPLATES)), F.col("t") + 1)
    method = placed.where(in_place).groupBy("rid").agg(F.collect_set(label).alias("more"), F.max(F.least(F.lit(1.0), F.col("got") / F.col("total"))).alias("found"))

    base = let(F.coalesce("ws", F.array().cast("array<string>")), _base_places)
    x = rows.join(method, "rid", "left").withColumn("places", base)
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    own, starts = F.transform("places", lambda p: p["label"]), F.transform("places", lambda p: p["start"])
    score = F.greatest(F.coalesce("found", F.lit(0.0)), F.when(F.size("places") > 0, 0.5).otherwise(0.0))
    return x.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(own).alias("base_labels"), joined(F.concat(own, F.coalesce("more", F.array().cast("array<string>")))).alias("labels"), F.round(score, 9).alias("score"),
    )


def op2(spark, sf_dir: str) -> DataFrame:
    """Contract query over the whole of ``documents``."""
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
