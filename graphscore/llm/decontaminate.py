"""Benchmark decontamination: which documents hold (nearly) all of a benchmark item.

Size-partitioned MinHash containment search. Items are partitioned by the number of their shingles (powers of two). The
sketch of an item is its k smallest shingles under a second hash, where k is one more than an item of its partition may
lack and still reach the threshold: a document with enough of the item must hold at least one shingle of the sketch,
so the search misses nothing, and a document is never sketched, however long. Documents that hit a sketch are verified:
containment is counted on full sets of distinct shingles.

Words are runs of ASCII letters and digits and of non-ASCII characters, lower-cased. DataFrame operations only. The
sketches are broadcast only if a count proves them small; else the shingles of the documents are shuffled to them.

Defined results: items and documents without words match nothing; texts of fewer words than a shingle are one shingle,
and such an item is looked for in documents by windows of its own length (the SQL below only finds it where it is the whole
text); null ids are kept as null; repeated rows of either table give one result row for each (doc_id, item_id), the largest
containment; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import checked, let, staged

SIZE, PERCENT = 5, 80
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), APART), lambda w: w != "")


def shingles(text: Column, size: int = SIZE, short: tuple[int, ...] = ()) -> Column:
    """Hashes of all shingles of ``text``, in order, with repeats, then those of its windows of each ``short`` size; an empty array without words."""
    none = F.array().cast("array<bigint>")
    every = lambda w, n: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n)))
    whole = lambda w: F.when(F.size(w) >= size, every(w, size)).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(none)
    return let(_words(text), lambda w: F.concat(whole(w), *(F.when(F.size(w) >= n, every(w, n)).otherwise(none) for n in short)) if short else whole(w))


def _short(items: DataFrame, size: int) -> tuple[int, ...]:
    """The numbers of words, below a shingle's, that items have."""
    n = items.select(F.size(_words(F.col("text"))).alias("n")).where(F.col("n").between(1, size - 1)).distinct()
    return tuple(sorted(r["n"] for r in n.collect()))


def _keys(text: Column) -> list[Column]:
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(7), t).alias("k2")]


def _lacking(n: Column, percent: int) -> Column:
    """How many of n shingles may be missing at the threshold."""
    return n - F.ceil(n * percent / 100)


def contained(docs: DataFrame, items: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, k1, k2, item_id, n_item, n_shared): documents (by id and text hash) with ``percent`` or more of an item's distinct shingles."""
    sets = items.select("item_id", F.array_distinct(shingles(F.col("text"), size)).alias("s")).where(F.size("s") > 0)
    upper = F.pow(F.lit(2), F.floor(F.log2(F.size("s"))) + 1).cast("int") - 1
    k = F.least(F.size("s"), (_lacking(upper, percent) + 1).cast("int"))
    ranked = F.array_sort(F.transform("s", lambda h: F.struct(F.xxhash64(h, F.lit(1)).alias("r"), h.alias("h"))))
    sets = staged(sets.select("item_id", "s", F.transform(F.slice(ranked, F.lit(1), k), lambda x: x["h"]).alias("sketch")).withColumn("item", F.xxhash64("item_id", "s")))
    sketch = checked(staged(sets.select(F.explode("sketch").alias("h")).distinct()), 16)
    full = checked(staged(sets.select(F.explode("s").alias("h"), "item").distinct()), 24)
    names = sets.select("item", "item_id", F.size("s").alias("n_item")).distinct()

    short = _short(items, size)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = texts.select(*_keys(F.col("text")), F.explode(shingles(F.col("text"), size, short)).alias("h"))
    hit = checked(staged(rows.join(sketch, "h", "left_semi").select("k1", "k2").distinct()), 24)
    some = texts.select("doc_id", "text", *_keys(F.col("text"))).join(hit, ["k1", "k2"], "left_semi")
    found = some.select("doc_id", "k1", "k2", F.explode(F.array_distinct(shingles(F.col("text"), size, short))).alias("h")).join(full, "h").dropDuplicates(["doc_id", "k1", "k2", "item", "h"])
    counted = found.groupBy("doc_id", "k1", "k2", "item").agg(F.count(F.lit(1)).alias("n_shared"))
    return counted.join(names, "item").where(100 * F.col("n_shared") >= percent * F.col("n_item")).select("doc_id", "k1", "k2", "item_id", "n_item", "n_shared")


def decontaminated(docs: DataFrame, items: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``docs`` without those that hold an item; all columns unchanged."""
    bad = checked(staged(contained(docs, items, size, percent).select("k1", "k2").distinct()), 24)
    keyed = docs.withColumns({"__k1": _keys(F.col("text"))[0], "__k2": _keys(F.col("text"))[1]})
    return keyed.join(bad, (F.col("__k1") == bad["k1"]) & (F.col("__k2") == bad["k2"]), "left_anti").select(*docs.columns)


def op1(spark, sf_dir: str) -> DataFrame:
    """All (document, benchmark item) pairs with a containment of 0.8 or more."""
    found = contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_item", "n_shared")).alias("x"))
    return best.select("doc_id", "item_id", F.col("x.n_item").cast("long").alias("n_item"), "x.n_shared", F.round("x.containment", 9).alias("containment"))


_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
_SHINGLES = f"CASE WHEN len(w) >= {SIZE} THEN list_transform(range(1, len(w) - {SIZE} + 2), lambda i: array_to_string(w[i:i + {SIZE - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest({_SHINGLES}) AS s FROM d), bs AS (SELECT DISTINCT item_id, unnest({_SHINGLES}) AS s FROM b),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
p AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, round(n_shared / n_item, 9) AS containment FROM p JOIN n USING (item_id) WHERE 100 * n_shared >= {PERCENT} * n_item
"""
