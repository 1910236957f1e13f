"""Numbered lines of text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered(spark: SparkSession, path: str, blank: bool = False) -> DataFrame:
    """(ord, value): lines in the order of the files' names and bytes, from 0; without blank ones unless ``blank``.

    A split of a file is read by one task, in order, so a line's number is its place in its split and the number of lines in earlier splits;
    only a row for each split is sorted and joined.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    kept = (raw if blank else raw.where(F.col("value").rlike(r"\S"))).withColumn("k", F.monotonically_increasing_id())
    splits = kept.groupBy("f", "b").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return kept.join(splits.select("f", "b", "first", before.alias("before")), ["f", "b"]).select((F.col("before") + F.col("k") - F.col("first")).alias("ord"), "value")
