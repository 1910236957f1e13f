"""File lists of repositories, and parse results as typed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Folders that hold no source of the project; endings of source files.
SKIPPED = r"(^|/)(node_modules|\.git)/"
SOURCE = r"\.(ts|tsx|js|jsx|mts|cts|mjs|cjs)\z"


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(ord, path) of every file under ``root``, relative to it; contents are not read. ``ord`` follows the top folders, then the paths."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    prefix = root.rstrip("/").split("://")[-1].lstrip("/")
    path = F.regexp_replace(F.col("path"), rf"^(?:[a-z]+:)?/*\Q{prefix}\E/", "")
    kept = found.select(path.alias("path")).where(~F.col("path").rlike(SKIPPED))
    # numbered inside the folders, which follow each other in the order of their names
    folder = F.regexp_extract("path", r"^(?:[^/]*/)?", 0)
    counts = kept.groupBy(folder.alias("top")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("top").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("top").orderBy("path")) - 1
    return kept.withColumn("top", folder).withColumn("own", own).join(counts.select("top", before.alias("before")), "top").select((F.col("own") + F.col("before")).alias("ord"), "path")


def is_source(path):
    return path.rlike(SOURCE)


def flattened(results: DataFrame) -> DataFrame:
    """Typed edges (fromPath, fromLocalId, type, targetName) from parse results (path, imports, extendsRels, implementsRels, callSites; arrays of structs)."""

    def edges(column: str, type_: str, source: str | None, target: str) -> DataFrame:
        x = results.select("path", F.explode(column).alias("x"))
        return x.select(F.col("path").alias("fromPath"), (F.col(f"x.{source}") if source else F.col("path")).alias("fromLocalId"), F.lit(type_).alias("type"), F.col(f"x.{target}").alias("targetName"))

    parts = [edges("imports", "IMPORTS", None, "targetName"), edges("extendsRels", "EXTENDS", "childLocalId", "baseName"), edges("implementsRels", "IMPLEMENTS", "childLocalId", "baseName"), edges("callSites", "CALLS", "containerLocalId", "calleeName")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
