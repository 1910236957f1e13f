"""From a node up its parents to the class it belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dedupe

HOPS = 10


def to_class(nodes: DataFrame) -> DataFrame:
    """(tool, id, classId, hasClass): the nearest class within HOPS parents, the node itself first; without one, the node itself.

    Ancestors at 2, 4 and 8 hops by joining the table with itself: four joins for ten hops. A class is its own parent here.
    """
    last = dedupe.last_by_id(nodes.select("tool", "id", "ord", "kind", "parentId"))
    is_class = F.coalesce(F.col("kind") == "Class", F.lit(False))
    kinds = last.select("tool", F.col("id").alias("up"), is_class.alias("hasClass"))
    up = last.select("tool", "id", F.when(is_class, F.col("id")).otherwise(F.coalesce(F.nullif(F.col("parentId"), F.lit("")), F.col("id"))).alias("up"))

    def then(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b.select("tool", F.col("id").alias("up"), F.col("up").alias("further")), ["tool", "up"], "left").select("tool", "id", F.col("further").alias("up"))

    two = then(up, up)
    eight = then(then(two, two), then(two, two))
    ten = then(eight, two).join(kinds, ["tool", "up"], "left")
    found = F.coalesce("hasClass", F.lit(False))
    return ten.select("tool", "id", F.when(found, F.col("up")).otherwise(F.col("id")).alias("classId"), found.alias("hasClass"))


def parents(contains: DataFrame) -> DataFrame:
    """(tool, id, parentId) from CONTAINS rows (tool, ord, fromId, toId): sources by first appearance, then their rows in order; the last one wins."""
    first = contains.groupBy("tool", "fromId").agg(F.min("ord").alias("seen"))
    return contains.join(first, ["tool", "fromId"]).groupBy("tool", F.col("toId").alias("id")).agg(F.max_by("fromId", F.struct("seen", "ord")).alias("parentId"))
