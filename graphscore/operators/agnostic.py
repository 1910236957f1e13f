"""Scores that don't depend on which symbol of a file or class a tool attributes a relationship to, and module-level imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import ratio, with_scores
from ..functions.names import norm_path
from . import climb
from .adjudicate import named_key, source_key

_TEXT = lambda c: F.coalesce(c, F.lit(""))


def _pairs(claims: DataFrame, truth: DataFrame) -> DataFrame:
    """By tool: distinct claims (tool, left, target, name) against distinct truth (left, target, name); a claim is right if its target is known there by id, or by name. All are hashes (see adjudicate)."""
    ids = truth.where("target is not null").select("left", "target").distinct().withColumn("by_id", F.lit(True))
    names = truth.select("left", "name").distinct().withColumn("by_name", F.lit(True))
    total = truth.select("left", "target", F.when(F.col("target").isNull(), F.col("name")).alias("name")).distinct().agg(F.count(F.lit(1)).alias("truth"))
    # one claim for each target: of those that share an id, names agree, as they are the symbol's
    claims = claims.groupBy("tool", "left", "target", F.when(F.col("target").isNull(), F.col("name")).alias("key")).agg(F.min("name").alias("name"))
    right = claims.join(ids, ["left", "target"], "left").join(names, ["left", "name"], "left")
    counted = right.groupBy("tool").agg(F.count_if(F.col("by_id").isNotNull() | F.col("by_name").isNotNull()).alias("tp"), F.count(F.lit(1)).alias("claims"))
    out = counted.join(F.broadcast(total)).select("tool", "tp", (F.col("claims") - F.col("tp")).alias("fp"), (F.col("truth") - F.col("tp")).alias("fn"))
    return with_scores(out)


def _truth(related: DataFrame, left: Column) -> DataFrame:
    return related.select(left.alias("left"), F.when(F.col("known"), F.col("relation")).alias("target"), F.nullif(F.col("name"), F.lit(0).cast("long")).alias("name"))


def _target(bound: DataFrame, left: str) -> DataFrame:
    return bound.select("tool", F.col(left).alias("left"), F.col("to_target").alias("target"), F.col("to_called").alias("name"))


def uses_type(bound: DataFrame, related: DataFrame) -> DataFrame:
    """USES_TYPE by file of the source. ``related``: ground truth (adjudicate.relations)."""
    claims = bound.where("type = 'USES_TYPE' and from_node is not null and to_there")
    return _pairs(_target(claims, "from_path"), _truth(related.where("type = 'USES_TYPE'"), F.col("file")))


def method_overrides(bound: DataFrame, nodes: DataFrame, ends: DataFrame, related: DataFrame, symbols: DataFrame) -> DataFrame:
    """METHOD_OVERRIDES by the class of the source. ``ends``: nodes with their bindings (adjudicate.ends)."""
    path = norm_path(F.col("path"))
    owner = symbols.where("localId is not null").groupBy(path.alias("p"), F.col("localId").alias("l")).agg(F.max_by("parentLocalId", "ord").alias("owner"))
    owner = owner.where("owner is not null").select(source_key(F.col("p"), F.col("l")).alias("source"), source_key(F.col("p"), F.col("owner")).alias("class"))
    truth = _truth(related.where("type = 'METHOD_OVERRIDES'").join(owner, "source", "left"), F.coalesce("class", "source"))

    # the class of every node, once: edges look it up
    owners = ends.select("tool", F.col("id").alias("classId"), F.when(F.col("bid").isNotNull(), source_key(F.col("bpath"), F.col("bid"))).otherwise(named_key(path, F.col("name"))).alias("class"))
    each = ends.join(climb.to_class(nodes).select("tool", "id", "classId"), ["tool", "id"], "left").join(owners, ["tool", "classId"], "left")
    side = F.when(F.col("bkind") == "Class", source_key(F.col("bpath"), F.col("bid"))).when(_TEXT(F.col("bparent")) != "", source_key(F.col("bpath"), F.col("bparent"))).otherwise(F.col("class"))
    sides = each.select("tool", F.col("ord").alias("from_node"), side.alias("side"))
    claims = bound.where("type = 'METHOD_OVERRIDES' and from_node is not null and to_there").select("tool", "from_node", "to_target", "to_called").join(sides, ["tool", "from_node"], "left")
    return _pairs(_target(claims, "side"), truth)


def imports_module_level(bound: DataFrame, related: DataFrame) -> DataFrame:
    """IMPORTS as distinct file pairs; as many unmatched pairs of a file are excused as it has imports of unknown target."""
    claims = bound.where("type = 'IMPORTS' and from_file is not null and to_file is not null").select("tool", F.col("from_file").alias("a"), F.col("to_file").alias("b")).distinct()
    rows = related.where("type = 'IMPORTS'").select(F.col("from_id").alias("a"), F.col("to_file").alias("b"))
    truth = rows.where("b is not null").distinct().withColumn("right", F.lit(True))
    budget = rows.where("b is null").groupBy("a").agg(F.count(F.lit(1)).alias("budget"))
    by_file = claims.join(truth, ["a", "b"], "left").groupBy("tool", "a").agg(F.count_if(F.col("right").isNotNull()).alias("tp"), F.count(F.lit(1)).alias("pairs")).join(budget, "a", "left")
    excused = F.least(F.col("pairs") - F.col("tp"), F.coalesce("budget", F.lit(0)))
    total = truth.agg(F.count(F.lit(1)).alias("oraclePairs"))
    out = by_file.select("tool", "tp", "pairs", excused.alias("excused")).groupBy("tool").agg(F.sum("tp").alias("tp"), F.sum("pairs").alias("toolPairs"), F.sum("excused").alias("unscoreableExcluded")).join(F.broadcast(total))
    out = out.withColumn("fp", F.col("toolPairs") - F.col("tp") - F.col("unscoreableExcluded")).withColumn("fn", F.col("oraclePairs") - F.col("tp"))
    return out.select("tool", "tp", "fp", "fn", "oraclePairs", "toolPairs", "unscoreableExcluded", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
