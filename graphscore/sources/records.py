"""Tagged records: JSON lines of a header, nodes, edges and a footer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import record_edge_type, record_kind
from ..operators.climb import parents
from .lines import numbered

#: Without the nodes' text: what the schema doesn't name is never parsed.
SCHEMA = "kind STRING, id STRING, name STRING, node_type STRING, file STRING, line INT, end_line INT, class_name STRING, source_id STRING, target_id STRING, relationship_type STRING, node_count BIGINT, edge_count BIGINT, error STRING"


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records in order (ord)."""
    return numbered(spark, path).select("ord", F.from_json("value", SCHEMA, {"mode": "FAILFAST"}).alias("x")).select("ord", "x.*")


def checked(records: DataFrame, counts: bool = False) -> DataFrame:
    """``records``, if the footer tells of no error; with ``counts``, also if it has as many nodes and edges as the footer says."""
    footer = records.where("kind = 'footer'").select("error", "node_count", "edge_count").first()
    if footer and footer["error"]:
        raise ValueError(f"the export failed: {footer['error']}")
    if counts and footer:
        have = {r["kind"]: r["count"] for r in records.groupBy("kind").count().collect()}
        want = {"node": footer["node_count"], "edge": footer["edge_count"]}
        if any(v is not None and have.get(k, 0) != v for k, v in want.items()):
            raise ValueError(f"the footer tells of {want}, the records are {have}")
    return records


def _contains(records: DataFrame) -> DataFrame:
    return records.where("kind = 'edge' and relationship_type = 'CONTAINS'").select(F.lit("x").alias("tool"), "ord", F.col("source_id").alias("fromId"), F.col("target_id").alias("toId"))


def nodes(records: DataFrame, tool: str) -> DataFrame:
    """Nodes, with lines from 1 and the parent that contains each."""
    n = records.where("kind = 'node'").join(parents(_contains(records)).select("id", "parentId"), "id", "left")
    return n.select(F.lit(tool).alias("tool"), "ord", "id", "name", F.col("file").alias("path"), record_kind(F.col("node_type"), F.col("class_name"), F.col("name")).alias("kind"), (F.col("line") + 1).alias("startLine"), (F.col("end_line") + 1).alias("endLine"), "parentId", F.col("node_type").alias("originalKind"), F.col("id").alias("toolId"))


def edges(records: DataFrame, tool: str) -> DataFrame:
    """Edges but CONTAINS, which gives parents, and types unknown here."""
    e = records.where("kind = 'edge'").select(F.lit(tool).alias("tool"), "ord", F.col("source_id").alias("fromId"), F.col("target_id").alias("toId"), record_edge_type(F.col("relationship_type")).alias("type"), F.lit(None).cast("boolean").alias("resolved"), F.lit(None).cast("double").alias("confidence"), F.col("relationship_type").alias("edgeKind"))
    return e.where("type not in ('UNKNOWN', 'CONTAINS')")
