"""What tools model and claim: kinds, edge types, declared capabilities, and claims that the edges don't bear out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Edge types that a capability's label may name.
GUARDED = ("CALLS", "USES_TYPE", "METHOD_OVERRIDES", "ACCESSES")


def observed(rows: DataFrame, column: str) -> DataFrame:
    """(column, tool, present) for every value and every tool of ``rows``."""
    held = rows.select(column, "tool").distinct().withColumn("present", F.lit(True))
    tools = rows.select("tool").distinct()
    grid = held.select(column).distinct().join(F.broadcast(tools))
    return grid.join(held, [column, "tool"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def declared(capabilities: DataFrame, nodes: DataFrame) -> DataFrame:
    """(capability, tool, present): all declared labels, also of tools without a graph, by the tools that have one."""
    held = capabilities.select("capability", "tool").distinct().withColumn("present", F.lit(True))
    grid = capabilities.select("capability").distinct().join(F.broadcast(nodes.select("tool").distinct()))
    return grid.join(held, ["capability", "tool"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def drift(capabilities: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(tool, capability, type): labels that name an edge type of which the tool has no edge. Tools without a graph are not judged."""
    named = capabilities.join(nodes.select("tool").distinct(), "tool", "left_semi").select("tool", "capability", F.explode(F.array(*map(F.lit, GUARDED))).alias("type"))
    return named.where(F.contains("capability", "type")).join(edges.select("tool", "type").distinct(), ["tool", "type"], "left_anti").select("tool", "capability", "type")
