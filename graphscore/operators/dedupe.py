"""Which rows stand for a symbol or a relationship, where inputs repeat them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import is_scoreable
from ..functions.names import canonical_name, norm_path


def _firsts(df: DataFrame, *keys: str) -> DataFrame:
    """The row of smallest ord for each key. A minimum of structs, so repeats are combined before the shuffle."""
    row = F.struct("ord", *(c for c in df.columns if c != "ord" and c not in keys))
    return df.groupBy(*keys).agg(F.min(row).alias("x"), F.count(F.lit(1)).alias("rows")).select(*keys, "x.*", "rows")


def tool_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each (tool, npath, cname, kind, startLine), the first; ``rows`` counts what it stands for."""
    keyed = nodes.select("*", norm_path(F.col("path")).alias("npath"), canonical_name(F.col("name")).alias("cname"))
    return _firsts(keyed, "tool", "npath", "cname", "kind", "startLine")


def oracle_symbols(symbols: DataFrame) -> DataFrame:
    """One row for each (npath, localId), the first."""
    return _firsts(symbols.select("*", norm_path(F.col("path")).alias("npath")), "npath", "localId")


def last_by_id(nodes: DataFrame, *also: Column) -> DataFrame:
    """One row for each (tool, id), the last; ``also``: further aggregates of the id's rows."""
    row = F.struct("ord", *(c for c in nodes.columns if c not in ("ord", "tool", "id")))
    last = nodes.groupBy("tool", "id").agg(F.max(row).alias("x"), *also)
    return last.select("tool", "id", "x.*", *last.columns[3:])


def oracle_edges(edges: DataFrame) -> DataFrame:
    """Scoreable rows as unique relationships: one for each source, type and target (by id if known, else by name), the first, with the sites of all."""
    known = F.coalesce(F.col("targetLocalId"), F.lit("")) != ""
    keyed = edges.where(is_scoreable(F.col("scoreable"))).select(
        "*", norm_path(F.col("fromPath")).alias("nfrom"), known.alias("byId"), F.when(known, norm_path(F.coalesce("targetPath", F.lit("")))).alias("k1"), F.when(known, F.col("targetLocalId")).otherwise(F.col("targetName")).alias("k2"), F.coalesce("siteCount", F.lit(1)).alias("sites")
    )
    scope = ("scope",) if "scope" in edges.columns else ()
    keys = (*scope, "nfrom", "fromLocalId", "type", "byId", "k1", "k2")
    row = F.struct("ord", *(c for c in edges.columns if c not in ("ord", "siteCount", "fromLocalId", "type", "scope")))
    return keyed.groupBy(*keys).agg(F.min(row).alias("x"), F.sum("sites").alias("siteCount")).select(*scope, "nfrom", "fromLocalId", "type", "x.*", "siteCount")
