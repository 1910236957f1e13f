"""Relations of the scoring engine and the ordered value sets of their enumerations."""

from __future__ import annotations

# Symbol kinds that are compared, in report order.
KINDS = ("Class", "Interface", "Enum", "Alias", "Function", "Method", "Constructor", "Property", "GlobalVariable", "Module", "Namespace")
# Edge types that are compared, and those scored apart, in report order.
EDGE_TYPES = ("IMPORTS", "CALLS", "EXTENDS", "IMPLEMENTS")
EXTENDED_TYPES = ("USES_TYPE", "ACCESSES", "METHOD_OVERRIDES")
# Members whose IMPLEMENTS rows are scored apart; kinds that are no symbols; names that identify nothing.
MEMBER_KINDS = ("Method", "Constructor", "Property")
CONTAINERS = ("File", "Directory")
NAMELESS = ("[computed]", "[anonymous]")
#: Lines by which an edge's target may be off.
BAND = 2

NODES = "tool STRING, ord BIGINT, id STRING, name STRING, path STRING, kind STRING, startLine INT, endLine INT, parentId STRING, originalKind STRING, toolId STRING"
EDGES = "tool STRING, ord BIGINT, fromId STRING, toId STRING, type STRING, resolved BOOLEAN, confidence DOUBLE, edgeKind STRING"
ORACLE_SYMBOLS = "ord BIGINT, path STRING, localId STRING, name STRING, kind STRING, startLine INT, endLine INT, parentLocalId STRING"
ORACLE_EDGES = "ord BIGINT, fromPath STRING, fromLocalId STRING, type STRING, targetName STRING, targetPath STRING, targetLocalId STRING, targetStartLine INT, resolutionTier STRING, scoreable BOOLEAN, siteCount INT"


def without_ord(schema: str) -> str:
    """The schema of the JSON lines a relation is read from: ord and tool are minted on reading."""
    return ", ".join(f for f in schema.split(", ") if f.split()[0] not in ("ord", "tool"))
