"""The engine's queries over the derived test graph, by name."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, names
from ..functions.metrics import derived_scoreable
from ..operators import adjudicate, climb, dedupe, ownership
from ..sources import mdtable, nodelink
from ..staging import hashed_joins, staged
from . import ingest, report
from .score import Score
from .testgraph import tables

Query = Callable[[SparkSession, str], DataFrame]


def _table(name: str) -> Callable[[Callable[[DataFrame], DataFrame]], Query]:
    return lambda f: lambda spark, sf_dir: f(tables(spark, sf_dir, (name,))[name])


class Derived:
    """The relations of the derived graph (see score.Inputs), each staged on first use: a real graph would be read from files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _table(self, name: str) -> DataFrame:
        return staged(tables(self.spark, self.sf_dir, (name,), self._calls if name.endswith("edges") else None)[name])

    @functools.cached_property
    def _calls(self) -> dict[str, DataFrame]:
        """What both sides' edges are derived from, numbered once. Columns that only the order of a line took are left out."""
        calls = tables(self.spark, self.sf_dir, ("calls",))["calls"]
        return {"calls": staged(calls.select("l_orderkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "ord", "a", "b", "n", "q", "type"))}

    nodes = functools.cached_property(lambda self: self._table("nodes"))
    edges = functools.cached_property(lambda self: self._table("edges"))
    oracle_symbols = functools.cached_property(lambda self: self._table("oracle_symbols"))
    oracle_edges = functools.cached_property(lambda self: self._table("oracle_edges"))
    capabilities = functools.cached_property(lambda self: tables(self.spark, self.sf_dir, ("capabilities",))["capabilities"])


_last: dict[tuple[str, str], Score] = {}


def score(spark: SparkSession, sf_dir: str) -> Score:
    """The score of one graph. Queries on the same graph share its matches and verdicts, which are computed once; those of the last graph are forgotten."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _last:
        _last.clear()
        hashed_joins(spark)
        _last[key] = Score(Derived(spark, sf_dir), cached=True)
    return _last[key]


def forget() -> None:
    """Queries begin anew."""
    _last.clear()


def _scored(f: Callable[[Score], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(score(spark, sf_dir))


def _normal_names(t: DataFrame) -> DataFrame:
    s, x = F.col("symbol"), F.col("text")
    return t.select("ord", names.norm_path(x).alias("path"), names.canonical_name(s).alias("canonical"), names.is_accessor(s).alias("accessor"), names.is_matchable(s).alias("matchable"), names.bare_name(x).alias("bare"))


def _file_universe(s: Score) -> DataFrame:
    known = s.known_paths.withColumnRenamed("path", "fromPath")
    return s.inputs.oracle_edges.join(known, "fromPath", "left_semi").groupBy("fromPath").agg(F.count(F.lit(1)).alias("edges"))


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.scorecard_lines(score(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "normalize_path_name": _table("raw_labels")(_normal_names),
    "normalize_kinds": _table("raw_labels")(lambda t: t.select("ord", labels.graph_kind(F.col("label")).alias("graph_kind"), labels.record_kind(F.col("node_type"), F.col("class_name"), F.col("name")).alias("record_kind"))),
    "normalize_edge_types": _table("raw_labels")(lambda t: t.select("ord", labels.graph_edge_type(F.col("relation")).alias("graph_type"), labels.link_edge_type(F.col("link")).alias("link_type"), labels.record_edge_type(F.col("relation")).alias("record_type"))),
    "line_marker": _table("raw_labels")(lambda t: t.select("ord", names.line_marker(F.col("marker")).alias("line"))),
    "markdown_table_scan": _table("md_lines")(lambda t: mdtable.cells(t, ["id", "name", "filePath", "startLine", "endLine", "label"]).select("ord", "id", "name", "filePath", names.whole_number(F.col("startLine")).alias("startLine"), names.whole_number(F.col("endLine")).alias("endLine"), "label")),
    "tool_node_dedupe": _scored(lambda s: dedupe.tool_nodes(s.identity_nodes).select("tool", "npath", "cname", "kind", "startLine", "ord", "rows")),
    "oracle_symbol_dedupe": _scored(lambda s: dedupe.oracle_symbols(s.inputs.oracle_symbols).select("npath", "localId", "ord", "rows")),
    "oracle_edge_collapse": _scored(lambda s: adjudicate.collapsed(s.oracle).select("ord", "nfrom", "fromLocalId", "type", "targetName", "siteCount")),
    "derive_scoreable": _scored(lambda s: derived_scoreable(s.inputs.oracle_edges).select("ord", "scoreable")),
    "file_universe_semijoin": _scored(_file_universe),
    "edge_partition": _scored(lambda s: s.bound.groupBy("tool", "type", "scope").agg(F.count(F.lit(1)).alias("edges"))),
    "abstentions": _scored(lambda s: s.verdicts.where(F.col("verdict") == adjudicate.ABSTAINED).select("scope", "tool", "ord")),
    "dangling_selfloop": _scored(Score.loops_and_dangling),
    "imports_module_level": _scored(Score.imports_module_level),
    "uses_type_agnostic": _scored(Score.uses_type),
    "method_overrides_agnostic": _scored(Score.method_overrides),
    "climb_to_class": _scored(lambda s: climb.to_class(s.inputs.nodes)),
    "resolution_tiers": _scored(Score.resolution_tiers),
    "oracle_resolved_rate": _scored(Score.oracle_resolved_rate),
    "headline": _scored(Score.headline),
    "d4_ontology": _scored(Score.kinds_modelled),
    "d4_edge_types": _scored(Score.types_modelled),
    "d4_capabilities": _scored(Score.capabilities),
    "drift_guard": _scored(Score.drift),
    "file_ownership": _table("files")(lambda t: ownership.owners(t, ownership.projects(t))),
    "tsconfig_select": _table("files")(lambda t: ownership.projects(t).select("rootPath", "tsconfigPath", (F.size("languages") == 2).alias("typed"))),
    "graph_class_kinds": lambda spark, sf_dir: nodelink.classified(*(tables(spark, sf_dir, ("link_nodes", "links"))[x] for x in ("link_nodes", "links"))).select("id", "kind"),
    "parent_backfill": _table("links")(lambda t: climb.parents(t.where("relation = 'contains'").select(F.lit("x").alias("tool"), "ord", F.col("source").alias("fromId"), F.col("target").alias("toId")))),
    "node_match": _scored(lambda s: s.node_match),
    "node_fidelity_by_kind": _scored(Score.nodes_by_kind),
    "node_fidelity_overall": _scored(lambda s: s.nodes_overall().withColumn("macroF1", F.round("macroF1", 12))),
    "kind_labelling": _scored(Score.kind_labelling),
    "edge_verdicts": _scored(lambda s: s.verdicts),
    "d2_edges": _scored(Score.edges_by_type),
    "d2_edges_overall": _scored(Score.edges_overall),
    "d2_extended": _scored(Score.extended),
    "member_implements": _scored(Score.member_implements),
    "d1_matrix": _scored(lambda s: s.depth().drop("resolvedTotal", "resolvedConfirmed", "resolvedTargetConfirmed")),
    "resolved_slice": _scored(lambda s: s.depth().select("tool", "type", "resolvedTotal", "resolvedConfirmed", "resolvedTargetConfirmed")),
    "cross_tool_coverage": _scored(Score.coverage),
    "edge_false_negatives": _scored(Score.false_negatives),
    "kind_labelling_overall": _scored(Score.kind_labelling_overall),
    "d1_summary": _scored(Score.depth_summary),
    "nodes_by_kind_histogram": _scored(Score.kind_histogram),
    "scorecard_markdown": _markdown,
    **ingest.QUERIES,
}
