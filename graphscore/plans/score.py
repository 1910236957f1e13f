"""All metric tables of the engine over one set of inputs. Matches and verdicts are shared plans; ``cached`` computes them once, as staged tables."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import derived_scoreable, ratio, with_scores
from ..functions.names import is_accessor, is_matchable
from ..operators import adjudicate, agnostic, capability, coverage, dedupe, match
from ..operators.adjudicate import ABSTAINED, EXCUSED, NAME, TARGET, WRONG
from ..schemas import CONTAINERS, EDGE_TYPES, EXTENDED_TYPES, KINDS
from ..staging import at_once, small, staged


@dataclass
class Inputs:
    """The relations to score: see schemas. ``oracle_edges`` may leave scoreable open."""

    nodes: DataFrame
    edges: DataFrame
    oracle_symbols: DataFrame
    oracle_edges: DataFrame
    capabilities: DataFrame | None = None
    #: Tools in the order of the report; by name unless given.
    order: list[str] | None = None


@dataclass
class Score:
    inputs: Inputs
    #: Write shared plans to the folder that all executors share, on first use.
    cached: bool = False

    def _shared(self, df: DataFrame) -> DataFrame:
        return staged(df) if self.cached else df

    @property
    def spark(self) -> SparkSession:
        return self.inputs.nodes.sparkSession

    # -- inputs as they are scored

    @functools.cached_property
    def known_paths(self) -> DataFrame:
        """Files that any tool indexed, as written."""
        paths = self._shared(self.inputs.nodes.where(F.coalesce("path", F.lit("")) != "").select("path").distinct())
        return small(paths) if self.cached else paths

    @functools.cached_property
    def symbols(self) -> DataFrame:
        return self.inputs.oracle_symbols.join(self.known_paths, "path", "left_semi")

    @functools.cached_property
    def oracle(self) -> DataFrame:
        """Ground-truth edges from indexed files, with the table each belongs to."""
        edges = derived_scoreable(self.inputs.oracle_edges).join(self.known_paths.withColumnRenamed("path", "fromPath"), "fromPath", "left_semi")
        return adjudicate.scope_of_oracle(edges, self.symbols)

    @functools.cached_property
    def related(self) -> DataFrame:
        """The same as it is compared with the tools' edges; in each file type by type, as most tables read one type only."""
        related = adjudicate.relations(self.oracle)
        return self._shared(related.sortWithinPartitions(F.xxhash64("type")) if self.cached else related)

    @functools.cached_property
    def tools(self) -> DataFrame:
        return self.inputs.nodes.select("tool").distinct()

    # -- matches and verdicts

    @functools.cached_property
    def identity_nodes(self) -> DataFrame:
        return self.inputs.nodes.where(~F.col("kind").isin(*CONTAINERS))

    @functools.cached_property
    def node_match(self) -> DataFrame:
        """Matches that node metrics are counted on: without files and directories."""
        return self._shared(match.to_oracle(self.identity_nodes, self.symbols))

    @functools.cached_property
    def ends(self) -> DataFrame:
        """Nodes with bindings. Files take part here, so this is another matching than node_match."""
        return self._shared(adjudicate.ends(self.inputs.nodes, match.to_oracle(self.inputs.nodes, self.symbols), self.symbols))

    @functools.cached_property
    def bound(self) -> DataFrame:
        compared = self.inputs.edges.where(F.col("type").isin(*EDGE_TYPES, *EXTENDED_TYPES))
        return self._shared(adjudicate.scope_of_edges(adjudicate.bound_edges(compared, self.ends)))

    @functools.cached_property
    def _judged(self) -> DataFrame:
        return self._shared(adjudicate.judged(self.bound, self.related))

    @functools.cached_property
    def verdicts(self) -> DataFrame:
        return adjudicate.edges_of(self._judged)

    def prepare(self) -> None:
        """Computes what the tables share: what doesn't depend on each other at the same time, so that small jobs don't leave the cluster idle."""
        if not self.cached:
            return
        at_once(lambda: (self.inputs.nodes, self.inputs.oracle_symbols, self.known_paths, self.ends, self.node_match, self._kind_counts), lambda: (self.inputs.edges, self.inputs.oracle_edges))
        at_once(lambda: self.bound, lambda: self.related)
        at_once(lambda: (self._judged, self._counts), lambda: self._claimed)
        at_once(lambda: self._depth)

    # -- nodes

    @functools.cached_property
    def judged_nodes(self) -> DataFrame:
        """(tool, tkind, okind, oname): matchable nodes and the symbols they match, if any."""
        t = self.identity_nodes.select("tool", F.col("ord").alias("tool_ord"), F.col("kind").alias("tkind"))
        o = self.symbols.select(F.col("ord").alias("oracle_ord"), F.col("kind").alias("okind"), F.col("name").alias("oname"))
        return self.node_match.join(t, ["tool", "tool_ord"]).join(o, "oracle_ord", "left").select("tool", "tkind", "okind", "oname")

    def _truth_by_kind(self) -> DataFrame:
        return dedupe.oracle_symbols(self.symbols).where(is_matchable(F.col("name"))).groupBy("kind").agg(F.count(F.lit(1)).alias("truth"))

    @functools.cached_property
    def _kind_counts(self) -> DataFrame:
        """(tool, kind, tp, fp, fn) for every tool and every kind that occurs: tp and fn by the symbol's kind, fp by the node's."""
        j = self.judged_nodes
        hit = j.where("okind is not null").groupBy("tool", F.col("okind").alias("kind")).agg(F.count(F.lit(1)).alias("tp"))
        miss = j.where("okind is null").groupBy("tool", F.col("tkind").alias("kind")).agg(F.count(F.lit(1)).alias("fp"))
        truth = self._truth_by_kind().join(F.broadcast(self.tools))
        zero = F.lit(0).cast("long")
        rows = hit.select("tool", "kind", "tp", zero.alias("fp"), zero.alias("truth")).unionByName(miss.select("tool", "kind", zero.alias("tp"), "fp", zero.alias("truth"))).unionByName(truth.select("tool", "kind", zero.alias("tp"), zero.alias("fp"), "truth"))
        return self._shared(rows.groupBy("tool", "kind").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), (F.sum("truth") - F.sum("tp")).alias("fn")))

    def nodes_by_kind(self) -> DataFrame:
        """Node precision, recall and F1 of the compared kinds; all of them for each tool."""
        grid = self.tools.select("tool", F.explode(F.array(*map(F.lit, KINDS))).alias("kind"))
        c = grid.join(self._kind_counts, ["tool", "kind"], "left")
        return with_scores(c.select("tool", "kind", *(F.coalesce(k, F.lit(0)).alias(k) for k in ("tp", "fp", "fn"))))

    def nodes_overall(self) -> DataFrame:
        """All kinds together (also those that are not compared), the mean F1 of compared kinds that occur, match rates, collapsed rows."""
        total = with_scores(self._kind_counts.groupBy("tool").agg(*(F.sum(k).alias(k) for k in ("tp", "fp", "fn"))))
        macro = self.nodes_by_kind().groupBy("tool").agg(F.coalesce(F.avg(F.when(F.col("tp") + F.col("fn") > 0, F.col("f1"))), F.lit(0.0)).alias("macroF1"))
        twice = dedupe.tool_nodes(self.identity_nodes).groupBy("tool").agg(F.sum(F.col("rows") - 1).alias("duplicates"))
        out = total.join(macro, "tool").join(twice, "tool", "left")
        return out.select("tool", "tp", "fp", "fn", "precision", "recall", "f1", "macroF1", F.coalesce("duplicates", F.lit(0)).alias("duplicates"), F.col("precision").alias("toolMatchRate"), F.col("recall").alias("oracleMatchRate"))

    def kind_labelling(self) -> DataFrame:
        """Of matched nodes, by the symbol's kind: labelled right, not at all (Unknown), or wrong."""
        swap = ("Method", "Property")
        right = (F.col("tkind") == F.col("okind")) | (F.col("tkind").isin(*swap) & F.col("okind").isin(*swap) & is_accessor(F.col("oname")))
        c = self.judged_nodes.where("okind is not null").groupBy("tool", F.col("okind").alias("kind"))
        c = c.agg(F.count(F.lit(1)).alias("total"), F.count_if(right).alias("correct"), F.count_if(~right & (F.col("tkind") == "Unknown")).alias("unlabelled"))
        return c.withColumn("mislabelled", F.col("total") - F.col("correct") - F.col("unlabelled")).withColumn("accuracy", ratio(F.col("correct"), F.col("total")))

    def kind_labelling_overall(self) -> DataFrame:
        """The same for all kinds together."""
        c = self.kind_labelling().groupBy("tool").agg(*(F.sum(k).alias(k) for k in ("total", "correct", "unlabelled", "mislabelled")))
        return c.withColumn("accuracy", ratio(F.col("correct"), F.col("total")))

    def kind_histogram(self) -> DataFrame:
        """(tool, kind, nodes): all rows of the exports, files included."""
        return self.inputs.nodes.groupBy("tool", "kind").agg(F.count(F.lit(1)).alias("nodes"))

    # -- edges

    @functools.cached_property
    def _counts(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Of each scope and type: verdicts by tool, relationships of the ground truth, their sites and rows that can't be scored. All edge tables count these few rows."""
        is_ = lambda *xs: F.count_if(F.col("verdict").isin(*xs))
        c = self._judged.where("tool is not null").groupBy("scope", "tool", "type").agg(is_(TARGET, NAME).alias("tp"), is_(WRONG).alias("fp"), is_(TARGET).alias("targetConfirmed"), is_(NAME).alias("nameOnlyConfirmed"), is_(EXCUSED).alias("unscoreableMatched"), is_(ABSTAINED).alias("abstentions"), F.count_if(F.col("resolved") & F.col("verdict").isin(TARGET, NAME)).alias("resolvedConfirmed"), F.count_if(F.col("resolved") & (F.col("verdict") == TARGET)).alias("resolvedTargetConfirmed"))
        truth = self._judged.where("tool is null").groupBy("scope", "type").agg(F.sum("ord").alias("truth"))
        sites = self.related.groupBy("scope", "type").agg(F.sum(F.when(F.col("scoreable"), F.col("sites"))).alias("sites"), F.count_if(~F.col("scoreable")).alias("unscoreableExcluded"))
        return self._shared(c), self._shared(truth), self._shared(sites)

    @functools.cached_property
    def _claimed(self) -> DataFrame:
        """By tool and type: edges, how many are resolved, loops, without a node at an end, and whether some lead to files, some elsewhere."""
        loose = F.col("from_node").isNull() | F.col("to_there").isNull()
        to_file = F.coalesce(F.col("to_kind"), F.lit("")) == "File"
        c = self.bound.groupBy("tool", "type")
        return self._shared(c.agg(F.count(F.lit(1)).alias("edges"), F.count_if("resolved").alias("resolved"), F.count_if("loop").alias("selfLoops"), F.count_if(loose).alias("dangling"), F.bool_or(to_file).alias("files"), F.bool_or(~to_file).alias("others")))

    def _edge_counts(self, scope: str, types: tuple[str, ...]) -> DataFrame:
        return self._all_counts(scope, types).drop("resolvedConfirmed", "resolvedTargetConfirmed")

    def _all_counts(self, scope: str, types: tuple[str, ...]) -> DataFrame:
        c, truth, loose = (x.where(F.col("scope") == scope).drop("scope") for x in self._counts)
        grid = self.tools.select("tool", F.explode(F.array(*map(F.lit, types))).alias("type"))
        out = grid.join(c, ["tool", "type"], "left").join(truth, "type", "left").join(loose, "type", "left").na.fill(0)
        out = with_scores(out.withColumn("fn", F.col("truth") - F.col("tp")))
        return out.withColumn("targetAccuracy", ratio(F.col("targetConfirmed"), F.col("tp"))).withColumn("siteCoverage", ratio(F.col("tp"), F.col("sites"))).drop("truth", "sites")

    def edges_by_type(self) -> DataFrame:
        """Main table: edge confusion, target accuracy, resolution, granularity, sites, rows that can't be scored."""
        raw = self._claimed.select("tool", "type", F.col("edges").alias("raw"), F.col("resolved").alias("res"))
        files = self._claimed.where("type = 'IMPORTS'").select("tool", (F.col("files") & ~F.col("others")).alias("only"))
        out = self._edge_counts("main", EDGE_TYPES).join(raw, ["tool", "type"], "left").join(files, "tool", "left")
        only = (F.col("type") == "IMPORTS") & F.coalesce("only", F.lit(False))
        return out.withColumn("resolutionRate", ratio(F.coalesce("res", F.lit(0)), F.coalesce("raw", F.lit(0)))).withColumn("onlyFileGranularity", only).drop("raw", "res", "only")

    def edges_overall(self) -> DataFrame:
        c = self._edge_counts("main", EDGE_TYPES).groupBy("tool").agg(*(F.sum(k).alias(k) for k in ("tp", "fp", "fn", "targetConfirmed", "abstentions")))
        return with_scores(c).withColumn("targetAccuracy", ratio(F.col("targetConfirmed"), F.col("tp")))

    def false_negatives(self) -> DataFrame:
        """(scope, tool, ord, nfrom, fromLocalId, type, targetName, siteCount): for each tool the relationships of the ground truth that no edge of it confirms."""
        claimed = self.verdicts.where(F.col("verdict").isin(TARGET, NAME)).select("scope", "tool", F.col("oracle_ord").alias("ord"))
        truth = adjudicate.collapsed(self.oracle).select("scope", "ord", "nfrom", "fromLocalId", "type", "targetName", "siteCount")
        return truth.crossJoin(F.broadcast(self.tools)).join(claimed, ["scope", "tool", "ord"], "left_anti")

    def extended(self) -> DataFrame:
        return self._edge_counts("extended", EXTENDED_TYPES)

    def member_implements(self) -> DataFrame:
        return self._edge_counts("member", ("IMPLEMENTS",))

    def imports_module_level(self) -> DataFrame:
        return agnostic.imports_module_level(self.bound, self.related)

    def uses_type(self) -> DataFrame:
        return agnostic.uses_type(self.bound, self.related)

    def method_overrides(self) -> DataFrame:
        return agnostic.method_overrides(self.bound, self.inputs.nodes, self.ends, self.related, self.symbols)

    def loops_and_dangling(self) -> DataFrame:
        """Self-loops (resolved or not) and edges without a node at an end, of the compared types."""
        c = self._claimed.groupBy("tool").agg(*(F.sum(k).alias(k) for k in ("edges", "selfLoops", "dangling")))
        return c.withColumn("danglingRate", ratio(F.col("dangling"), F.col("edges")))

    # -- depth, coverage, capabilities, headline

    def depth(self) -> DataFrame:
        """By type: edges claimed, edges confirmed, and of the resolved ones how many."""
        return self._depth

    @functools.cached_property
    def _depth(self) -> DataFrame:
        claimed = self._claimed.select("tool", "type", F.col("edges").alias("toolClaimed"), F.col("resolved").alias("resolvedTotal"))
        out = self._all_counts("main", EDGE_TYPES).join(claimed, ["tool", "type"], "left").na.fill(0)
        out = out.select("tool", "type", "tp", "fp", "fn", "toolClaimed", F.col("tp").alias("oracleConfirmed"), F.col("recall").alias("oracleRecall"), F.col("precision").alias("toolPrecision"), "targetConfirmed", "siteCoverage", "unscoreableExcluded", "unscoreableMatched", "resolvedTotal", "resolvedConfirmed", "resolvedTargetConfirmed")
        return self._shared(out)

    def depth_summary(self) -> DataFrame:
        """By tool, the sums over all types."""
        return self.depth().groupBy("tool").agg(*(F.sum(k).alias(v) for k, v in (("tp", "totalTp"), ("fp", "totalFp"), ("fn", "totalFn"))))

    def coverage(self) -> DataFrame:
        """For the tools that resolve edges, as references, and all others."""
        refs = sorted(r["tool"] for r in self.inputs.edges.where("resolved").select("tool").distinct().collect())
        return coverage.cross_tool(self.inputs.nodes, self.bound, self.ends, refs)

    def headline(self) -> DataFrame:
        """By tool: nodes, edges that assert a target, abstentions."""
        n = self.inputs.nodes.groupBy("tool").agg(F.count(F.lit(1)).alias("nodes"))
        e = self.inputs.edges.groupBy("tool").agg(F.count(F.lit(1)).alias("all"), F.count_if((F.col("fromId") == F.col("toId")) & F.col("resolved").eqNullSafe(False)).alias("abstentions"))
        return n.join(e, "tool", "left").na.fill(0).select("tool", "nodes", (F.col("all") - F.col("abstentions")).alias("asserted"), "abstentions")

    def resolution_tiers(self) -> DataFrame:
        c = self.related.where("type = 'CALLS' and resolutionTier is not null").groupBy("resolutionTier").agg(F.count(F.lit(1)).alias("n"))
        total = c.agg(F.sum("n").alias("total"))
        return c.join(F.broadcast(total)).select("resolutionTier", "n", ratio(F.col("n"), F.col("total")).alias("share"))

    def oracle_resolved_rate(self) -> DataFrame:
        """Of all ground-truth edges, those with a known target."""
        known = F.coalesce(F.col("targetLocalId"), F.lit("")) != ""
        return self.inputs.oracle_edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(known).alias("resolved")).withColumn("rate", ratio(F.col("resolved"), F.col("edges")))

    def kinds_modelled(self) -> DataFrame:
        return capability.observed(self.inputs.nodes, "kind")

    def types_modelled(self) -> DataFrame:
        return capability.observed(self.inputs.edges, "type")

    def capabilities(self) -> DataFrame:
        return capability.declared(self.inputs.capabilities, self.inputs.nodes)

    def drift(self) -> DataFrame:
        return capability.drift(self.inputs.capabilities, self.inputs.nodes, self.inputs.edges)
