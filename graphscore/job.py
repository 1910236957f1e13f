"""A full run from files: ``python -m graphscore.job --targets targets.json --target NAME --out scorecard.md``.

The targets file holds, by name, what is scored (see Target). Exports are read through their adapters, or from the cache with
--use-cache; a tool is left out with --skip-tool; --skip-oracle takes the ground truth from the cache alone.
"""

from __future__ import annotations

import argparse
import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from . import schemas
from .adapters import FORMATS
from .plans import report
from .plans.score import Inputs, Score
from .sources import jsonl
from .staging import hashed_joins


@dataclass(frozen=True)
class Tool:
    name: str
    format: str
    paths: dict[str, str]
    capabilities: list[str] = field(default_factory=list)
    #: Wall clock, peak memory, index size, notes: printed as they are.
    cost: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Target:
    """A repository at a commit, the tools that indexed it, and its ground truth (paths of symbols and edges as JSON lines)."""

    name: str
    label: str
    commit: str
    tools: list[Tool]
    oracle: dict[str, str]
    stats: str = ""
    caveats: list[str] = field(default_factory=list)


def targets(path: str) -> dict[str, Target]:
    """The registry in a JSON file: by name, the fields of Target and of its tools."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    return {name: Target(**{"name": name, "label": name, **t, "tools": [Tool(**x) for x in t["tools"]]}) for name, t in found.items()}


def inputs(spark: SparkSession, target: Target, cache: str | None = None, use_cache: bool = False, skip_oracle: bool = False, skip: tuple[str, ...] = ()) -> Inputs:
    """The relations of a target. Tools are scored in the order in which the target names them."""
    tools = [t for t in target.tools if t.name not in skip]
    if not tools:
        raise ValueError("no tool is left to score")
    if skip_oracle and not cache:
        raise ValueError("--skip-oracle needs --cache")
    graphs = [FORMATS[t.format](t.name).normalize(spark, t.paths, cache, use_cache) for t in tools]

    def truth(kind: str, schema: str) -> DataFrame:
        read = lambda: jsonl.read(spark, target.oracle[kind], schema)
        if not cache:
            return read()
        path = f"{cache}/oracle/{kind}"
        if skip_oracle and not jsonl.exists(spark, f"{path}/_SUCCESS"):
            raise FileNotFoundError(f"--skip-oracle: nothing is cached at {path}")
        return jsonl.cached(spark, path, read, use_cache or skip_oracle)

    nodes, edges = graphs[0].nodes, graphs[0].edges
    for g in graphs[1:]:
        nodes, edges = nodes.unionByName(g.nodes), edges.unionByName(g.edges)
    claims = [(k, t.name, c) for k, (t, c) in enumerate((t, c) for t in tools for c in t.capabilities)]
    capabilities = spark.createDataFrame(claims, "ord int, tool string, capability string") if claims else None
    return Inputs(nodes, edges, truth("symbols", schemas.ORACLE_SYMBOLS), truth("edges", schemas.ORACLE_EDGES), capabilities, [t.name for t in tools])


TABLES = ("nodes_by_kind", "nodes_overall", "kind_labelling", "kind_labelling_overall", "edges_by_type", "edges_overall", "extended", "member_implements", "imports_module_level", "uses_type", "method_overrides", "depth", "depth_summary", "false_negatives", "headline", "kind_histogram")


def run(spark: SparkSession, target: Target, out: str, commit: str | None = None, tables: str | None = None, **options) -> Score:
    """Scores a target and writes the report to ``out``, and the metric tables as Parquet under ``tables``."""
    hashed_joins(spark)
    score = Score(inputs(spark, target, **options), cached=True)
    skip = options.get("skip", ())
    cost = [(t.name, *t.cost) for t in target.tools if t.cost and t.name not in skip]
    report.write(score, out, title=f"Code graph scorecard: {target.label}", cost=cost, about=report.About(target.label, commit or target.commit, target.stats, target.caveats))
    for name in TABLES if tables else ():
        getattr(score, name)().write.mode("overwrite").parquet(f"{tables}/{name}")
    return score


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphscore", description="Scores code graphs against ground truth.")
    p.add_argument("--targets", required=True, help="JSON file of targets")
    p.add_argument("--target", default=os.environ.get("GRAPHSCORE_TARGET"), help="which of them (or GRAPHSCORE_TARGET)")
    p.add_argument("--out", default="scorecard.md")
    p.add_argument("--tables", help="folder for the metric tables")
    p.add_argument("--cache", help="folder for normalised graphs and ground truth")
    p.add_argument("--use-cache", action="store_true")
    p.add_argument("--skip-oracle", action="store_true")
    p.add_argument("--skip-tool", action="append", default=[])
    p.add_argument("--commit-sha")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    known = targets(args.targets)
    if args.target not in known:
        raise SystemExit(f"unknown target {args.target!r}: expected one of {', '.join(sorted(known))}")
    spark = SparkSession.builder.appName("graphscore").getOrCreate()
    run(spark, known[args.target], args.out, args.commit_sha, args.tables, cache=args.cache, use_cache=args.use_cache, skip_oracle=args.skip_oracle, skip=tuple(args.skip_tool))


if __name__ == "__main__":
    main()
