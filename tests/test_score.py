"""Scoring rules on literal graphs, and invariants on the derived test graph."""

import pytest

from graphscore.plans.score import Inputs, Score
from graphscore.plans.testgraph import tables
from graphscore.schemas import EDGES, NODES, ORACLE_EDGES, ORACLE_SYMBOLS

DIR = "/root/testdata/sf0.001"
SYMBOLS = [("src/a.ts", "Foo", "Foo", "Class", 1, None), ("src/a.ts", "Foo.bar", "bar", "Method", 3, "Foo"), ("src/a.ts", "helper", "helper", "Function", 13, None)]
PERFECT = [("t:Foo", "Foo", "src/a.ts", "Class", 1), ("t:Foo.bar", "bar", "src/a.ts", "Method", 3), ("t:helper", "helper", "src/a.ts", "Function", 13)]


def score(spark, symbols, oracle, nodes, edges, tool="t"):
    """symbols: (path, localId, name, kind, line, parent); oracle: (fromPath, fromLocalId, type, name, path, id, line[, scoreable]); nodes: (id, name, path, kind, line[, parent]); edges: (from, to, type[, resolved])."""
    s = spark.createDataFrame([(k, p, i, n, kind, line, line, up) for k, (p, i, n, kind, line, up) in enumerate(symbols)], ORACLE_SYMBOLS)
    o = spark.createDataFrame([(k, *r[:7], None, (r[7:] or [None])[0], None) for k, r in enumerate(oracle)], ORACLE_EDGES)
    n = spark.createDataFrame([(tool, k, r[0], r[1], r[2], r[3], r[4], None, (r[5:] or [None])[0], None, None) for k, r in enumerate(nodes)], NODES)
    e = spark.createDataFrame([(tool, k, r[0], r[1], r[2], (r[3:] or [True])[0], None, None) for k, r in enumerate(edges)], EDGES)
    return Score(Inputs(n, e, s, o))


def row(df, **at):
    return next(r.asDict() for r in df.collect() if all(r[k] == v for k, v in at.items()))


CALL = ("src/a.ts", "Foo.bar", "CALLS", "helper", "src/a.ts", "helper", 13)


def test_perfect_tool(spark):
    s = score(spark, SYMBOLS, [CALL], PERFECT, [("t:Foo.bar", "t:helper", "CALLS")])
    n, e = row(s.nodes_overall()), row(s.edges_by_type(), type="CALLS")
    assert (n["f1"], n["macroF1"], e["f1"], e["targetAccuracy"], e["resolutionRate"]) == (1, 1, 1, 1, 1)


def test_missing_and_invented_symbol(spark):
    nodes = [*PERFECT[:2], ("t:Ghost", "Ghost", "src/a.ts", "Function", 99)]
    s = score(spark, SYMBOLS, [CALL], nodes, [("t:Foo.bar", "t:Ghost", "CALLS")])
    n, e = row(s.nodes_overall()), row(s.edges_by_type(), type="CALLS")
    assert [n[k] for k in ("tp", "fp", "fn")] == [2, 1, 1]
    assert [e[k] for k in ("tp", "fp", "fn")] == [0, 1, 1]


def test_name_tier_and_abstention_and_dangling(spark):
    oracle = [("src/a.ts", "Foo.bar", "CALLS", "helper", "src/z.ts", "helper", 1)]
    edges = [("t:Foo.bar", "t:helper", "CALLS"), ("t:Foo.bar", "t:Foo.bar", "CALLS", False), ("t:Foo.bar", "gone", "CALLS")]
    e = row(score(spark, SYMBOLS, oracle, PERFECT, edges).edges_by_type(), type="CALLS")
    assert [e[k] for k in ("tp", "fp", "fn", "nameOnlyConfirmed", "abstentions")] == [1, 1, 0, 1, 1]


def test_imports_of_files_count_by_module_only(spark):
    symbols = [("src/b.ts", "helper", "helper", "Function", 3, None)]
    oracle = [("src/a.ts", "src/a.ts", "IMPORTS", "helper", "src/b.ts", "helper", 3)]
    nodes = [("a", "a.ts", "src/a.ts", "File", 1), ("b", "b.ts", "src/b.ts", "File", 1), ("h", "helper", "src/b.ts", "Function", 3)]
    only = score(spark, symbols, oracle, nodes, [("a", "b", "IMPORTS")])
    e = row(only.edges_by_type(), type="IMPORTS")
    assert (e["fp"], e["tp"], e["onlyFileGranularity"]) == (0, 0, True)
    assert row(only.imports_module_level())["tp"] == 1
    both = score(spark, symbols, oracle, nodes, [("a", "b", "IMPORTS"), ("a", "h", "IMPORTS")])
    e = row(both.edges_by_type(), type="IMPORTS")
    assert (e["fp"], e["tp"], e["onlyFileGranularity"]) == (0, 1, False)


def test_same_local_id_in_two_files(spark):
    symbols = [(p, i, n, k, line, None) for p in ("src/a.ts", "src/b.ts") for i, n, k, line in (("Foo.bar", "bar", "Method", 3), ("baz", "baz", "Function", 9))]
    oracle = [(p, "Foo.bar", "CALLS", "baz", p, "baz", 9) for p in ("src/a.ts", "src/b.ts")]
    nodes = [(f"{p}{n}", n, p, k, line) for p in ("src/a.ts", "src/b.ts") for n, k, line in (("bar", "Method", 3), ("baz", "Function", 9))]
    e = row(score(spark, symbols, oracle, nodes, [("src/a.tsbar", "src/a.tsbaz", "CALLS")]).edges_by_type(), type="CALLS")
    assert [e[k] for k in ("tp", "fp", "fn")] == [1, 0, 1]


def test_collapse_sites_and_unscoreable(spark):
    oracle = [CALL, CALL, ("src/a.ts", "Foo.bar", "CALLS", "push", None, None, None, False)]
    s = score(spark, SYMBOLS, oracle, PERFECT, [("t:Foo.bar", "t:helper", "CALLS")])
    e = row(s.edges_by_type(), type="CALLS")
    assert [e[k] for k in ("tp", "fp", "fn", "siteCoverage", "unscoreableExcluded")] == [1, 0, 0, 0.5, 1]


def test_repeated_claims_are_wrong_unless_excused(spark):
    e = row(score(spark, SYMBOLS, [CALL], PERFECT, [("t:Foo.bar", "t:helper", "CALLS")] * 2).edges_by_type(), type="CALLS")
    assert [e[k] for k in ("tp", "fp")] == [1, 1]
    loose = ("src/a.ts", "Foo.bar", "CALLS", "helper", None, None, None, False)
    e = row(score(spark, SYMBOLS, [CALL, loose], PERFECT, [("t:Foo.bar", "t:helper", "CALLS")] * 2).edges_by_type(), type="CALLS")
    assert [e[k] for k in ("tp", "fp", "unscoreableMatched")] == [1, 0, 1]


def test_member_implements_apart_and_depth_agrees(spark):
    symbols = [("a.ts", "C", "C", "Class", 1, None), ("a.ts", "C.m", "m", "Method", 2, "C"), ("a.ts", "I", "I", "Interface", 9, None), ("a.ts", "I.m", "m", "Method", 10, "I")]
    oracle = [("a.ts", "C", "IMPLEMENTS", "I", "a.ts", "I", 9), ("a.ts", "C.m", "IMPLEMENTS", "m", "a.ts", "I.m", 10)]
    nodes = [("c", "C", "a.ts", "Class", 1), ("m", "m", "a.ts", "Method", 2), ("i", "I", "a.ts", "Interface", 9), ("im", "m", "a.ts", "Method", 10)]
    s = score(spark, symbols, oracle, nodes, [("c", "i", "IMPLEMENTS"), ("m", "im", "IMPLEMENTS")])
    main, member, depth = row(s.edges_by_type(), type="IMPLEMENTS"), row(s.member_implements()), row(s.depth(), type="IMPLEMENTS")
    assert [(x["tp"], x["fp"], x["fn"]) for x in (main, member, depth)] == [(1, 0, 0)] * 3
    assert (depth["toolClaimed"], depth["resolvedTotal"], depth["resolvedConfirmed"]) == (2, 2, 1)


def test_overrides_by_class_recover_attribution(spark):
    symbols = [("a.ts", "B", "B", "Class", 1, None), ("a.ts", "B.m", "m", "Method", 2, "B"), ("a.ts", "C", "C", "Class", 5, None), ("a.ts", "C.m", "m", "Method", 6, "C")]
    oracle = [("a.ts", "C.m", "METHOD_OVERRIDES", "m", "a.ts", "B.m", 2)]
    nodes = [("b", "B", "a.ts", "Class", 1), ("bm", "m", "a.ts", "Method", 2, "b"), ("c", "C", "a.ts", "Class", 5), ("cm", "m", "a.ts", "Method", 6, "c")]
    s = score(spark, symbols, oracle, nodes, [("c", "bm", "METHOD_OVERRIDES")])
    assert row(s.extended(), type="METHOD_OVERRIDES")["tp"] == 0
    assert [row(s.method_overrides())[k] for k in ("tp", "fp", "fn")] == [1, 0, 0]


def test_kind_labels(spark):
    nodes = [("x", "Foo", "src/a.ts", "Unknown", 1), ("y", "bar", "src/a.ts", "Function", 3), PERFECT[2]]
    got = {r["kind"]: (r["correct"], r["unlabelled"], r["mislabelled"]) for r in score(spark, SYMBOLS, [CALL], nodes, []).kind_labelling().collect()}
    assert got == {"Class": (0, 1, 0), "Method": (0, 0, 1), "Function": (1, 0, 0)}


def test_empty_edges_and_oracle(spark):
    s = score(spark, SYMBOLS, [], PERFECT, [])
    assert all(r["tp"] + r["fp"] + r["fn"] == 0 for r in s.edges_by_type().collect())


@pytest.fixture(scope="module")
def graph(spark):
    return tables(spark, DIR, ("oracle_symbols", "oracle_edges"))


def test_a_tool_made_from_the_ground_truth_is_perfect(spark, graph):
    """Also: the score doesn't depend on the tool's name or on how it writes accessors."""
    from pyspark.sql import functions as F

    from graphscore.functions.metrics import derived_scoreable
    from graphscore.operators import dedupe

    sym, edges = graph["oracle_symbols"], derived_scoreable(graph["oracle_edges"])
    nid = lambda p, i: F.concat_ws("|", p, i)
    syms = sym.select(F.lit("one").alias("tool"), "ord", nid("path", "localId").alias("id"), "name", "path", "kind", "startLine", F.lit(None).cast("string").alias("parentId"))
    files = sym.groupBy("path").agg(F.min("ord").alias("o")).select(F.lit("one"), F.col("o") + 10**9, nid(F.col("path"), F.col("path")), "path", "path", F.lit("File"), F.lit(1), F.lit(None).cast("string"))
    one = syms.union(files)
    two = one.withColumns({"tool": F.lit("two"), "name": F.regexp_replace("name", "^get:", "[get]")})
    made = dedupe.oracle_edges(edges.where("targetLocalId is not null")).select(F.lit("one").alias("tool"), "ord", nid("fromPath", "fromLocalId").alias("fromId"), nid("targetPath", "targetLocalId").alias("toId"), "type", F.lit(True).alias("resolved"))
    s = Score(Inputs(one.union(two), made.union(made.withColumn("tool", F.lit("two"))), sym, graph["oracle_edges"]), cached=True)
    assert [(r["fp"], r["fn"]) for r in s.nodes_overall().collect()] == [(0, 0)] * 2
    counts = {(r["tool"], r["type"]): (r["tp"], r["fp"], r["fn"], r["targetConfirmed"]) for r in s.edges_by_type().collect()}
    assert all(fp == fn == 0 and tp == t for tp, fp, fn, t in counts.values())
    assert all(counts["one", t] == counts["two", t] for t in ("CALLS", "IMPORTS", "EXTENDS", "IMPLEMENTS"))


def test_coverage(spark):
    n = spark.createDataFrame([(t, k, f"{t}{k}", name, "a.ts", "Function", 1, None, None, None, None) for t in ("r", "c") for k, name in enumerate(("f", "g", "h"))], NODES)
    e = spark.createDataFrame([("r", 0, "r0", "r1", "CALLS", True, None, None), ("r", 1, "r0", "r2", "CALLS", True, None, None), ("r", 2, "r0", "gone", "CALLS", True, None, None), ("c", 0, "c0", "c1", "CALLS", None, None, None)], EDGES)
    s = Score(Inputs(n, e, spark.createDataFrame([], ORACLE_SYMBOLS), spark.createDataFrame([], ORACLE_EDGES)))
    got = row(s.coverage(), type="CALLS")
    assert [got[k] for k in ("ref_tool", "other_tool", "referenceResolved", "covers", "misses")] == ["r", "c", 3, 1, 2]


def test_derived_graph_keeps_all_rows(spark):
    """The links are all calls, and gamma's edges all but the type it lacks."""
    t = tables(spark, DIR, ("calls", "links", "edges"))
    calls = t["calls"].count()
    assert t["links"].count() == calls == spark.read.parquet(f"{DIR}/lineitem.parquet").count()
    assert t["edges"].where("tool = 'gamma'").count() == t["calls"].where("type <> 'ACCESSES'").count()


def test_hot_sources_are_dealt_by_tool(spark, monkeypatch):
    """Verdicts don't depend on whether a source's edges are dealt out by tool."""
    from graphscore.operators import adjudicate

    t = tables(spark, DIR, ("nodes", "edges", "oracle_symbols", "oracle_edges"))
    s = Score(Inputs(t["nodes"], t["edges"], t["oracle_symbols"], t["oracle_edges"]), cached=True)
    plain = sorted(map(tuple, s.verdicts.collect()), key=repr)
    monkeypatch.setattr(adjudicate, "HOT", 20)
    assert sorted(map(tuple, adjudicate.verdicts(s.bound, s.oracle).collect()), key=repr) == plain


def test_edges_carry_no_texts(spark):
    """Scoring only tests paths, ids and names for equality, so each edge carries numbers instead; the texts stay with the nodes."""
    t = tables(spark, DIR, ("nodes", "edges", "oracle_symbols", "oracle_edges"))
    s = Score(Inputs(t["nodes"], t["edges"], t["oracle_symbols"], t["oracle_edges"]))
    assert {c for c, kind in s.bound.dtypes if kind == "string"} <= {"tool", "type", "scope", "rule", "to_kind"}


@pytest.mark.parametrize("hot", [100_000, 20])
def test_relationships_are_counted_where_edges_meet_them(spark, monkeypatch, hot):
    """The stream that gives verdicts also counts relationships, each once, whether or not a source is dealt out by tool."""
    from graphscore.operators import adjudicate

    monkeypatch.setattr(adjudicate, "HOT", hot)
    t = tables(spark, DIR, ("nodes", "edges", "oracle_symbols", "oracle_edges"))
    s = Score(Inputs(t["nodes"], t["edges"], t["oracle_symbols"], t["oracle_edges"]), cached=True)
    got = adjudicate.judged(s.bound, s.related).where("tool is null").groupBy("scope", "type").sum("ord").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, adjudicate.collapsed(s.oracle).groupBy("scope", "type").count().collect()))


def test_numbers_for_nulls_and_parts(spark):
    """Values that differ in where a null or a boundary is have different numbers."""
    from pyspark.sql import functions as F

    from graphscore.operators.adjudicate import named_key, source_key

    rows = spark.createDataFrame([("a", None), (None, "a"), ("ab", "c"), ("a", "bc"), ("", "abc"), (None, None), ("", "")], "p string, l string")
    keys = rows.select(F.explode(F.array(source_key(F.col("p"), F.col("l")), named_key(F.col("p"), F.col("l"))))).collect()
    assert len({r[0] for r in keys}) == 14
