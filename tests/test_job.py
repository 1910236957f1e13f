"""Adapters, pages, resumable caches and a full run from files."""

import json

import pytest

from graphscore import job
from graphscore.adapters import FORMATS, Tables
from graphscore.operators import ownership
from graphscore.sources import jsonl, lines, mdtable

NODE_HEAD = "| label | id | name | startLine | filePath | endLine |\n|---|---|---|---|---|---|\n"


def test_lines_are_numbered_over_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n two\n")
    (tmp_path / "b.txt").write_text("\n\nthree\n")
    (tmp_path / "c.txt").write_text("")
    assert sorted(map(tuple, lines.numbered(spark, str(tmp_path)).collect())) == [(0, "one"), (1, " two"), (2, "three")]
    assert [r["ord"] for r in lines.numbered(spark, str(tmp_path), blank=True).orderBy("ord").collect()] == list(range(6))


def test_long_file_in_many_splits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(f"{k} " + "x" * 50 for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = lines.numbered(spark, str(tmp_path / "a.txt"))
        assert got.rdd.getNumPartitions() > 1 and all(r["ord"] == int(r["value"].split()[0]) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_header_tells_the_columns(spark, tmp_path):
    p = tmp_path / "t.md"
    p.write_text("\t| name | extra | id |\n\t|---|---|---|\n\t| A | x | a |\t\n| B |\n")
    got = mdtable.cells(mdtable.read_lines(spark, str(p)), ["id", "name", "label"]).orderBy("ord").collect()
    assert [tuple(r)[1:] for r in got] == [("a", "A", ""), ("", "B", "")]
    p.write_text("| 1 | 2 |\n|---|---|\n| a | A |\n")
    assert [tuple(r)[1:] for r in mdtable.cells(mdtable.read_lines(spark, str(p)), ["id", "name"]).collect()] == [("a", "A")]


def test_pages_end_with_the_first_short_one(spark, tmp_path):
    page = lambda *ids: "\n".join(["| id |", "|---|", *(f"| {i} |" for i in ids)])
    for k, text in enumerate([page("a", "b"), json.dumps({"markdown": page("c", "d")}), page("e"), page("f", "g")]):
        (tmp_path / f"{k}.md").write_text(text)
    assert sorted(map(tuple, mdtable.pages(spark, str(tmp_path), ["id"], 2).collect())) == list(enumerate("abcde"))
    (tmp_path / "1.md").write_text("\n")
    assert mdtable.pages(spark, str(tmp_path), ["id"], 2).count() == 2
    (tmp_path / "1.md").write_text('{"error": "boom"}')
    with pytest.raises(Exception, match="boom"):
        mdtable.pages(spark, str(tmp_path), ["id"], 2).collect()


def test_projects_that_are_done_are_not_done_again(spark, tmp_path):
    ran = []
    make = lambda name: ran.append(name) or spark.createDataFrame([(name,)], "x string")
    jsonl.cached_by_project(spark, str(tmp_path), ["a", "b/c"], make)
    got = jsonl.cached_by_project(spark, str(tmp_path), ["a", "b/c", "b.c", "."], make)
    assert ran == ["a", "b/c", "b.c", "."] and sorted(map(tuple, got.collect())) == [(".", "."), ("a", "a"), ("b.c", "b.c"), ("b/c", "b/c")]
    assert jsonl.slugs(["a", "b/c", "b.c", "."]) == ["a", "b_c", "b_c-2", "root"]


def test_exclusive_ownership(spark):
    owned = spark.createDataFrame([("a.ts", "."), ("b.ts", "x")], "path string, rootPath string")
    assert ownership.exclusive(owned) is owned
    with pytest.raises(ValueError, match=r"a\.ts belongs to 2 projects"):
        ownership.exclusive(owned.union(owned.limit(1)))


def test_adapters_agree_and_cache(spark, tmp_path):
    nodes = [("f", "File", "a.ts", "src/a.ts", 1), ("c", "Class", "Foo", "src/a.ts", 3), ("m", "Method", "run", "src/a.ts", 4)]
    (tmp_path / "j").mkdir()
    (tmp_path / "j/n").write_text("\n".join(json.dumps(dict(zip(("id", "kind", "name", "path", "startLine"), n, strict=True))) for n in nodes))
    (tmp_path / "j/e").write_text(json.dumps({"fromId": "m", "toId": "c", "type": "CALLS", "resolved": True}))
    (tmp_path / "n").mkdir()
    (tmp_path / "e").mkdir()
    (tmp_path / "n/0").write_text(NODE_HEAD + "\n".join(f"| {k} | {i} | {n} | {line} | {p} | |" for i, k, n, p, line in nodes))
    (tmp_path / "e/0").write_text("| fromId | type | confidence | toId | toName |\n|---|---|---|---|---|\n| m | CALLS | 0.9 | c | Foo |")
    paths = {"jsonl": {"nodes": f"{tmp_path}/j/n", "edges": f"{tmp_path}/j/e"}, "tables": {"nodes": f"{tmp_path}/n", "edges": f"{tmp_path}/e"}}
    got = {f: FORMATS[f]("t").normalize(spark, p) for f, p in paths.items()}
    rows = {f: [tuple(r) for r in g.nodes.select("tool", "ord", "id", "name", "path", "kind", "startLine").orderBy("ord").collect()] for f, g in got.items()}
    assert rows["jsonl"] == rows["tables"] and len({tuple(g.nodes.columns) for g in got.values()}) == 1
    assert [tuple(g.edges.first())[:6] for g in got.values()] == [("t", 0, "m", "c", "CALLS", True)] * 2
    for use in (False, True):
        kept = Tables("t").normalize(spark, paths["tables"] if not use else {}, f"{tmp_path}/cache", use)
        assert kept.nodes.count() == 3 and kept.edges.count() == 1
    with pytest.raises(ValueError, match="no path for nodes"):
        Tables("t").normalize(spark, {})


@pytest.fixture
def target(tmp_path):
    """A tool that has everything, one that misses a call, and the ground truth, as files."""
    dump = lambda name, rows: ((tmp_path / name).write_text("\n".join(map(json.dumps, rows))), f"{tmp_path}/{name}")[1]
    nodes = [{"id": "f", "name": "a.ts", "path": "src/a.ts", "kind": "File"}, {"id": "c", "name": "Foo", "path": "src/a.ts", "startLine": 1, "kind": "Class"}, {"id": "m", "name": "bar", "path": "src/a.ts", "startLine": 3, "kind": "Method", "parentId": "c"}, {"id": "h", "name": "helper", "path": "src/a.ts", "startLine": 13, "kind": "Function"}]
    edges = [{"fromId": "m", "toId": "h", "type": "CALLS", "resolved": True}]
    symbols = [{"path": "src/a.ts", "localId": i, "name": n, "kind": k, "startLine": a, "endLine": b, **p} for i, n, k, a, b, p in (("Foo", "Foo", "Class", 1, 10, {}), ("Foo.bar", "bar", "Method", 3, 8, {"parentLocalId": "Foo"}), ("helper", "helper", "Function", 13, 15, {}))]
    truth = [{"fromPath": "src/a.ts", "fromLocalId": "Foo.bar", "type": "CALLS", "targetName": "helper", "targetPath": "src/a.ts", "targetLocalId": "helper", "targetStartLine": 13, "resolutionTier": "symbol"}]
    tool = lambda name, e, **more: {"name": name, "format": "jsonl", "paths": {"nodes": dump("n", nodes), "edges": dump(f"e-{name}", e)}, **more}
    config = {"demo": {"label": "Demo repo", "commit": "abc1", "stats": "One file.", "caveats": ["Made up."], "tools": [tool("whole", edges, capabilities=["CALLS edges", "ACCESSES edges"], cost=["1 s", "1 MB", "1 KB", "—"]), tool("bare", [])], "oracle": {"symbols": dump("s", symbols), "edges": dump("t", truth)}}}
    (tmp_path / "targets.json").write_text(json.dumps(config))
    return tmp_path


def test_full_run_from_files(spark, target):
    out, common = target / "card.md", ["--targets", f"{target}/targets.json", "--target", "demo", "--out", f"{target}/card.md", "--cache", f"{target}/cache"]
    job.main([*common, "--tables", f"{target}/tables", "--commit-sha", "def2"])
    text = out.read_text()
    for part in ("# Code graph scorecard: Demo repo", "at `def2`", "One file.", "### Key terms", "## Caveats", "Made up.", "## Glossary", "## Deliverables", "## Cost", "| whole | 1 s | 1 MB | 1 KB | — |", "whole declares “ACCESSES edges” but has no ACCESSES edge"):
        assert part in text, part
    assert text.index("### whole") < text.index("### bare")  # in the order of the target
    missed = spark.read.parquet(f"{target}/tables/false_negatives").collect()
    assert [(r["tool"], r["targetName"]) for r in missed] == [("bare", "helper")]
    summary = {r["tool"]: (r["totalTp"], r["totalFp"], r["totalFn"]) for r in spark.read.parquet(f"{target}/tables/depth_summary").collect()}
    assert summary == {"whole": (1, 0, 0), "bare": (0, 0, 1)}
    for name in ("n", "e-whole", "e-bare", "s", "t"):  # from now on only the cache is left
        (target / name).unlink()
    job.main([*common, "--use-cache", "--skip-oracle", "--skip-tool", "bare"])
    assert "bare" not in out.read_text()


def test_flags_that_cannot_be_met(target):
    with pytest.raises(SystemExit, match="unknown target 'x': expected one of demo"):
        job.main(["--targets", f"{target}/targets.json", "--target", "x"])
    found = job.targets(f"{target}/targets.json")["demo"]
    with pytest.raises(ValueError, match="no tool"):
        job.inputs(None, found, skip=("whole", "bare"))
    with pytest.raises(ValueError, match="needs --cache"):
        job.inputs(None, found, skip_oracle=True)
