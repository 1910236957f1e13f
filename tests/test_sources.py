"""Readers of the supported exports, projects, report cells and the entry module."""

import json

import pytest
from pyspark.sql import functions as F

from graphscore.operators import ownership
from graphscore.plans import report
from graphscore.schemas import EDGES, NODES
from graphscore.sources import files, jsonl, mdtable, nodelink, records
from graphscore.streaming import ingest


def test_json_lines(spark, tmp_path):
    p = tmp_path / "n.jsonl"
    p.write_text("\n".join(['{"id":"b","name":"x","path":"p","kind":"Class","startLine":3}', "", '{"id":"a","name":"y","path":"p","kind":"Class"}']) + "\n")
    got = jsonl.read(spark, str(p), NODES, "t").orderBy("ord").collect()
    assert [(r["tool"], r["ord"], r["id"], r["startLine"]) for r in got] == [("t", 0, "b", 3), ("t", 1, "a", None)]
    p.write_text("{broken\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        jsonl.read(spark, str(p), NODES, "t").collect()


def test_cache(spark, tmp_path):
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert jsonl.cached(spark, str(tmp_path / "c"), make).count() == 3
    assert len(calls) == 1


def test_node_link(spark, tmp_path):
    doc = {"built_at_commit": "c1", "nodes": [{"id": "f", "label": "a.ts", "source_file": "src/a.ts"}, {"id": "m", "label": ".run()", "source_file": "src/a.ts", "source_location": "L48"}, {"id": "g", "label": "go()", "source_file": "src/a.ts"}, {"id": "c", "label": "Foo", "source_file": "src/a.ts", "source_location": "48"}], "links": [{"source": "c", "target": "m", "relation": "method", "confidence": "EXTRACTED"}, {"source": "g", "target": "m", "relation": "calls", "confidence": "INFERRED"}, {"source": "g", "target": "m", "relation": "cites", "confidence": "EXTRACTED"}, {"source": "c", "target": "g", "relation": "inherits", "confidence": "EXTRACTED", "confidence_score": 0.7}]}
    (tmp_path / "g.json").write_text(json.dumps(doc, indent=1))
    raw, links, commit = nodelink.read(spark, str(tmp_path / "g.json"))
    assert commit.first()["commitSha"] == "c1"
    got = {r["id"]: (r["name"], r["kind"], r["startLine"]) for r in nodelink.nodes(raw, links, "t").collect()}
    assert got == {"f": ("a.ts", "File", None), "m": ("run", "Method", 48), "g": ("go", "Function", None), "c": ("Foo", "Unknown", None)}
    got = [(r["type"], r["resolved"], r["confidence"]) for r in nodelink.edges(links, "t").orderBy("ord").collect()]
    assert got == [("CONTAINS", True, 1.0), ("CALLS", False, 0.5), ("EXTENDS", True, 0.7)]


def _link_document() -> dict:
    awkward = ["}", "{", "]}", '"', "\\", '\\"{', "links", '"nodes":[{', "é€", "a,b", "\n", ""]
    nodes = [{"id": f"n{k}", "label": awkward[k % len(awkward)] * (k % 4), **({"metadata": {"kind": "{x}", "language": "ts"}, "more": [[{"a": [k]}], {}]} if k % 3 else {}), "source_file": None if k % 5 else "s"} for k in range(40)]
    links = [{"source": f"n{k}", "target": awkward[k % len(awkward)], "relation": "calls", "confidence_score": k / 7} for k in range(50)]
    return {"graph": {"x": {"nodes": [{"id": "no"}]}, "y": [1, {"links": [2]}]}, "nodes": nodes, "built_at_commit": "c{1", "hyperedges": [{"id": {"a": 1}, "nodes": ["{"]}, {}], "links": links, "multigraph": False}


@pytest.mark.parametrize("indent", [None, 1])
def test_node_link_in_many_splits(spark, tmp_path, indent):
    doc, text = _link_document(), json.dumps(_link_document(), indent=indent, ensure_ascii=False)
    (tmp_path / "g.json").write_text(text)
    (tmp_path / "parts").mkdir()
    lines = text.splitlines(keepends=True)
    for k in range(0, len(lines), 70):
        (tmp_path / "parts" / f"part-{k:05}").write_text("".join(lines[k : k + 70]))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for size, batch in ((701, 3), (1 << 20, 7)):
            for k, v in zip(old, (size, 1, batch), strict=True):
                spark.conf.set(k, v)
            for name in ("g.json", "parts"):
                nodes, links, commit = nodelink.read(spark, str(tmp_path / name))
                assert [r["commitSha"] for r in commit.collect()] == ["c{1"]
                got = [(r["ord"], r["id"], r["label"], r["metadata"] and r["metadata"]["kind"], r["source_file"]) for r in nodes.orderBy("ord").collect()]
                assert got == [(k, x["id"], x["label"], "{x}" if "metadata" in x else None, x["source_file"]) for k, x in enumerate(doc["nodes"])]
                got = [(r["ord"], r["source"], r["target"], r["confidence_score"]) for r in links.orderBy("ord").collect()]
                assert got == [(k, x["source"], x["target"], x["confidence_score"]) for k, x in enumerate(doc["links"])]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("text", ['{"nodes":[{"id":"a"}],"links":[]', '{"nodes":[{"id":"a"}', '{"nodes":[{"id":"a"},', "{", '{"nodes":[{"id":"a"}{"id":"b"}]}', '{"nodes":[{"id":"a"},]}', '{"nodes":[{"id":"a"},3]}', '{"nodes":[["a"]]}', '{"nodes":{"a":{}}}', '{"nodes":[{"id":}]}', '{"nodes":[{"id":"a"}],"links":[{"source":"}]}'])
def test_node_link_malformed(spark, tmp_path, text):
    (tmp_path / "g.json").write_text(text)
    with pytest.raises(Exception):  # noqa: B017
        [x.collect() for x in nodelink.read(spark, str(tmp_path / "g.json"))]


def test_node_link_needs_no_whole_document(spark, tmp_path):
    """Two parts, neither of them a document."""
    (tmp_path / "part-0").write_text('{"nodes":[{"id":"a"}\n')
    (tmp_path / "part-1").write_text(',{"id":"b"}],"links":[]}\n')
    nodes, links, commit = nodelink.read(spark, str(tmp_path))
    assert [(r["ord"], r["id"]) for r in nodes.orderBy("ord").collect()] == [(0, "a"), (1, "b")]
    assert links.count() == 0 and commit.first()["commitSha"] is None


def test_tagged_records(spark, tmp_path):
    rows = [{"kind": "header"}, {"kind": "node", "id": "f", "name": "a.ts", "node_type": "FILE", "file": "a.ts", "line": 0, "end_line": 9, "text": "x"}, {"kind": "node", "id": "c", "name": "constructor", "node_type": "FUNCTION", "class_name": "K", "file": "a.ts", "line": 4, "end_line": 5}, {"kind": "edge", "source_id": "f", "target_id": "c", "relationship_type": "CONTAINS"}, {"kind": "edge", "source_id": "c", "target_id": "f", "relationship_type": "REFERENCES"}, {"kind": "footer", "node_count": 2, "edge_count": 2}]
    p = tmp_path / "r.ndjson"
    p.write_text("\n\n".join(map(json.dumps, rows)))
    got = records.checked(records.read(spark, str(p)), counts=True)
    assert {r["id"]: (r["kind"], r["startLine"], r["endLine"], r["parentId"]) for r in records.nodes(got, "t").collect()} == {"f": ("File", 1, 10, None), "c": ("Constructor", 5, 6, "f")}
    assert [(r["fromId"], r["type"], r["resolved"]) for r in records.edges(got, "t").collect()] == [("c", "USES_TYPE", None)]
    p.write_text(json.dumps({"kind": "footer", "error": "boom"}))
    with pytest.raises(ValueError, match="boom"):
        records.checked(records.read(spark, str(p)))


def test_markdown_tables(spark, tmp_path):
    p = tmp_path / "t.md"
    p.write_text("some words\n| id | name | filePath | startLine | endLine | label |\n|---|---|---|---|---|---|\n| a | A | f.ts | 3 | x | TypeAlias |\n| | B | f.ts | 1 | 2 | Class |\n| c | C |\n")
    got = mdtable.nodes(mdtable.cells(mdtable.read_lines(spark, str(p)), ["id", "name", "filePath", "startLine", "endLine", "label"]), "t").orderBy("ord").collect()
    assert [(r["id"], r["kind"], r["startLine"], r["endLine"], r["path"]) for r in got] == [("a", "Alias", 3, None, "f.ts"), ("c", "Unknown", None, None, "")]
    t = spark.createDataFrame([(0, "a", "CALLS", "0.5", "b", ""), (1, "a", "CALLS", "", "b", ""), (2, "a", "STEP", "1", "b", ""), (3, "", "CALLS", "1", "b", "")], "ord long, fromId string, type string, confidence string, toId string, toName string")
    assert [(r["resolved"], r["confidence"]) for r in mdtable.edges(t, "t").orderBy("ord").collect()] == [(True, 0.5), (None, None)]


@pytest.mark.parametrize(
    ("paths", "roots", "owner"),
    [
        (["package.json", "apps/foo/package.json", "apps/foo/tsconfig.json", "apps/foo/index.ts", "apps/foobar/x.ts"], {".": None, "apps/foo": "apps/foo/tsconfig.json"}, {"apps/foo/index.ts": "apps/foo", "apps/foobar/x.ts": "."}),
        (["src/tsconfig.json", "src/a.ts", "b.ts"], {".": None, "src": "src/tsconfig.json"}, {"src/a.ts": "src", "b.ts": "."}),
        (["a/tsconfig.zeta.json", "a/tsconfig.alpha.json", "a/x.ts"], {".": None, "a": "a/tsconfig.alpha.json"}, {"a/x.ts": "a"}),
        (["tsconfig.build.json", "tsconfig.app.json", "mytsconfig.json"], {".": "tsconfig.app.json"}, {"mytsconfig.json": "."}),
        (["x.ts"], {".": None}, {"x.ts": "."}),
    ],
)
def test_projects(spark, paths, roots, owner):
    f = spark.createDataFrame(list(enumerate(paths)), "ord long, path string")
    p = ownership.projects(f)
    assert {r["rootPath"]: r["tsconfigPath"] for r in p.collect()} == roots
    got = ownership.owners(f, p)
    assert {r["path"]: r["rootPath"] for r in got.collect()}.items() >= owner.items()
    assert ownership.walked_twice(got).isEmpty()


def test_walk(spark, tmp_path):
    for p in ("src/a.ts", "node_modules/x/b.ts", ".git/c", "d.md"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    got = files.walk(spark, str(tmp_path))
    assert [r["path"] for r in got.orderBy("ord").collect()] == ["d.md", "src/a.ts"]
    assert got.where(files.is_source(F.col("path"))).count() == 1


def test_report_cells():
    cell = dict(tp=0, fp=0, fn=0, f1=0.0)
    assert report.precision_cell(cell) == report.recall_cell(cell) == report.f1_cell({**cell, "fp": 3}) == report.NO_ORACLE
    assert report.precision_cell({**cell, "fn": 2}) == report.NOT_EMITTED
    assert report.recall_cell({**cell, "fn": 2}) == "0.0%"
    assert report.granular("x", {"onlyFileGranularity": True}) == report.GRANULARITY
    assert report.label_cell(dict(total=3, correct=0, mislabelled=0)) == report.UNLABELLED
    assert [report.pct(x) for x in (0.0005, 0.00150000001, 1, None)] == ["0.1%", "0.2%", "100.0%", "—"]
    assert [report.listed(list(x)) for x in ("", "a", "ab", "abc")] == ["", "a", "a and b", "a, b and c"]
    assert report.num(1234567) == "1,234,567"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    row = {"tool": "t", "ord": 1, "fromId": "a", "toId": "b", "type": "CALLS"}
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps(row) + "\n")
        ingest.ingest(ingest.edge_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
        assert spark.read.schema(EDGES).parquet(str(tmp_path / "out")).count() == k + 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["tool", "kind", "tp", "fp", "fn", "precision", "recall", "f1"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["node_match", "edge_verdicts", "d2_edges", "method_overrides_agnostic", "climb_to_class", "file_ownership", "markdown_table_scan", "edge_false_negatives", "node_link_nodes", "tagged_record_nodes", "paged_table_nodes", "symbols_by_project"])
def test_queries_agree_with_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    con, d = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("part", "lineitem", "supplier"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    got = entry.queries()[name](spark, d)
    cols = sorted(got.columns)
    clean = lambda rows: sorted(repr([round(x, 9) if isinstance(x, float) else x for x in r]) for r in rows)
    want = con.sql(f"select {', '.join(f'"{c}"' for c in cols)} from ({entry.oracle_sql()[name]})").fetchall()
    assert clean(map(tuple, got.select(cols).collect())) == clean(want)
