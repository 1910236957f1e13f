"""Awkward rows through every stage and operator, and brute-force versions of what SQL can't express."""

import math
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from graphscore.llm import language, licenses, markup, packing, quality
from graphscore.llm.queries import QUERIES
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"
PROSE = "The river runs under the old bridge while the market opens its doors to people who came from far away to sell bread and cheese . "
LONG = " ".join(f"word{k % 4999} of{k % 83}" for k in range(60_000))
ROWS = [
    (None, PROSE * 1, "en", "s", 1), (None, None, None, None, None), (1, "", "en", "s", 0), (2, " \n\t", "en", None, 3), (3, PROSE + "one more", "en", "s", 1), (3, PROSE + "one more", "en", "s", 1), (4, PROSE + "one more", "en", "s", 1),
    (5, LONG, "en", "s", None), (6, "tiny", "en", "s", 1), (7, PROSE.replace("river", "stream").replace("bread", "wool"), None, None, 1),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Awkward documents with columns whose names are used inside, and small tables beside them."""
    place = str(tmp_path_factory.mktemp("awkward"))
    base = spark.read.parquet(f"{DIR}/documents.parquet")
    docs = spark.createDataFrame(ROWS, base.schema).unionByName(base.where("doc_id >= 100").limit(40))
    for name in ("rid", "key", "quality", "votes", "places", "tag", "rep", "component", "band", "sid", "__judged", "host", "of", "h"):
        docs = docs.withColumn(name, F.lit(7))
    docs.coalesce(3).write.parquet(f"{place}/documents.parquet")
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet").withColumn("doc_id", F.lit(1)).withColumn("h", F.lit(1))
    bench.unionByName(spark.createDataFrame([(None, None, 1, 1), (7, "", 1, 1), (8, "one more", 1, 1), (8, "one more", 1, 1)], bench.schema)).write.parquet(f"{place}/benchmark.parquet")
    spark.read.parquet(f"{DIR}/pages.parquet").withColumn("text", F.lit("x")).withColumn("lang", F.lit("xx")).write.parquet(f"{place}/pages.parquet")
    return place


@pytest.fixture(scope="module")
def nothing(spark, folder, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("nothing"))
    for name in ("documents", "benchmark", "pages"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{place}/{name}.parquet")
    return place


def test_every_stage_takes_awkward_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = {r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        rows = out.collect()
        assert out.columns == docs.columns and rows, name
        if name != "source_mixing":
            assert {r["text"] for r in rows} <= held, name
        ids = Counter(r["doc_id"] for r in rows)
        if name == "quality_rules":  # blank, null and tiny texts go; a text's copies fare alike
            assert not {1, 2, 6} & set(ids) and ids[3] in (0, 2) and bool(ids[3]) == bool(ids[4])
        if name == "near_duplicates":  # rows without an id, or without words, are alone; of copies the smallest id stays, with its repeated rows
            assert ids[None] == 2 and ids[1] == ids[2] == 1 and ids[3] == 2 and ids[4] == 0
        if name == "decontamination":  # items of two words are looked for inside documents
            assert ids[3] == ids[4] == 0 and ids[1] == 1 and ids[None] == 2
        if name == "source_mixing":
            assert not {1, 2} & set(ids) and all(r["text"].strip() for r in rows)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {d for r in packed.collect() for d in r["doc_ids"]} >= {None, 2, 3, 4, 5, 6, 7}


def test_every_stage_takes_an_empty_table(spark, nothing):
    docs = spark.read.parquet(f"{nothing}/documents.parquet")
    assert all(stage(spark, docs, nothing).isEmpty() for _, stage in corpus_pipeline.STAGES)
    assert corpus_pipeline.run(spark, nothing).isEmpty()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_takes_awkward_and_empty_tables(spark, folder, nothing, name):
    got = QUERIES[name](spark, folder).collect()
    if name in ("op2_license_scan", "op4_source_mixing", "op5_pii_spans", "op6_substring_dedup", "op9_minhash_neardup", "op10_quality_rules"):
        assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    assert QUERIES[name](spark, nothing).isEmpty()


def test_packing_keeps_every_piece(spark, folder):
    """Pieces by document and number, against texts tokenised one by one: null and repeated ids included."""
    docs, tok = spark.read.parquet(f"{folder}/documents.parquet"), packing.tokenizer()
    want = Counter()
    for r in docs.collect():
        ids = tok.encoding.encode_ordinary(r["text"] or "")
        want.update((r["doc_id"], n, tuple(ids[a : a + 512])) for n, a in enumerate(range(0, len(ids), 512)))
    got = Counter()
    for r in packing.packed(docs, length=512).collect():
        ids, cu = np.frombuffer(r["ids"], f"<u{r['id_bytes']}").tolist(), r["cu_seqlens"]
        got.update((d, p, tuple(ids[a:b])) for d, p, a, b in zip(r["doc_ids"], r["pieces"], cu, cu[1:], strict=False))
    assert got == want


def test_licence_labels_by_full_scan(spark):
    """Labels and score of every document, with every template tried at every place."""
    texts = [r[0] for r in spark.read.parquet(f"{DIR}/documents.parquet").select("text").collect()] + [None, "MIT"]
    texts += [" x ".join(t for _, t, _ in licenses.TEMPLATES[k:]) for k in range(0, 20, 3)] + [f"pre {' '.join(t.split()[:-1])} gap {k}" for k, (_, t, _) in enumerate(licenses.TEMPLATES)]
    apart = str.maketrans({chr(c): " " for c in range(128) if not chr(c).isalnum()} | {chr(c): chr(c + 32) for c in range(65, 91)})
    files = [(t or "").translate(apart).split(" ") for t in texts]
    files = [[w for w in f if w] for f in files]
    n = len(files)
    idf = {w: math.log((n + 2) / (sum(w in f for f in files) + 1)) for w in licenses.VOCABULARY}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scanned(docs).collect()}
    found = 0
    for k, f in enumerate(files):
        labels, best = set(), 0.0
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            if any(f[i : i + len(p)] == p for i in range(len(f))):
                labels.add(label)
                best = max(best, 0.5)
        for label, text, keys in licenses.TEMPLATES:
            t = text.split()
            total = sum(idf[w] for w in t if w in idf)
            for at in range(-len(t), len(f)):
                share = sum(idf[w] for q, w in enumerate(t) if w in idf and 0 <= at + q < len(f) and f[at + q] == w)
                if share and share >= licenses.ENOUGH * total - 1e-12:
                    starts = [next(i for i in range(len(t)) if t[i : i + len(key.split())] == key.split()) for key in keys]
                    if all(at + q >= 0 and f[at + q : at + q + len(key.split())] == key.split() for q, key in zip(starts, keys, strict=True)):
                        labels.add(label)
                        best = max(best, min(1.0, share / total))
        found += len(labels)
        assert got[k][0] == ",".join(sorted(labels)) and got[k][1] == pytest.approx(best, abs=1e-8), k
    assert found > 40


def test_votes_by_brute_force_em(spark):
    """Posterior and verdict of every document, from EM restated with numpy row by row."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    got = quality.judged(docs).select("quality.votes", "quality.posterior", "quality.base_failed", "quality.kept").collect()
    v = np.array([r["votes"] for r in got])
    prior, start = 0.8, np.array([0.4, 0.1, 0.01, 0.3])
    rates = np.tile(start, (v.shape[1], 1))
    chance = lambda bad, good, s: np.where(s == -1, bad, np.where(s == 1, good, 1 - bad - good))

    def posterior():
        score = math.log(prior / (1 - prior)) + sum(np.log(chance(r[2], r[3], v[:, j]) / chance(r[0], r[1], v[:, j])) for j, r in enumerate(rates))
        return 1 / (1 + np.exp(-score))

    for _ in range(quality.ITERATIONS):
        g = posterior()
        pseudo = start * quality.PSEUDO
        for j in range(v.shape[1]):
            bad, good = v[:, j] == -1, v[:, j] == 1
            b, w = (1 - g).sum() + quality.PSEUDO, g.sum() + quality.PSEUDO
            rates[j] = [((1 - g)[bad].sum() + pseudo[0]) / b, ((1 - g)[good].sum() + pseudo[1]) / b, (g[bad].sum() + pseudo[2]) / w, (g[good].sum() + pseudo[3]) / w]
            rates[j, 2] = min(rates[j, 2], rates[j, 0])
        prior = min(0.95, max(0.05, g.sum() / len(g)))
    p = posterior()
    assert np.allclose(p, [r["posterior"] for r in got], atol=1e-9)
    assert [r["kept"] for r in got] == [bool(x >= 0.5 and not r["base_failed"]) for x, r in zip(p, got, strict=True)]


def test_pages_with_ties_and_repeats(spark):
    """Equal pages give equal rows; a page of equal blocks, and a very long one, keep all of them."""
    body = "<article>" + "<p>Same words in every block of this page.</p>" * 50 + "</article>"
    long = "<article>" + "".join(f"<p>Block number {k} tells of the river and the market.</p>" for k in range(20_000)) + "</article>"
    rows = spark.createDataFrame([(1, "u", body, 9), (1, "u", body, 9), (2, None, long, 9)], "page_id long, url string, html string, text int")
    got = sorted((r["page_id"], r["text"]) for r in markup.extracted(rows).collect())
    assert got[0] == got[1] == (1, " ".join(["Same words in every block of this page."] * 50))
    assert got[2][1].split(" Block")[0].startswith("Block number 0") and got[2][1].count("Block number") == 20_000


def test_languages_with_ties_and_without_documents(spark):
    pages = spark.createDataFrame([(1, "<p></p>", None, 1), (1, "<p></p>", None, 1), (None, None, "http://x.de", 1)], "page_id long, html string, url string, lang int")
    model = language.fit([])
    got = language.identified(language.evidence(pages, model, "page_id", "html", "url", True), model).collect()
    by = defaultdict(set)
    for r in got:
        by[r["id"]].add((r["lang"], r["probability"]))
    assert len(got) == 3 and len(by[1]) == 1
