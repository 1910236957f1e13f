"""The pipeline's stages, one after the other, against plain restatements."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from graphscore.llm import packing, quality
from graphscore.llm.base import staged

DIR = "/root/testdata/sf0.001"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def grams(words):
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def pieces(rows):
    return Counter((d, p, r["ids"][2 * a : 2 * b]) for r in rows for d, p, a, b in zip(r["doc_ids"], r["pieces"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False))


def test_pipeline(spark, tmp_path):
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet")
    item = bench.where("item_id is not null").first()["text"]
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    long = docs.where("length(text) > 900 and doc_id is not null").orderBy("doc_id").first()
    own = [(80_001, long["text"] + " tail", "en", "src1", 1), (80_002, long["text"].replace(" ", "\n", 3) + f" {item} end", "en", "src1", 1)]
    docs.unionByName(spark.createDataFrame(own, docs.schema)).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    folder = str(tmp_path)
    steps, now = {}, spark.read.parquet(f"{folder}/documents.parquet")
    before = {"": now.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = staged(stage(spark, now, folder))
        steps[name] = now.collect()
    ids = lambda rows: Counter(r["doc_id"] for r in rows)

    judged = quality.judged(spark.read.parquet(f"{folder}/documents.parquet")).select("doc_id", "quality.kept").collect()
    assert ids(steps["quality_rules"]) == Counter(r["doc_id"] for r in judged if r["kept"])
    assert all(len(split(r["text"])) >= 20 for r in steps["quality_rules"]) and len(steps["quality_rules"]) < len(before[""])

    rows = steps["quality_rules"]
    sets, root = [grams(split(r["text"].lower())) for r in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root[a], root[b]
                root = [y if z == x else z for z in root]
    least = {}
    for r, z in zip(rows, root, strict=True):
        least[z] = min(least.get(z, r["doc_id"]), r["doc_id"])
    assert ids(steps["near_duplicates"]) == Counter(r["doc_id"] for r, z in zip(rows, root, strict=True) if r["doc_id"] == least[z])

    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if w]
    items = [g for r in bench.collect() if (g := grams(words(r["text"])))]
    bad = lambda t: any(100 * len(g & own) >= 80 * len(g) for own in [grams(words(t))] for g in items)
    assert ids(steps["decontamination"]) == Counter(r["doc_id"] for r in steps["near_duplicates"] if not bad(r["text"]))

    whole, taken = {r["doc_id"]: r["text"] for r in steps["decontamination"]}, Counter()
    for r in steps["source_mixing"]:
        rest = iter(split(whole[r["doc_id"]]))
        assert all(w in rest for w in split(r["text"])) and r["n_chars"] == len(r["text"])
        taken[r["doc_id"]] += len(split(r["text"]))
    assert all(n <= 3 * len(split(whole[d])) for d, n in taken.items())

    out, tok, found = corpus_pipeline.run(spark, folder).collect(), packing.tokenizer(), defaultdict(list)
    assert pieces(out) == pieces(corpus_pipeline.STAGES[-1][1](spark, now, folder).collect())
    for (d, p, x), n in pieces(out).items():
        found[d] += [(p, x)] * n
    once = [r for r in steps["source_mixing"] if ids(steps["source_mixing"])[r["doc_id"]] == 1]
    for r in once:
        assert tok.decode(np.frombuffer(b"".join(x for _, x in sorted(found[r["doc_id"]])), "<u2")) == r["text"]
    assert once and set(found) == set(taken)
