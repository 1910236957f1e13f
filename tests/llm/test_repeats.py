"""Repeated passages and near duplicates where batches are all short, blank or null, and where words are built to collide."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphscore.llm import neardup, substring
from graphscore.llm.hashing import U, Words, sets, windows

SHORT = {"one": ["hello world"], "short": ["a b", "a b", "a  B", "c", "one two three", "b a"], "null": [None, None], "blank": ["", " \n", "\t"], "mixed": [None, "", "x", " ".join(map(str, range(12)))]}


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


@pytest.mark.parametrize(("name", "parts"), [*((n, 1) for n in SHORT), ("short", 7), ("mixed", 7)])
def test_tables_without_a_long_text(spark, name, parts):
    texts = SHORT[name]
    docs = table(spark, texts).repartition(parts)
    got = substring.without_repeats(docs).collect()
    assert sorted(map(tuple, got)) == [(k, len((t or "").split()), 0, " ".join((t or "").split())) for k, t in enumerate(texts, 1)]
    for size in (4, 5):
        first, want = {}, []
        for k, t in enumerate(texts, 1):
            w = tuple((t or "").lower().split())
            n = max(1, len(w) - size + 1) if w else 0
            want.append((k, n, first.setdefault(w, k) if w else k))
        assert sorted(tuple(r)[:3] for r in neardup.groups(docs, size).collect()) == want


def thue_morse(n):
    s, t = "a", "b"
    for _ in range(n):
        s, t = s + t, t + s
    return s, t


def test_words_that_collide_under_polynomial_hashes(spark):
    s, t = thue_morse(10)
    rest = " ".join(f"w{k}" for k in range(12))
    docs = table(spark, [s, t, f"{rest} {s}", f"{rest} {t}", f"{rest} {s}"])
    assert [r["component_id"] for r in neardup.groups(docs).where("doc_id <= 2").orderBy("doc_id").collect()] == [1, 2]
    assert [r["n_removed"] for r in substring.without_repeats(docs).orderBy("doc_id").collect()] == [0, 0, 0, 0, 13]


def test_windows_that_collide_under_polynomial_hashes():
    """Windows whose words are a Thue-Morse sequence, or swap places, differ."""
    s, t = thue_morse(3)
    for h in Words([" ".join(s + t + "ccccc" + t + s).encode()]).hashes():
        x = windows(h, 16)
        assert len(set(x.tolist())) == len(x)
    assert len({sets([x.encode()], 4, False)[0].tobytes() for x in ("a b", "b a", "a a", "b b", "a", "b", "a b a b")}) == 7


def test_a_passage_common_to_many_pieces(spark):
    """What a task remembers from earlier pieces settles later ones, whatever the order of doc_ids."""
    passage = " ".join(f"p{k}" for k in range(20))
    texts = [f"{passage} own{k} " + " ".join(f"z{k}x{j}" for j in range(60)) for k in range(300)]
    rows = [(k * 7919 % 300 + 1, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    keep, substring.batches = substring.batches, None
    try:
        from graphscore.llm.hashing import batches

        seen = []
        emit = substring._emit_windows(4)
        substring.batches = lambda r, size, limit=2000: batches(r, size, limit)
        import pyarrow as pa

        anchors = substring._anchors(Words([t.encode() for _, t in rows]))
        shared = (anchors[0] & U((1 << 64) - (1 << 28))).view(np.int64)
        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.large_string()), "tag": pa.array([1] * 300, pa.int64()), "anchors": pa.array([shared[anchors[1] == k].tolist() for k in range(300)], pa.list_(pa.int64()))})
        for out in emit(iter([batch])):
            seen += out.to_pylist()
    finally:
        substring.batches = keep
    # windows that lie in the passage are sent open only where a smaller doc_id turns up
    open_ = sum(len(r["places"]) // 4 for r in seen if not r["settled"])
    assert open_ < 300 * 73 - 8 * 200
    got = {r["doc_id"]: r["n_removed"] for r in substring.without_repeats(docs).collect()}
    assert got == {d: 0 if d == 1 else 20 for d, _ in rows}


def test_repeated_rows_and_digest(spark):
    text = " ".join(f"q{k}" for k in range(30))
    docs = spark.createDataFrame([(5, text), (5, text), (5, "x " + text), (9, text)], "doc_id long, text string").withColumn("places", F.lit("clash")).withColumn("tag", F.lit(1))
    got = sorted(map(tuple, substring.without_repeats(docs, digest=True).collect()))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == sorted([(5, 30, 0, digest(text)), (5, 30, 0, digest(text)), (5, 31, 0, digest("x " + text)), (9, 30, 30, digest(""))])
