"""Every corpus operator against a plain restatement, on the smallest tables plus awkward rows."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphscore.llm import decontaminate, language, licenses, markup, mixing, neardup, packing, pii, quality, substring
from graphscore.llm.components import components
from graphscore.llm.hashing import sets
from graphscore.llm.superminhash import signatures

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 977}x{k % 13}" for k in range(30_000))
BASE = " ".join(f"term{k}" for k in range(100))
AWKWARD = [
    (90_001, None, "en", "src1", None), (90_002, "", "en", None, 0), (90_003, " \t\n\x0b ", None, "src1", 5), (90_004, LONG, "en", "src1", len(LONG)), (90_005, LONG + " tail", "en", "srcé", 1),
    (90_006, BASE, "en", "src2", 1), (90_007, BASE.upper(), "en", "src2", 1), (90_008, BASE.replace("term50", "other"), "en", "src2", 1), (90_009, "one two three", "en", "src2", 1), (90_010, "one  two\nthree", "en", "src2", 1),
    (90_011, "MIT License apache-LICENSE\nGeneral  public. license 日本 gnu GENERAL PUBLIC LICENSE, version 3 licensed under the GNU General Public License, version 3", "en", "src3", 1),
    (90_012, "mail a.b@c.de, a@b 1.2.3.4 300.1.1.1 4111 1111 1111 1111 +1 (555) 555-1234 +12 x@y.z.w 1.2.3.4.5 é@ü.de 0000000000000000", "en", "src3", 1), (None, BASE, "en", "src3", 1), (None, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    """200 documents, the awkward rows, and one row twice; with a column that clashes with names used inside."""
    own = spark.createDataFrame([*AWKWARD, AWKWARD[5]], SCHEMA)
    return spark.read.parquet(f"{DIR}/documents.parquet").unionByName(own).withColumn("rid", F.lit(1)).coalesce(4).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [tuple(r)[:4] for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def same(got, want):
    key = lambda xs: Counter(map(repr, xs))
    assert key(got) == key(want)


def test_decontamination(spark, docs, rows, empty):
    ws = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if w]
    grams = lambda t: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w := ws(t)) >= 5 else {tuple(w)} - {()}
    bench = [(r[0], r[1]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()] + [(-1, "ONE two, three"), (-2, None), (-3, BASE.replace("term50", "nothing")), (-3, BASE.replace("term50", "nothing")), (None, "term7 term8 term9 term10 term11 term12")]
    items = spark.createDataFrame(bench, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained(docs, items).collect()}
    want = {(d, i) for d, t, *_ in rows for i, b in bench if (g := grams(b)) and 100 * len(g & grams(t)) >= 80 * len(g)}
    assert found == want and {(90_009, -1), (90_006, -3)} <= found
    left = decontaminate.decontaminated(docs, items)
    assert left.columns == docs.columns
    texts = {t for d, t, *_ in rows if (d, -3) not in want and not any((d, i) in want for i, _ in bench)}
    assert {r["text"] for r in left.collect()} == texts
    assert decontaminate.contained(empty, items).isEmpty() and decontaminate.contained(docs, items.limit(0)).isEmpty()


def test_decontamination_by_items_shorter_than_a_shingle(spark):
    docs = spark.createDataFrame([(1, "a b c d e the Answer is x y z"), (2, "the answer was"), (3, "forty two"), (4, "z forty-two is it not so"), (5, "the answer is"), (6, None)], "doc_id long, text string")
    items = spark.createDataFrame([(10, "The answer is"), (11, "forty two"), (12, ""), (13, "is it")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained(docs, items).collect()}
    assert got == {(1, 10), (5, 10), (3, 11), (4, 11), (4, 13)}


def test_licenses(docs, rows, empty):
    def plain(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        at = sorted((k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))

    got = licenses.scanned(docs).collect()
    same([(r["doc_id"], *tuple(r)[1:6]) for r in got], [(d, *plain(t)) for d, t, *_ in rows])
    one = next(r for r in got if r["doc_id"] == 90_011)
    assert one["labels"] == "apache,gpl,gpl-3.0,mit" and one["score"] == 1
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert licenses.scanned(empty).isEmpty()


def test_licenses_of_a_bundle(spark):
    """A file that holds every template has more licence words than any one licence, and all labels."""
    bundle = " . ".join(text for _, text, _ in licenses.TEMPLATES)
    got = licenses.scanned(spark.createDataFrame([(1, bundle)], "doc_id long, text string")).first()
    assert set(got["labels"].split(",")) == {*licenses.BASE.values(), *(label for label, *_ in licenses.TEMPLATES)} and got["score"] == 1


def test_mixing(spark, docs, rows, empty):
    sized, _, takes = mixing.plan(docs, 64)
    taken = {r["rid"]: r["n"] for r in takes.groupBy("rid").agg(F.sum(F.col("hi") - F.col("lo")).alias("n")).collect()}
    got = sized.collect()
    same([(r["doc_id"], r["size"], r["source"]) for r in got], [(d, len(split(t)), s) for d, t, _, s in rows])
    size = Counter()
    for d, t, _, s in rows:
        size[s] += len(split(t))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(size.values()))
    while True:  # the excess is shared again until no target is above its bound
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        free -= over
    target |= share
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and taken.get(r["rid"], 0) <= 3 * r["size"]
    by_source = Counter()
    for r in got:
        by_source[r["source"]] += taken.get(r["rid"], 0)
    assert all(abs(by_source[s] - target[s]) <= 64 + 0.01 * target[s] for s in order)
    by_text = Counter((r["doc_id"], r["key"], taken.get(r["rid"], 0)) for r in got)
    other, _, again = mixing.plan(docs.repartition(3), 64)  # reruns agree by document
    again = {r["rid"]: r["n"] for r in again.groupBy("rid").agg(F.sum(F.col("hi") - F.col("lo")).alias("n")).collect()}
    assert Counter((r["doc_id"], r["key"], again.get(r["rid"], 0)) for r in other.collect()) == by_text
    out = mixing.mixed(docs, 64)
    assert out.columns == docs.columns and sum(len(split(r["text"])) for r in out.collect()) == sum(taken.values())
    assert mixing.mixed(empty).isEmpty()


def test_takes_are_dealt_to_shards_at_random(spark, monkeypatch, tmp_path):
    """What is taken goes to a shard; a source's slots over the shards are one multinomial draw of its target."""
    monkeypatch.setattr(mixing, "SHARD", 100)
    docs = spark.range(80).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(640)), lambda k: F.concat(F.lit("w"), F.col("id"), F.lit("x"), k)), " ").alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    sized, slots, takes = mixing.plan(docs, 64)
    drawn = {(r["shard"], r["sid"]): r["n"] for r in mixing.draws(docs, 64).collect()}
    assert drawn == Counter((r["shard"], r["sid"]) for r in slots.collect()) and {s for s, _ in drawn} == set(range(8))
    target = {r["sid"]: round(r["target"] / 64) for r in sized.collect()}
    for sid, t in target.items():
        counts = np.array([drawn.get((s, sid), 0) for s in range(8)])
        assert abs(counts.sum() - t) <= 1 and ((counts - t / 8) ** 2 / (t / 8)).sum() < 24.3  # chi-square, 7 degrees of freedom, p = 0.001
    words_of = Counter()
    for r in takes.collect():
        words_of[r["shard"], r["sid"]] += r["hi"] - r["lo"]
    assert all(abs(words_of[k] - 64 * n) <= 64 * 3 for k, n in drawn.items())

    mixing.write_shards(docs, f"{tmp_path}/out", 64)
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert Counter((r["shard"], r["sid"]) for r in out) == drawn and all(r["n_words"] == len(r["text"].split()) == 64 for r in out)
    stream = {}  # a block's words stand in one document, or in two that follow each other
    for r in out:
        ids = [w.split("x")[0] for w in r["text"].split()]
        assert sum(a != b for a, b in zip(ids, ids[1:], strict=False)) <= 1
        stream.setdefault((r["sid"], r["text"]), []).append(r["j"])
    whole = [r for r in sized.collect()]
    for sid in target:
        rounds = [len(j) for (s, _), j in stream.items() if s == sid]
        assert max(rounds) - min(rounds) <= 1 or len(rounds) < sum(r["size"] for r in whole if r["sid"] == sid) // 64


def test_targets_of_many_sources(spark):
    """Numbers and targets don't depend on how sources are dealt out; compared with exact water filling."""
    from fractions import Fraction

    rng = np.random.default_rng(3)
    names = [*(f"s{k:03d}" for k in range(199)), "Z", "é", "", None]
    sizes = {s: int(x) for s, x in zip(names, rng.integers(0, 5, len(names)) * 10 ** rng.integers(0, 6, len(names)), strict=True)}
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n long").repartition(9)
    got = {r["source"]: (r["sid"], r["target"]) for r in mixing.targets(df).collect()}
    order = sorted((s for s in names if s is not None), key=lambda s: s.encode()) + [None]
    assert [got[s][0] for s in order] == list(range(1, len(order) + 1))
    w, free, left, want = {s: k % 3 + 1 for k, s in enumerate(order)}, set(order), Fraction(sum(sizes.values())), {}
    while over := [s for s in free if left * w[s] / sum(w[x] for x in free) > 3 * sizes[s]]:
        total = sum(w[x] for x in free)
        over = [s for s in over if left * w[s] / total > 3 * sizes[s]]
        for s in over:
            want[s] = 3 * sizes[s]
        left, free = left - sum(want[s] for s in over), free - set(over)
    want |= {s: left * w[s] / sum(w[x] for x in free) for s in free}
    assert all(got[s][1] == pytest.approx(float(want[s]), rel=1e-12) for s in order)
    assert mixing.targets(df.limit(0)).isEmpty()


def test_permutation(spark):
    got = spark.range(1000).select(mixing.permuted(F.col("id"), F.lit(1000).cast("long"), F.lit(7)).alias("p"))
    assert sorted(r["p"] for r in got.collect()) == list(range(1000)) and got.first()["p"] != 0


def test_patterns_of_personal_data(rows):
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    count = lambda m: sum(c.isdigit() for c in m[0])
    good = lambda m: 14 <= count(m) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(c for c in reversed(m[0]) if c.isdigit())) % 10 == 0
    extra = ["a@b.c@d.e x..y@z-.q--.r", "1.2.3.4.5.6.7.8 01.002.3.255 1.2.3.256", "+1234567890123456 +1 23-4567-890", "@a.b a@", "1" * 3000 + ".1.1"]
    for t in [*(t or "" for _, t, *_ in rows), *extra]:
        want = [("email", *m.span()) for m in email.finditer(t)] + [("ip", *m.span()) for m in ip.finditer(t) if len(m[0]) < 100 and all(int(p) <= 255 for p in m[0].split("."))]
        want += [("card", *m.span()) for m in card.finditer(t) if good(m)] + [("phone", *m.span()) for m in phone.finditer(t) if 10 <= count(m) <= 15]
        assert sorted(pii.base_spans(t)) == sorted(want)


def test_personal_data_network(docs, rows, empty):
    net = pii.network()
    x, y = pii.snippets(150, 99)
    assert (net.decode(x) == y).mean() > 0.97
    loss, grads = net.gradients(x[:3], y[:3])
    for name, at in (("wo", (3, 2)), ("wh", (1, 4, 5)), ("emb", (40, 1)), ("tr", (0, 1))):  # gradients against differences
        kept, eps = net.p[name][at], 1e-2
        net.p[name][at] = kept + eps
        up = net.gradients(x[:3], y[:3])[0]
        net.p[name][at] = kept - eps
        down = net.gradients(x[:3], y[:3])[0]
        net.p[name][at] = kept
        assert grads[name][at] == pytest.approx((up - down) / (2 * eps), abs=5e-3)
    got = pii.detected(docs, net).collect()
    assert len(got) == len(rows)
    for r in got:
        spans = [s for s in r["spans"].split(",") if s]
        assert len(spans) == r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] + r["n_added"]
    assert pii.spans(["call (555) 123-4567 now"], net)[0][1] == [("phone", 5, 19)]
    nothing = next(r for r in got if r["doc_id"] == 90_001)
    assert nothing["base_sha256"] == hashlib.sha256(b"").hexdigest() and nothing["spans"] == ""
    assert pii.detected(empty, net).isEmpty()


def test_substring(docs, rows, empty):
    first = {}
    for d, t, *_ in rows:
        w = split(t)
        for k in range(len(w) - 12):
            if d is not None:
                key = tuple(w[k : k + 13])
                first[key] = min(first.get(key, d), d)
    want = []
    for d, t, *_ in rows:
        w = split(t)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if d is not None and first[tuple(w[k : k + 13])] < d:
                gone[k : k + 13] = [True] * 13
        want.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    same([tuple(r) for r in substring.without_repeats(docs).collect()], want)
    same([tuple(r) for r in substring.without_repeats(docs, digest=True).collect()], [(*x[:3], hashlib.sha256(x[3].encode()).hexdigest()) for x in want])
    assert substring.without_repeats(empty).isEmpty()


def test_cover_meets_every_shift():
    for i in range(substring.PERIOD):
        for j in range(substring.PERIOD):
            assert any((i + d) % substring.PERIOD in substring.COVER and (j + d) % substring.PERIOD in substring.COVER for d in range(substring.SIZE - substring.ANCHOR + 1))


def test_near_duplicates(spark, docs, rows, empty):
    grams = lambda w: frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset({tuple(w)} - {()})
    have, at = [grams(split(lowered(t))) for _, t, *_ in rows], defaultdict(list)
    for k, s in enumerate(have):
        for g in s if rows[k][0] is not None else ():
            at[g].append(k)
    shared = Counter((a, b) for ks in at.values() for i, a in enumerate(ks) for b in ks[i + 1 :])
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(have[a]) + len(have[b]) - n):
            x, y = find(rows[a][0]), find(rows[b][0])
            parent[max(x, y)] = min(x, y)
    want = [(d, len(s), None if d is None else find(d), d is None or find(d) == d) for (d, *_), s in zip(rows, have, strict=True)]
    same([tuple(r) for r in neardup.groups(docs).collect()], want)
    kept = {d for d, *_, k in want if k}
    assert {r["doc_id"] for r in neardup.deduplicated(docs, 4).collect()} == kept
    assert neardup.groups(empty).isEmpty()


def linked(xs, ys, band):
    kind = pa.list_(pa.struct([("rep", pa.int64()), ("component", pa.int64()), ("n", pa.int64()), ("before", pa.list_(pa.int64())), ("members", pa.binary())]))
    row = lambda rep, component, before, values: {"rep": rep, "component": component, "n": len(values), "before": before, "members": values.tobytes()}
    batch = pa.RecordBatch.from_arrays([pa.array([band], pa.int32()), pa.array([[row(*x) for x in xs]], kind), pa.array([[row(*y) for y in ys]], kind)], ["k", "x", "y"])
    return [tuple(r.values()) for out in neardup._linked(80)(iter([batch])) for r in out.to_pylist()]


def test_near_duplicates_share_an_earlier_band_or_are_compared():
    """Only an earlier band that two members really share excuses their pair, and only full sets refuse it."""
    whole = np.arange(100, dtype=np.uint64)
    assert linked([(1, 1, [7], whole)], [(2, 2, [8], whole[:90])], 1) == [(2, 1)]
    assert linked([(1, 1, [7], whole)], [(2, 2, [7], whole[:90])], 1) == []  # left to band 0
    assert linked([(1, 1, [], whole)], [(2, 1, [], whole[:90])], 0) == []  # one component already
    assert linked([(1, 1, [], whole)], [(2, 2, [], whole + np.uint64(20))], 0) == []


def test_blocks_of_near_duplicates_against_every_pair(monkeypatch):
    """Sets that share much or little with many or few others: links join what plain comparisons join, whichever way they are counted."""
    rng = np.random.default_rng(6)
    pool, base = np.sort(rng.integers(0, 2**63, 4000).astype(np.uint64)), []
    for k in range(150):
        size = int(rng.integers(1, 120))
        mine = pool[:60] if k % 3 else pool[rng.integers(0, 4000, 3)]
        base.append(np.unique(np.concatenate([mine, rng.choice(pool, size)])))
        if k % 5 == 0:
            base.append(np.unique(np.concatenate([base[-1][int(len(base[-1]) * 0.08) :], rng.choice(pool, 1)])))
    members = [(k, k, [], x) for k, x in enumerate(base)]
    whole = {(b, a) for a in range(len(base)) for b in range(a + 1, len(base)) if neardup.similar(base[a], base[b], 80)}

    def parts(links):
        root = list(range(len(base)))
        for a, b in links:
            root = [root[a] if r == root[b] else r for r in root]
        return {frozenset(k for k, r in enumerate(root) if r == x) for x in root}

    counts = neardup._Index(base).common(base[:40])
    assert all(counts[a, b] == len(np.intersect1d(base[a], base[b])) for a in range(40) for b in range(len(base)))
    for one, pairs, often in ((0, 500_000, 16), (10**9, 500_000, 16), (0, 1000, 16), (0, 500_000, 10**9), (0, 500_000, 1)):
        monkeypatch.setattr(neardup, "ONE_BY_ONE", one)
        monkeypatch.setattr(neardup, "PAIRS", pairs)
        monkeypatch.setattr(neardup, "OFTEN", often)
        got = linked(members, members, 0)
        assert set(got) <= whole and parts(got) == parts(whole) and len(whole) > 20


def test_superminhash_estimates_similarity():
    words = [f"v{k}" for k in range(3000)]
    texts = [" ".join(words[a : a + n]).encode() for a, n in ((0, 400), (100, 400), (0, 5), (1, 4), (0, 1), (50, 40))]
    values, start, _ = sets([*texts, b""], 1, False)
    sig = signatures(values, start, 64)
    assert np.isinf(sig[-1]).all() and np.isfinite(sig[:-1]).all()
    jaccard = lambda a, b: len(np.intersect1d(values[start[a] : start[a + 1]], values[start[b] : start[b + 1]])) / len(np.union1d(values[start[a] : start[a + 1]], values[start[b] : start[b + 1]]))
    for a, b in ((0, 1), (0, 5), (2, 3), (2, 4)):
        assert abs((sig[a] == sig[b]).mean() - jaccard(a, b)) < 0.2
    for row in sig[:-1]:  # in each round a register takes at most one offer of an element
        assert (row < 64).all()


def test_components(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(7, 3), (3, 9), (5, 5), (None, 4), (9, 7), (1000, 3)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, 7: 3, 3: 3, 9: 3, 1000: 3}
    assert components(spark.createDataFrame([], "u long, v long")).isEmpty()


def test_components_over_many_tasks(spark, monkeypatch):
    from graphscore.llm import components as module

    monkeypatch.setattr(module, "HELD", 40)
    links = spark.createDataFrame([(k * 7 % 201, (k + 1) * 7 % 201) for k in range(200)] + [(500 + k, 500) for k in range(1, 90)], "u long, v long").repartition(6)
    got = {r["id"]: r["component"] for r in module.components(links).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(500, 590), 500)}


def test_quality(spark, docs, rows, empty):
    def plain(t):
        w, t = split(t), t or ""
        n, seen, dup = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7)), set(), 0
        hit = {j for k in range(len(w) - 7) if n[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        for line in t.split("\n"):
            if split(line):
                dup += line in seen
                seen.add(line)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)

    got = quality.judged(docs).select("doc_id", *(f"quality.features.{k}" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "quality.base_failed", "quality.kept", "quality.posterior").collect()
    same([tuple(r)[:6] for r in got], [(d, *plain(t)) for d, t, *_ in rows])
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and 0 <= r["posterior"] <= 1
        assert r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5)
    assert quality.good(docs).columns == docs.columns and quality.good(docs).count() == sum(r["kept"] for r in got)
    assert quality.good(empty).isEmpty()


def test_em_finds_the_accuracies(spark):
    rng = np.random.default_rng(1)
    good = rng.random(4000) < 0.8
    votes = np.zeros((4000, len(quality.RULES)), int)
    for j in range(6):
        votes[:, j] = np.where(rng.random(4000) < np.where(good, 0.02, 0.5), -1, 0)
    model = quality.fit(spark.createDataFrame([(v.tolist(),) for v in votes], "votes array<int>"))
    assert abs(model.prior - 0.8) < 0.04 and all(abs(r[0] - 0.5) < 0.06 and r[2] < 0.05 for r in model.rates[:6])
    assert all(a > 0.8 for a in model.accuracy()[:6])


def test_quality_on_labels(spark):
    """Of documents labelled good, few may go; of the others, most should."""
    d = "/root/testdata/sf0.01"
    kept = quality.judged(spark.read.parquet(f"{d}/documents.parquet")).select("doc_id", F.col("quality.kept").alias("kept"))
    got = {(r["quality"], r["kept"]): r["count"] for r in kept.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("toxic = 0").groupBy("quality", "kept").count().collect()}
    assert got.get((1, True), 0) > 0.93 * (got.get((1, True), 0) + got.get((1, False), 0))
    assert got.get((0, False), 0) > 0.9 * (got.get((0, True), 0) + got.get((0, False), 0))


def test_packing(spark, docs, rows, empty):
    out = packing.packed(docs, length=256).collect()
    tok = packing.tokenizer()
    whole = defaultdict(dict)
    for r in out:
        ids, pos, cu = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["positions"], "<u2"), r["cu_seqlens"]
        assert len(ids) == len(pos) == 256 and cu[0] == 0 and cu[-1] == r["n_tokens"] <= 256 and (ids[cu[-1] :] == tok.pad).all()
        for d, p, a, b in zip(r["doc_ids"], r["pieces"], cu, cu[1:], strict=False):
            assert pos[a:b].tolist() == list(range(b - a))
            whole[d].setdefault(p, []).append(ids[a:b])
    for d, t, *_ in rows:
        if d is not None and d != 90_006:
            pieces = whole.get(d, {})
            assert tok.decode(np.concatenate([pieces[p][0] for p in sorted(pieces)]) if pieces else []) == (t or "")
    assert sum(r["n_tokens"] for r in out) / (256 * len(out)) > 0.9
    assert packing.packed(empty).isEmpty()
    back = packing.unpacked(packing.packed(docs, length=256)).where("doc_id = 90004").orderBy("piece").collect()
    assert tok.decode([i for r in back for i in r["ids"]]) == LONG


@pytest.mark.parametrize("text", [" a  b\n c\t\n", "", "  ", "one  two three\n\n\n four ", "don't we'll  x's 12 34", "　wide 　 x", " y", "z ", "<|endoftext|> a"])
def test_parts_are_encoded_as_the_text_is(text, monkeypatch):
    tok = packing.tokenizer()
    monkeypatch.setattr(packing, "PART", 5)
    long = " some more words".join([text] * 7)
    assert [x.tolist() for x in tok.encode([text, long, "x"])] == [tok.encoding.encode_ordinary(t) for t in (text, long, "x")]


@pytest.mark.parametrize("piece", ["a", " ", "\n", "ab ", "1", "é", "!?"])
def test_very_long_texts_are_encoded_in_linear_time(piece):
    import time

    tok, text, began = packing.tokenizer(), piece * (500_000 // len(piece)), time.time()
    assert tok.decode(tok.encode([text])[0]) == text and time.time() - began < 20


def test_best_fit():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 101, 500).tolist()
    bins = packing.best_fit(sizes, 100)
    assert sorted(k for b in bins for k in b) == list(range(500)) and all(sum(sizes[k] for k in b) <= 100 for b in bins)
    open_, plain = [], 0  # the rule itself: the fullest bin that still has room
    for s in sorted(sizes, reverse=True):
        fits = [k for k, room in enumerate(open_) if room >= s]
        if fits:
            k = min(fits, key=lambda k: open_[k])
            open_[k] -= s
        else:
            open_.append(100 - s)
    plain = len(open_)
    assert len(bins) == plain


def test_language(spark):
    rows = [("en", "the cat and the dog were in the house with that man " * 3), ("de", "der hund und die katze waren nicht in dem haus mit einem mann " * 3), ("fr", "le chien et la maison sont dans une grande ville avec des gens " * 3)]
    model = language.fit(rows)
    page = lambda lang, text: f'<html lang="{lang}"><body><script>the the</script><p>{text}</p></body></html>'
    pages = [(1, page("de", "und die katze"), "https://a.example.de/x"), (2, page("fr", rows[0][1]), "https://a.example.de/y"), (3, "", "https://a.example.de/z"), (4, None, None), (4, None, None), (5, "<p>la maison et la ville</p>", "http://www.b.fr/fr/1")] + [(10 + k, page("de", rows[1][1]), "https://a.example.de/q") for k in range(9)]
    df = spark.createDataFrame(pages, "page_id long, html string, url string")
    got = language.identified(language.evidence(df, model, "page_id", "html", "url", True), model).collect()
    by = {r["id"]: r["lang"] for r in got}
    assert len(got) == len(pages) and (by[1], by[2], by[3], by[5]) == ("de", "en", "de", "fr")  # 3 says nothing: its host does
    assert all(0 < r["probability"] <= 1 for r in got)
    assert language.identified(language.evidence(df.limit(0), model, "page_id", "html", "url", True), model).isEmpty()
    assert [language.address(u) for u in ("https://x.co.uk/de/a", "//u@Host.Example.FR:80", None, "plain.es/x")] == [("x.co.uk", "x.co.uk", "de"), ("host.example.fr", "example.fr", "fr"), (None, None, None), ("plain.es", "plain.es", "es")]


def test_fusion_by_brute_force(spark):
    """Every row's language and probability, from counts taken one by one; tables don't share priors, not even of null hosts."""
    rng = np.random.default_rng(4)
    model = language.TextModel(("aa", "bb", "cc"), np.zeros((1, 3)))
    hosts = [(None, None), ("x.a", "a"), ("y.a", "a"), ("z.b", "b"), ("z.b", None), (None, "b")]
    rows = []
    for k in range(300):
        like = (rng.integers(-4, 5, 3) * 0.5).tolist() if k % 7 else [0.0, 0.0, 0.0]
        host, domain = hosts[int(rng.integers(len(hosts)))]
        rows.append((k if k % 50 else None, host, domain, like, "page" if rng.random() < 0.3 else "document"))
    rows += [rows[5], rows[5], (999, "alone", "alone", [1.0, 1.0, 0.0], "page")]
    df = spark.createDataFrame(rows, "id long, host string, domain string, loglik array<double>, of string")
    best = lambda xs: max(range(3), key=lambda j: (xs[j], -j))
    by_host, by_domain, by_table = (defaultdict(Counter) for _ in range(3))
    for _, h, d, e, of in rows:
        by_host[of, d, h][best(e)] += 1
        by_domain[of, d][best(e)] += 1
        by_table[of][best(e)] += 1
    want = []
    for i, h, d, e, of in rows:
        top = [(by_table[of][j] + 1) / (sum(by_table[of].values()) + 3) for j in range(3)]
        less = lambda c, own=best(e): [c[j] - (j == own) for j in range(3)]
        up = [(c + language.DOMAIN_WEIGHT * t) / (sum(less(by_domain[of, d])) + language.DOMAIN_WEIGHT) for c, t in zip(less(by_domain[of, d]), top, strict=True)]
        prior = [(c + language.HOST_WEIGHT * u) / (sum(less(by_host[of, d, h])) + language.HOST_WEIGHT) for c, u in zip(less(by_host[of, d, h]), up, strict=True)]
        post = np.exp(np.array(e)) * prior
        want.append((i, of, model.languages[int(post.argmax())], round(float(post.max() / post.sum()), 5)))
    got = [(r["id"], r["of"], r["lang"], round(r["probability"], 5)) for r in language.identified(df, model).collect()]
    close = lambda a, b: a[:3] == b[:3] and abs(a[3] - b[3]) < 2e-5
    assert len(got) == len(want) and all(close(a, b) for a, b in zip(sorted(got, key=repr), sorted(want, key=repr), strict=True))


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "CLIP", 50)
    docs = spark.range(60).select(F.when(F.col("id") < 30, F.lit(7)).when(F.col("id") > 55, None).otherwise(F.col("id")).alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("word " * 100), F.col("id")).alias("text"), F.lit(1).alias("k"))
    got = language.sample(docs.unionByName(docs), 40)
    assert 0 < len(got) <= 40 and all(len(t) == 50 for _, t in got)
    assert language.sample(docs.limit(0)) == [] and language.fit([]).languages == language.DEFAULT


def test_a_rare_language_is_in_the_sample(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 57, "xx").when(F.col("id") % 4 == 0, "de").otherwise("en").alias("lang"), F.lit("some words").alias("text"))
    got = Counter(x for x, _ in language.sample(docs, 10))
    assert got == {"de": 3, "en": 3, "xx": 1}


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text", "lang").toPandas()
    model = language.fit(list(zip(docs.lang[:300], docs.text[:300], strict=True)))
    guess = model.scores([t.encode() for t in docs.text[300:]]).argmax(1)
    assert np.mean([model.languages[k] == x for k, x in zip(guess, docs.lang[300:], strict=True)]) > 0.98


def test_markup_held_out():
    held = [x for p, t in markup.training_pages(120, 5) if (x := markup.labelled(p, t))]
    right = [a == b for f, y in held for a, b in zip(markup.field().labels(f), y, strict=True)]
    assert len(held) == 120 and np.mean(right) > 0.98


def test_main_text(spark):
    f = markup.field()
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies</div><article><h1>Big &amp; small</h1><p>One  two\n three <b>bo</b>ld.<br><p>Next &#233; line.<script>var a='</p>'</script></article><div id=comments><p>Nice post, I liked it a lot.</p></div><footer>© all</footer>"
    assert markup.main_text(page, f) == "Big & small One two three bold. Next é line."
    assert [markup.main_text(x, f) for x in (None, "", "<p", "<!-- open", "<script>x", "</p></div>")] == ["", "", "", "", "", ""]
    rows = spark.createDataFrame([(1, "u", page), (1, "u", page), (None, None, None)], "page_id long, url string, html string")
    got = markup.extracted(rows, f).collect()
    assert Counter(r["n_chars"] for r in got) == {len("Big & small One two three bold. Next é line."): 2, 0: 1}
    assert markup.extracted(rows.limit(0), f).isEmpty()


@pytest.mark.parametrize("after", ["<body>", "</head><body>", "", "<body class=x><p>", "<img src=x>"])
def test_a_head_left_open_hides_nothing_of_the_body(after):
    body = "<article><h1>Big</h1><p>One two three four five six seven.</p></article></body></html>"
    head = "<html><head><meta charset=utf-8><title>T</title><style>p{}</style><script>x</script>\n"
    assert markup.main_text(head + after + body, markup.field()) == "Big One two three four five six seven."
    assert [t for t, _ in markup.blocks(head + "plain text<link href=x><p>more")] == ["plain text", "more"]


def test_viterbi_is_the_best_path():
    import itertools

    f = markup.field()
    rows = markup.labelled(*markup.training_pages(3, 8)[1])[0][:8]
    score = lambda ys: sum(f.emit[list(x)].sum(0)[y] for x, y in zip(rows, ys, strict=True)) + sum(f.move[a, b] for a, b in zip(ys, ys[1:], strict=False))
    assert tuple(f.labels(rows)) == max(itertools.product((0, 1), repeat=len(rows)), key=score)


def test_pages_of_the_tables():
    got = duckdb.sql(f"select html from '{DIR}/pages.parquet'").fetchall()
    for (page,) in got:
        inside = re.search(r"(?s)<article>(.*?)(?:</article>|\Z)", page)[1]
        parts = (re.sub(r"\s+", " ", markup.entities.unescape(re.sub(r"</?b>", "", x))).strip() for x in re.split(r"<(?!/?b>)[^>]*>", inside))
        assert markup.main_text(page, markup.field()) == " ".join(p for p in parts if p)


TAIL = "One two three four five six seven and so on for a while."


@pytest.mark.parametrize(("page", "texts"), [
    ("<p>We know 1 < 2 is true and the rest matters a lot.<p", ["We know 1 < 2 is true and the rest matters a lot."]), ("<p>a <b and c <i", ["a <b and c"]), ("<p>x</p", ["x"]), ("<p>x<!-", ["x"]), ("<p>x <3 y</p>", ["x <3 y"]), ("<p>x<", ["x"]),
    ("<ul><li>one<li>two</ul>three", ["one", "two", "three"]), ("<p>one<p>two<div>three</div>", ["one", "two", "three"]), ("<p title='a>b' class=c>x</p>y", ["x", "y"]), ("<p title=it's>x</p>y<i class='z'>w</i>", ["x", "yw"]), ("<a href='x>y <b>z</b>", ["y z"]),
    ("<a href=/>Home</a> x", ["Home x"]), ("<p>&#0000065;&#99999999999999999999;&#" + "1" * 6000 + ";</p>", ["A��"]), ("<!-->a<!--b-->c<?d?>e<!f>g", ["aceg"]), ("<body><p>a<script>'</p>'", ["a"]), ("</p></div>x", ["x"]), ("<P>A</P ><SCRIPT>b</Script >c", ["A", "c"]),
])
def test_blocks_of_broken_markup(page, texts):
    assert [t for t, _ in markup.blocks(page)] == texts


@pytest.mark.parametrize("piece", ["<a '", "<a ='>'", '<a ="', "<script>", "<!--", "<html ", "<b>x<br>", "<div>", "<p><button><b><h1></h1>", "</p><div>", "&#1", "<li class='", "<", "< a", "<ul><li>"])
def test_hostile_pages_take_linear_time(piece):
    import time

    page = "<html><body><p>" + piece * (1_000_000 // len(piece)) + "</p>"
    began = time.time()
    markup.main_text(page, markup.field())
    language.read(page)
    assert time.time() - began < 12  # a second or two; quadratic scans take minutes
