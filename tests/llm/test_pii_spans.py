"""What the network adds: precision and recall by kind on planted variants that the patterns don't know, and awkward texts."""

import random
import time
from collections import Counter

import duckdb
import pytest

from graphscore.llm import pii


def variant(rng, kind):
    """Independent of pii.snippets: own words, own shapes."""
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    w = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 7)))
    if kind == "phone":
        a, b, c = d(3), d(3), d(4)
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"({a}) {b} {c}", f"0{a}/{b}{c}", f"{a}.{b}.{c}"])
    if kind == "card":
        body = d(15)
        full = next(body + c for c in "0123456789" if pii.luhn(body + c))
        return rng.choice("./_").join(full[k : k + 4] for k in range(0, 16, 4))
    return f"{w()}@{w()}{rng.choice('üéö')}{w()}.de"


def test_added_spans_by_kind():
    """In documents of the tables, with and without a word that announces the datum."""
    net, rng = pii.network(), random.Random(77)
    texts = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' where length(text) between 200 and 4000 order by doc_id limit 900").fetchall()]
    clean = Counter(k for (_, every), t in zip(pii.spans(texts, net), texts, strict=True) for k, a, b in every if (k, a, b) not in pii.base_spans(t))
    planted, made = [], []
    for n, t in enumerate(texts):
        kind = ("phone", "card", "email")[n % 3]
        v, lead = variant(rng, kind), rng.choice(["call ", "tel. ", "mail ", "at ", "no. ", "", ""])
        at = rng.choice([k for k, c in enumerate(t) if c == " "])
        made.append(t[:at] + " " + lead + v + rng.choice([" ", ". ", ", "]) + t[at + 1 :])
        planted.append((kind, at + 1 + len(lead), at + 1 + len(lead) + len(v)))
    found, wrong, total = Counter(), Counter(), Counter(k for k, _, _ in planted)
    for want, (base, every) in zip(planted, pii.spans(made, net), strict=True):
        added = [s for s in every if s not in base]
        found[want[0]] += want in added
        wrong.update(k for k, a, b in added if not (a < want[2] and want[1] < b))
    rates = {k: (found[k] / n, found[k] / max(1, found[k] + wrong[k])) for k, n in total.items()}
    assert all(recall >= 0.9 and precision >= 0.9 for recall, precision in rates.values()), rates
    assert sum(clean.values()) <= 0.01 * len(texts), clean


@pytest.mark.parametrize("text", ["1" * 300_000, "@" * 100_000, "1.2.3.4 " * 30_000, "+1 (" * 50_000, "a@b.c " * 30_000, "0 " * 100_000])
def test_very_long_texts_and_ties(text):
    began = time.time()
    ((base, every),) = pii.spans([text], pii.network())
    assert time.time() - began < 60 and set(base) <= set(every) and every == sorted(every, key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2]))
    for kind in pii.KINDS:
        own = [s for s in every if s[0] == kind]
        assert all(a[2] <= b[1] for a, b in zip(own, own[1:], strict=False))


def test_equal_texts_and_empty_ones():
    net, t = pii.network(), "call (555) 123-4567 or x@y.de"
    assert pii.spans([t, "", t], net) == [pii.spans([t], net)[0], ([], []), pii.spans([t], net)[0]]
