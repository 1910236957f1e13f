"""One-to-one matching: literal cases, and random graphs against a plain restatement."""

import random
import re
import time

import pytest

from graphscore.operators import dedupe, match
from graphscore.schemas import NODES, ORACLE_SYMBOLS


def nodes(spark, rows, tool="t"):
    """rows: (name, line[, kind, path, id])."""
    full = [(tool, k, (r[4:] or [f"n{k}"])[0], r[0], (r[3:] or ["src/a.ts"])[0], (r[2:] or ["Function"])[0], r[1], None, None, None, None) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, NODES)


def symbols(spark, rows):
    """rows: (name, line[, kind, path, localId])."""
    return spark.createDataFrame([(k, (r[3:] or ["src/a.ts"])[0], (r[4:] or [f"{r[0]}#{k}"])[0], r[0], (r[2:] or ["Function"])[0], r[1], r[1], None) for k, r in enumerate(rows)], ORACLE_SYMBOLS)


def pairs(spark, oracle, tool):
    return {(r["tool_ord"], r["oracle_ord"]) for r in match.to_oracle(nodes(spark, tool), symbols(spark, oracle)).collect()}


# oracle, tool, expected (tool row, symbol row or None)
CASES = [
    ([("foo", 10)], [("foo", 10)], {(0, 0)}),
    ([("foo", 10)], [("foo", 15)], {(0, 0)}),
    ([("foo", 10)], [("foo", None)], {(0, 0)}),
    ([("bar", 10), ("bar", 20)], [("bar", 21)], {(0, 1)}),
    ([("bar", 10), ("bar", 40)], [("bar", 34)], {(0, 1)}),
    ([("foo", 10)], [("foo", 10), ("foo", 11)], {(0, 0), (1, None)}),
    ([("[computed]", 10)], [("[computed]", 10)], set()),
    ([("foo", 10)], [("foo", 10, "Function", "src/b.ts")], {(0, None)}),
    ([("foo", 10)], [("foo", 10, "Function", "./src/a.ts")], {(0, 0)}),
    ([("foo", 10)], [("foo", 10, "Function", "src\\a.ts")], {(0, 0)}),
    ([("get:min", 10, "Method"), ("set:min", 10, "Method")], [("min", 10, "Method")], {(0, 0)}),
    ([("get:x", 10, "Method")], [("getX", 10, "Method")], {(0, None)}),
    ([("foo", 5), ("get:foo", 20, "Method")], [("foo", 5), ("foo", 20, "Property")], {(0, 0), (1, 1)}),
    ([("get:min", 1, "Method")], [("min", 90, "Property")], {(0, 0)}),
    ([("[get]v", 1, "Method")], [("getter v", 1, "Method")], {(0, 0)}),
    ([("default", 3)], [("default", 3)], {(0, 0)}),
    ([("[Symbol.iterator]", 3)], [("[Symbol.iterator]", 3)], {(0, 0)}),
    ([("a", 1, "Class"), ("a", 50, "Interface")], [("a", 1, "Interface")], {(0, 1)}),
    ([("a", 1)], [("a", 1), ("a", 1)], {(0, 0)}),
    ([("a", 1, "Function", "src/a.ts", "a"), ("a", 1, "Function", "./src/a.ts", "a")], [("a", 1), ("a", 2)], {(0, 0), (1, None)}),
    ([("a", 1)], [("", 1)], set()),
    ([], [("a", 1)], {(0, None)}),
    ([("a", 1)], [], set()),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_cases(spark, case):
    oracle, tool, expected = CASES[case]
    assert pairs(spark, oracle, tool) == expected


def test_duplicates_are_counted(spark):
    got = dedupe.tool_nodes(nodes(spark, [("a", 1), ("a", 1), ("a", None), ("a", None), ("b", 1)])).collect()
    assert sorted(r["rows"] for r in got) == [1, 2, 2]


def test_reference_rows_of_one_id_are_claimed_together(spark):
    ref = nodes(spark, [("a", 1, "Function", "src/a.ts", "x"), ("a", 9, "Function", "src/a.ts", "x")], "r")
    got = match.to_reference(nodes(spark, [("a", 1), ("a", 9)]), ref).collect()
    assert {(r["tool_ord"], r["oracle_ord"]) for r in got} == {(0, 0), (1, None)}


def plain(oracle, tool):
    """The rule, one node at a time."""
    canon = lambda n: (m := re.match(r"^\[(?:get|set)\](.+)$", n) or re.match(r"^(?:get|set)(?:ter)?[: ](.+)$", n)) and m[1] or n
    seen, taken, out = set(), set(), set()
    for k, (name, line, kind, path) in enumerate(tool):
        key = (path, canon(name), kind, line)
        if key in seen:
            continue
        seen.add(key)
        free = [(j, o) for j, o in enumerate(oracle) if o[3] == path and canon(o[0]) == canon(name) and j not in taken]
        swap = canon(name) != name or any(canon(o[0]) != o[0] for _, o in free)
        same = [(j, o) for j, o in free if o[2] == kind or (swap and {o[2], kind} <= {"Method", "Property"})]
        pool = same or free
        best = min(pool, key=lambda x: (0 if line is None else abs(x[1][1] - line), x[0]))[0] if pool else None
        taken.add(best)
        out.add((k, best))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    row = lambda nulls: (rng.choice(["a", "b", "get:a", "[set]b", "set a"]), None if nulls and rng.random() < 0.2 else rng.randint(1, 30), rng.choice(["Method", "Property", "Class"]), rng.choice(["p.ts", "q.ts"]))
    oracle, tool = [row(False) for _ in range(60)], [row(True) for _ in range(90)]
    assert pairs(spark, oracle, tool) == plain(oracle, tool)


def test_claims_in_one_large_bucket():
    """Work grows with the rows, not with their square: the n-th claim of n doesn't look at n candidates."""
    n, rng = 20_000, random.Random(5)
    spot = [(rng.choice(["Method", "Class", "Enum"]), rng.choice([None, *range(1, 500)])) for _ in range(n)]
    rows = [("p.ts", "a", claimant, "t", k, str(k), *spot[k if not claimant else n - 1 - k], False) for claimant in (False, True) for k in range(n)]
    began = time.process_time()
    got = list(match._claims(iter(rows)))
    assert time.process_time() - began < 10
    assert len({at for _, _, at in got}) == n
    assert got[:1] == [("t", 0, min((k for k in range(n) if spot[k][0] == spot[-1][0] and (spot[-1][1] is None or spot[k][1] == spot[-1][1]))))]
