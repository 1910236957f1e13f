"""Greedy one-to-one matching of symbols inside buckets of equal path and canonical name.

Rows are shuffled by tool and bucket (tools don't compete, so each has its own copy of the candidates) and sorted so that a bucket's
candidates come before the rows that claim them; a task reads its rows as a stream and holds the candidates of one bucket only. The order of claims is that of ``ord``, so results
don't depend on how rows are dealt out.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import canonical_name, is_accessor, is_matchable, norm_path
from . import dedupe

_SWAPPED = ("Method", "Property")
_OUT = [("tool", pa.string()), ("tool_ord", pa.int64()), ("oracle_ord", pa.int64())]


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def sent(rows: Iterator[tuple], kinds: list[tuple[str, pa.DataType]], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    some: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in some], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    for row in rows:
        some.append(row)
        if len(some) >= size:
            yield batch()
            some = []
    yield batch()


def dealt(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Rows of equal keys in one partition, one after the other, in order. Keys are compared by a hash first: they share long beginnings. As many partitions as the session says, since what follows is Python, whose work sizes in bytes understate."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.withColumn("__h", F.xxhash64(*keys)).repartition(tasks, "__h").sortWithinPartitions("__h", *keys, *order)


class _Queue:
    """Candidates (ord, claim) in order; the first that is still free."""

    def __init__(self):
        self.rows, self.head = [], 0

    def first(self, claimed: set) -> tuple | None:
        while self.head < len(self.rows) and self.rows[self.head][1] in claimed:
            self.head += 1
        return self.rows[self.head] if self.head < len(self.rows) else None


class _Kind:
    """Candidates of one kind: all of them, those without a line, and by line."""

    def __init__(self):
        self.all, self.unplaced, self.at = _Queue(), _Queue(), defaultdict(_Queue)
        self.lines: list[int] | None = None

    def add(self, row: tuple, line: int | None) -> None:
        for queue in (self.all, self.unplaced if line is None else self.at[line]):
            queue.rows.append(row)

    def nearest(self, line: int | None, claimed: set) -> tuple | None:
        """(distance, ord, claim) of the free candidate nearest to ``line``; without a line, of the first."""
        if line is None:
            found = self.all.first(claimed)
            return found and (0, *found)
        if self.lines is None:
            self.lines = sorted(self.at)
        best, k = None, bisect_left(self.lines, line)
        while k < len(self.lines) and (found := self.at[self.lines[k]].first(claimed)) is None:
            del self.lines[k]
        if k < len(self.lines):
            best = (self.lines[k] - line, *found)
        while k and (found := self.at[self.lines[k - 1]].first(claimed)) is None:
            k -= 1
            del self.lines[k]
        if k and (best is None or (line - self.lines[k - 1], found[0]) < best[:2]):
            best = (line - self.lines[k - 1], *found)
        if best is None and (found := self.unplaced.first(claimed)):
            best = (float("inf"), *found)
        return best


class _Bucket:
    """A bucket's candidates: a claim looks up the nearest of each kind, so a bucket of very many rows costs no more for each claim than a small one."""

    def __init__(self):
        self.kinds: defaultdict[str, _Kind] = defaultdict(_Kind)
        self.claimed: set = set()
        self.accessors: Counter = Counter()

    def add(self, at: int, claim, kind, line, accessor) -> None:
        self.kinds[kind].add((at, claim), line)
        if accessor:
            self.accessors[claim] += 1

    def _best(self, kinds: Iterable, line) -> tuple | None:
        found = (self.kinds[k].nearest(line, self.claimed) for k in kinds)
        return min((x for x in found if x), key=lambda x: x[:2], default=None)

    def claim(self, kind, line, accessor) -> int | None:
        swap = kind in _SWAPPED and (accessor or self.accessors)
        same = [k for k in self.kinds if k == kind or (swap and k in _SWAPPED)]
        best = self._best(same, line) or self._best([k for k in self.kinds if k not in same], line)
        if best is None:
            return None
        self.claimed.add(best[2])
        self.accessors.pop(best[2], None)
        return best[1]


def _claims(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (npath, cname, claimant, tool, ord, claim, kind, line, accessor) to (tool, ord, candidate's ord or None)."""
    key, bucket = None, _Bucket()
    for npath, cname, claimant, tool, at, claim, kind, line, accessor in rows:
        if key != (tool, npath, cname):
            key, bucket = (tool, npath, cname), _Bucket()
        if claimant:
            yield tool, at, bucket.claim(kind, line, accessor)
        else:
            bucket.add(at, claim, kind, line, accessor)


def _keyed(df: DataFrame, claimant: bool, tool: str | None, claim: str) -> DataFrame:
    name = F.col("name")
    return df.where(is_matchable(name)).select(
        norm_path(F.coalesce("path", F.lit(""))).alias("npath"), canonical_name(name).alias("cname"), F.lit(claimant).alias("claimant"), *([F.col(tool).alias("tool")] if tool else []), "ord", F.col(claim).cast("string").alias("claim"), "kind", F.col("startLine").alias("line"), is_accessor(name).alias("accessor")
    )


def _matched(candidates: DataFrame, claimants: DataFrame) -> DataFrame:
    each = candidates.crossJoin(F.broadcast(claimants.select("tool").distinct()))  # a handful of tools
    both = dealt(claimants.unionByName(each), ["tool", "npath", "cname"], "claimant", "ord").select("npath", "cname", "claimant", "tool", "ord", "claim", "kind", "line", "accessor")
    return both.mapInArrow(lambda it: sent(_claims(streamed(it)), _OUT), "tool string, tool_ord long, oracle_ord long")


def to_oracle(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(tool, tool_ord, oracle_ord): each matchable node (first of its duplicates) and the symbol it claims, or null."""
    return _matched(_keyed(dedupe.oracle_symbols(symbols), False, None, "ord"), _keyed(dedupe.tool_nodes(nodes), True, "tool", "ord"))


def to_reference(nodes: DataFrame, reference: DataFrame) -> DataFrame:
    """(tool, tool_ord, oracle_ord) for every tool in ``nodes`` against ``reference`` (one tool's nodes). Nothing is deduplicated; rows that share an id are claimed together."""
    return _matched(_keyed(reference, False, None, "id"), _keyed(nodes, True, "tool", "ord"))
