"""Connected components of a table of links: union-find inside each partition, then large-star/small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import staged

MAX_ROUNDS = 60
#: Links that one task holds at a time.
HELD = 400_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links replaced by links to roots (smallest id), HELD at a time; at most as many rows as came in."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def rooted() -> pa.RecordBatch:
        pairs = [(k, r) for k in list(parent) if (r := find(k)) != k]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["u", "v"])

    held = 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        held += batch.num_rows
        if held >= HELD:
            yield rooted()
            held = 0
    yield rooted()


def _local(links: DataFrame, tasks: int) -> DataFrame:
    return links.select("u", "v").coalesce(tasks).mapInArrow(_forest, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (u long, v long); component is the smallest id reachable.

    Rows with a null or with u = v add nothing. Hubs are no problem: minima are pre-aggregated before each shuffle and
    the join back by node is one that Spark may split.
    """
    links = staged(links.where("u <> v"))
    n = links.count()
    edges = staged(_local(links, max(1, -(-n // HELD))))
    if n < HELD:  # one task saw all links, so its roots are the components
        return _named(edges)

    def state(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(edges)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = staged(small.distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return _named(edges)


def _named(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
