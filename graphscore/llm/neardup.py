"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, union-find grouping.

1. One pass over the texts gives each document its number of distinct shingles, a 128-bit hash of the set (of two independent hashes of each shingle) and one hash
   per band of its signature. Documents with equal sets form a class, known by its smallest doc_id; from here on only
   classes count.
2. Classes that share a band are candidates. First each is linked to the smallest class of its band (a star, so a
   group of k costs k pairs) and the links are verified on full sets. Classes that these links leave in different
   components although they share a band are then compared with each other, block by block, on full sets: an index of one block's shingles counts
   what each member of the other shares with all of its members at once. Only links leave the task. So no pair of one band is skipped unless it is in
   one component already, and no pairs are ever listed.
3. Components of the verified links.

With ROWS = 3 and BANDS = 20 two sets of similarity 0.8 share no band with a probability of 6e-7.

Defined results: null, empty and blank texts have no shingles and stay alone; texts of fewer words than a shingle are
one shingle; a null doc_id is never linked (component_id null, kept); rows that repeat a doc_id are one document, so
their classes are joined; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import checked, lean, staged
from .components import components
from .hashing import U, batches, mixed, released, rowwise, sets
from .superminhash import signatures

BANDS, ROWS = 20, 3
#: Bytes of full sets and bands in a block of a band's members; two blocks meet in one task.
BLOCK_BYTES = 8_000_000
#: Bytes of texts whose shingles a task takes at a time.
TEXT_BYTES = 1_000_000
#: Pairs looked at together; how many of them are compared one by one rather than counted together.
PAIRS, ONE_BY_ONE = 500_000, 64
#: A value that one set in OFTEN holds is counted by matrices, COLUMNS values at a time.
OFTEN, COLUMNS = 16, 1024


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    raw = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.large_binary())], ["doc_id", "text"])
    return ((i, t or b"") for i, t in rowwise(raw))


def _signed(size: int, lower: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for rows in batches(_texts(batch), lambda r: len(r[1]), TEXT_BYTES):
                values, at, others = sets([t for _, t in rows], size, lower)
                n = np.diff(at)
                sums = np.concatenate([np.zeros(1, U), np.cumsum(mixed(values), dtype=U)])
                more = np.concatenate([np.zeros(1, U), np.cumsum(mixed(others), dtype=U)])
                sig = signatures(values, at, BANDS * ROWS)
                small = mixed(np.ascontiguousarray(np.where(np.isinf(sig), 0, sig)).view(U))
                bands = mixed((small.reshape(-1, BANDS, ROWS) * np.array([1, 3, 5], U)).sum(2, dtype=U) + np.arange(BANDS, dtype=U))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([i for i, _ in rows], pa.int64()), "n": pa.array(n.astype(np.int64)), "s1": pa.array((sums[at[1:]] - sums[at[:-1]]).view(np.int64)), "s2": pa.array((more[at[1:]] - more[at[:-1]]).view(np.int64)),
                        "bands": pa.array(list(bands.view(np.int64)), pa.list_(pa.int64())),
                    }
                )
        released()

    return run


def _sets(size: int, lower: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for rows in batches(_texts(batch), lambda r: len(r[1]), TEXT_BYTES):
                values, at, _ = sets([t for _, t in rows], size, lower)
                yield pa.RecordBatch.from_pydict({"rep": pa.array([i for i, _ in rows], pa.int64()), "members": pa.array([values[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())})
        released()

    return run


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted arrays of distinct hashes have a similarity of ``percent`` or more."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(x) < percent * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verified(percent: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ok = [(a, b) for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True) if similar(np.frombuffer(x, U), np.frombuffer(y, U), percent)]
            yield pa.RecordBatch.from_pydict({"u": pa.array([a for a, _ in ok], pa.int64()), "v": pa.array([b for _, b in ok], pa.int64())})

    return run


class _Index:
    """Which of some sets hold each value."""

    def __init__(self, sets_: list[np.ndarray]):
        self.n, values = len(sets_), np.concatenate([np.zeros(0, U), *sets_])
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], np.repeat(np.arange(self.n), [len(x) for x in sets_])[order]

    def _expanded(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Owners of the ranges at .. at + n - 1, one after the other."""
        return self.owner[np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def common(self, sets_: list[np.ndarray]) -> np.ndarray:
        """How many values each of ``sets_`` (by row) shares with each of the index's (by column)."""
        flat, row = np.concatenate([np.zeros(0, U), *sets_]), np.repeat(np.arange(len(sets_)), [len(x) for x in sets_])
        at = np.searchsorted(self.values, flat)
        n = np.searchsorted(self.values, flat, "right") - at
        out = np.zeros((len(sets_), self.n), np.float32)
        # values that many sets hold: products of matrices of 0 and 1, some values at a time
        often = np.flatnonzero(n * OFTEN > self.n)
        places, column = np.unique(at[often], return_inverse=True)
        held = np.searchsorted(self.values, self.values[places], "right") - places
        for a in range(0, len(places), COLUMNS):
            own = (column >= a) & (column < a + COLUMNS)
            k = held[a : a + COLUMNS]
            left, right = np.zeros((len(sets_), len(k)), np.float32), np.zeros((len(k), self.n), np.float32)
            left[row[often[own]], column[own] - a] = 1
            right[np.repeat(np.arange(len(k)), k), self._expanded(places[a : a + COLUMNS], k)] = 1
            out += left @ right
        # the others: one by one
        few = np.flatnonzero((n > 0) & (n * OFTEN <= self.n))
        upto = np.cumsum(n[few])
        for a in range(0, int(upto[-1]) if len(few) else 0, PAIRS):
            some = few[(upto > a) & (upto <= a + PAIRS)]
            cells = np.repeat(row[some], n[some]) * self.n + self._expanded(at[some], n[some])
            out += np.bincount(cells, minlength=out.size).reshape(out.shape)
        return out


def _linked(percent: int):
    """Of two blocks of one band's members (with full sets), the links between different components. Pairs that also share an earlier band are left to it; a pair whose link would join nothing new is skipped."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            u, v = [], []
            for band, xs, ys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bx, by = (np.array([r["before"] for r in z], np.int64).reshape(len(z), band) for z in (xs, ys))
                (rx, cx, nx), (ry, cy, ny) = ([np.array([r[k] for r in z]) for k in ("rep", "component", "n")] for z in (xs, ys))
                left, right = ([np.frombuffer(r["members"], U) for r in z] for z in (xs, ys))
                index = None
                parent: dict[int, int] = {}

                def find(x: int, parent=parent) -> int:
                    while parent.setdefault(x, x) != x:
                        parent[x] = x = parent[parent[x]]
                    return x

                def roots(xs: np.ndarray, find=find) -> np.ndarray:
                    some, at = np.unique(xs, return_inverse=True)
                    return np.array([find(x) for x in some.tolist()], np.int64)[at]

                for at in range(0, len(xs), step := max(1, PAIRS // max(1, len(ys)))):
                    part = slice(at, at + step)
                    ok = (roots(cx[part])[:, None] != roots(cy)[None, :]) & (100 * np.minimum(nx[part, None], ny[None, :]) >= percent * np.maximum(nx[part, None], ny[None, :]))
                    for k in range(band):
                        ok &= bx[part, k, None] != by[None, :, k]
                    i, j = np.nonzero(ok)
                    if len(i) <= ONE_BY_ONE:
                        hit = np.array([similar(left[a + at], right[b], percent) for a, b in zip(i.tolist(), j.tolist(), strict=True)], bool)
                    else:
                        index = index or _Index(right)
                        both = index.common(left[part])[i, j].astype(np.int64)
                        hit = 100 * both >= percent * (nx[part][i] + ny[j] - both)
                    for a, b in zip((i[hit] + at).tolist(), j[hit].tolist(), strict=True):
                        p, q = find(int(cx[a])), find(int(cy[b]))
                        if p != q:
                            parent[p] = q
                            u.append(max(rx[a], ry[b]))
                            v.append(min(rx[a], ry[b]))
            yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})
        released()

    return run


def groups(docs: DataFrame, size: int = 4, percent: int = 80, lower: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs`` (doc_id, text; other columns are ignored)."""
    texts = lean(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    signed = staged(texts.mapInArrow(_signed(size, lower), "doc_id long, n long, s1 long, s2 long, bands array<long>"))
    live = signed.where("n > 0 and doc_id is not null")
    classes = staged(live.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    members = staged(live.select("doc_id", "s1", "s2").join(classes.select("s1", "s2", "rep"), ["s1", "s2"]).select("doc_id", "rep"))

    banded = classes.select("rep", F.posexplode("bands").alias("k", "b")).select("rep", "k", F.xxhash64("b", "k").alias("band"))
    # the smallest of each band by a minimum and a join, which Spark may split where a band is very large
    least = banded.groupBy("band").agg(F.min("rep").alias("v"), F.count(F.lit(1)).alias("members")).where("members > 1").select("band", "v")
    star = staged(banded.join(least, "band").where("rep <> v").select(F.col("rep").alias("u"), "v", "band", "k"))
    pairs = checked(staged(star.select("u", "v").distinct()), 16)
    involved = checked(staged(pairs.select("u").union(pairs.select("v")).distinct().withColumnRenamed("u", "doc_id")), 16)
    full = staged(texts.join(involved, "doc_id", "left_semi").mapInArrow(_sets(size, lower), "rep long, members binary").join(_sizes(classes, "rep"), "rep").where(F.length("members") == 8 * F.col("n")).drop("n").dropDuplicates(["rep"]))

    def verified(some: DataFrame) -> DataFrame:
        x = some.join(full.select(F.col("rep").alias("u"), F.col("members").alias("a")), "u").join(full.select(F.col("rep").alias("v"), F.col("members").alias("b")), "v")
        return x.select("u", "v", "a", "b").mapInArrow(_verified(percent), "u long, v long")

    twice = members.groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("u")).where("u <> v")
    repeated = members.join(twice.select("doc_id", "v"), "doc_id").select(F.col("rep").alias("u"), "v").where("u <> v")
    links = staged(verified(pairs).union(repeated))
    found = components(links)
    # every pair of different components in one band is looked at here, so one pass is enough
    missed = staged(_across(star, classes, full, found, percent))
    if not missed.isEmpty():
        found = components(links.union(missed))
    named = members.join(found.withColumnRenamed("id", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("c"))
    out = signed.select("doc_id", "n").join(named, "doc_id", "left")
    alone = F.col("n") == 0
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("c")).alias("component_id")).withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def _sizes(classes: DataFrame, name: str) -> DataFrame:
    return classes.select(F.col("rep").alias(name), "n")


def _across(star: DataFrame, classes: DataFrame, full: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between classes that share a band but no component."""
    rows = star.select("band", "k", F.col("u").alias("rep")).union(star.select("band", "k", F.col("v").alias("rep")).distinct())
    rows = rows.join(classes.select("rep", "n", "bands"), "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    blocks = F.ceil(F.sum(8 * (F.col("n") + BANDS)) / BLOCK_BYTES).cast("int").alias("blocks")
    split = rows.groupBy("band", "k").agg(F.min("component").alias("x"), F.max("component").alias("y"), blocks, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("t")).where("x <> y")
    # a band whose members are all those of an earlier one has no pair of its own
    split = split.groupBy("n", "s", "t").agg(F.min(F.struct("k", "band", "blocks")).alias("first")).select("first.band", "first.blocks")
    rows = rows.join(split, "band").join(full, "rep")
    # a member meets all blocks of its band: it goes to each pair of blocks that its own takes part in
    own, every = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
    rows = rows.select("band", "k", F.struct("rep", "component", "n", F.slice("bands", F.lit(1), F.col("k")).alias("before"), "members").alias("m"), own.alias("own"), F.explode(every).alias("other"))
    sided = rows.select("band", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "m")
    both = sided.groupBy("band", "k", "i", "j").agg(F.collect_list(F.when(F.col("own") == F.col("i"), F.col("m"))).alias("x"), F.collect_list(F.when(F.col("own") == F.col("j"), F.col("m"))).alias("y"))
    return both.select("k", "x", "y").mapInArrow(_linked(percent), "u long, v long")


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the near duplicates: of each group the document with the smallest doc_id stays, all columns unchanged."""
    dropped = checked(staged(groups(docs, size, percent).where("not kept").select("doc_id").distinct()), 16)
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def op9(spark, sf_dir: str) -> DataFrame:
    """Contract query over the whole of ``documents``: four-word shingles, similarity 0.8."""
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g, len(w) >= 4 AS whole FROM d),
e AS (SELECT r, doc_id, whole, len(g) AS n, unnest(g) AS x FROM s WHERE doc_id IS NOT NULL),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, a.n + b.n - count(*) AS either, count(*) AS common FROM e a JOIN e b ON a.x = b.x AND a.whole = b.whole AND a.r <> b.r GROUP BY a.r, b.r, a.doc_id, b.doc_id, a.n, b.n),
reach AS (SELECT doc_id AS u, doc_id AS v FROM s WHERE doc_id IS NOT NULL UNION SELECT z.u, p.v FROM reach z JOIN p ON z.v = p.u WHERE 100 * common >= 80 * either),
c AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT doc_id, len(g) AS n_shingles, component_id, doc_id IS NULL OR doc_id = component_id AS kept FROM s LEFT JOIN c ON c.u = doc_id
"""
