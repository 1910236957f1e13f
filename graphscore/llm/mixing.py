"""Mixing sources to target weights: fixed-length blocks drawn by pseudorandom index permutations.

The documents of each source, in a pseudorandom order, are one stream of words, cut into blocks of ``block`` words.
A source with a target of T blocks fills slots 0 .. T - 1, and each of its T trials picks one of the output shards. So the counts
of a source over the shards are one multinomial draw (see ``draws``), and the counts of the sources in a shard are multinomial too, given
how many slots it has; only the totals aren't left to chance: each source meets its target to within a block. Slot j
takes block p(j mod B) of the source's B blocks, where p is a keyed pseudorandom permutation of 0 .. B - 1 (swap-or-not
rounds): each round over the source takes every block once, in another order of slots, and the last, partial round a
random part. Slots and documents meet by block index. ``sharded`` gives the text of every slot, ``mixed`` the mix by document.

DataFrame operations only. No window holds a source or all sources: sources are numbered inside ranges of their names, the level
to which targets rise is found by repeated sums, and running sums of documents are taken inside hash buckets of about
4,096 documents, inside groups of 4,096 buckets, and over groups.

Defined results: null and empty texts have size 0 and are never taken; a null source is a source, ordered last; null or
repeated doc_ids are rows of their own; an empty table gives an empty result; other columns are ignored here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import checked, let, staged, words

BLOCK = 256
CAP = 3
WEIGHTS = (1, 2, 3)
#: Documents in a bucket, slots in a chunk and in an output shard, chunks in a task.
BUCKET, CHUNK, SHARD, TASK = 4096, 4096, 4096, 16
ROUNDS = 16


def numbered(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` and their number from 1 by ``column`` (code points, nulls last). Each range of values is numbered by itself; only the ranges' counts reach the driver."""
    order = F.col(column).asc_nulls_last()
    dealt = staged(rows.repartitionByRange(order).withColumn("__range", F.spark_partition_id()))
    counts = sorted((r["__range"], r["count"]) for r in dealt.groupBy("__range").count().collect())
    before, pairs = 0, [F.lit(-1), F.lit(0).cast("long")]
    for k, n in counts:
        pairs += [F.lit(k), F.lit(before).cast("long")]
        before += n
    own = F.row_number().over(Window.partitionBy("__range").orderBy(order))
    return dealt.withColumn(name, own + F.element_at(F.create_map(*pairs), F.col("__range"))).drop("__range")


def targets(sizes: DataFrame) -> DataFrame:
    """Of (source, source_size, n): sid (from 1) and target. Targets share all sizes by weight, none above CAP times its source; the excess is shared again until none is.

    That is min(CAP * size, level * weight) for one level. It starts as if no source were capped; each round caps the sources that the level passes and
    raises it for the others, until no more are. The sums are of whole numbers, so reruns agree.
    """
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("sid") - 1) % len(WEIGHTS) + 1).cast("int"))
    ranked = staged(numbered(sizes, "source", "sid").withColumn("weight", weight).withColumn("cap", CAP * F.col("source_size")))
    total, free = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level, capped = (total or 0) / (free or 1), 0
    while True:
        over = F.col("cap") < F.lit(level) * F.col("weight")
        n, caps, free = ranked.agg(F.count_if(over), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == capped or not free:
            break
        level, capped = (total - caps) / free, n
    return ranked.select("source", "source_size", "n", "sid", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def permuted(index: Column, size: Column, key: Column) -> Column:
    """A keyed pseudorandom permutation of 0 .. size - 1 applied to ``index`` (swap-or-not; every round is its own inverse)."""

    def turn(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), size) - x, size)
        return let(F.struct(x.alias("a"), other.alias("b")), lambda p: F.when(F.xxhash64(key, r, F.greatest(p["a"], p["b"])).bitwiseAND(F.lit(1)) == 1, p["b"]).otherwise(p["a"]))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), index, turn)


def _before(sums: DataFrame) -> DataFrame:
    """(sid, bucket, base): of (sid, bucket, x) the sum of x over the source's earlier buckets, by groups of buckets and inside them."""
    grouped = sums.withColumn("group", F.floor(F.col("bucket") / BUCKET))
    upto = lambda key, by: F.coalesce(F.sum("x").over(Window.partitionBy(*key).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = grouped.groupBy("sid", "group").agg(F.sum("x").alias("x")).select("sid", "group", upto(["sid"], "group").alias("over"))
    return grouped.withColumn("own", upto(["sid", "group"], "bucket")).join(groups, ["sid", "group"]).select("sid", "bucket", (F.col("own") + F.col("over")).alias("base"))


def plan(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sized (rid, doc_id, key, source, sid, size, source_size, target), slots (sid, j, epoch, block, shard) and takes (rid, sid, j, epoch, at, lo, hi, shard): words lo .. hi - 1 of a document go to slot j of the source and so to the shard; at orders the takes of a slot.

    ``docs`` has doc_id, text and source. rid numbers the rows of the staged table; key is a hash of the text.
    """
    size = F.size(words(F.col("text"))).cast("long")
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = staged(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "source", size.alias("size"), F.xxhash64(text).alias("key")))
    sources = checked(staged(targets(staged(raw.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))))), 64)
    sized = raw.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select("rid", "doc_id", "key", F.col("r.source").alias("source"), "sid", "size", "source_size", "target", "n")

    order = F.xxhash64("doc_id", "key")
    placed = sized.where("size > 0").select("rid", "sid", "size", "doc_id", order.alias("o"), F.pmod(F.xxhash64("doc_id", "key", F.lit(1)), F.ceil(F.col("n") / BUCKET)).alias("bucket"))
    inside = Window.partitionBy("sid", "bucket").orderBy("o", "doc_id", "size", "rid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = _before(placed.groupBy("sid", "bucket").agg(F.sum("size").alias("x")))
    placed = placed.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["sid", "bucket"]).withColumn("start", F.col("start") + F.col("base"))
    b = F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block")
    parts = placed.select("rid", "sid", "size", "start", b).select("rid", "sid", "block", "start", F.greatest(F.lit(0), F.col("block") * block - F.col("start")).alias("lo"), F.least(F.col("size"), (F.col("block") + 1) * block - F.col("start")).alias("hi"))

    blocks = F.ceil(F.col("source_size") / block)
    wanted = sources.where("source_size > 0 and target > 0").select("sid", blocks.alias("b"), F.least(CAP * blocks, F.round(F.col("target") * blocks / F.col("source_size")).cast("long")).alias("t")).where("t > 0")
    shards = F.lit(max(1, -(-(sources.agg(F.sum("source_size")).first()[0] or 0) // (block * SHARD))))
    # a fixed number of tasks: a chunk is a small row that unfolds into many slots, which adaptive plans don't foresee
    tasks = max(1, -(-(wanted.agg(F.sum(F.ceil(F.col("t") / CHUNK))).first()[0] or 0) // TASK))
    chunks = wanted.select("sid", "b", "t", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("t") - 1) / CHUNK))).alias("c")).repartition(int(tasks), "sid", "c")
    slot = F.explode(F.sequence(F.col("c") * CHUNK, F.least(F.col("t"), (F.col("c") + 1) * CHUNK) - 1)).alias("j")
    slots = chunks.select("sid", "b", slot).select("sid", "j", F.floor(F.col("j") / F.col("b")).alias("epoch"), permuted(F.pmod("j", "b"), F.col("b"), F.col("sid")).alias("block"), F.pmod(F.xxhash64("sid", "j"), shards).alias("shard"))
    # nor may they broadcast the slots, whose number grows with the corpus
    return sized, slots, parts.hint("merge").join(slots.hint("merge"), ["sid", "block"]).select("rid", "sid", "j", "epoch", F.col("start").alias("at"), "lo", "hi", "shard")


def mixed(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix, with the columns of ``docs``: one row for each document and round that takes any of it, ``text`` holding the words taken.

    A document taken whole keeps its text unchanged; else its words are joined by one space. An ``n_chars`` column follows the text.
    """
    sized, _, takes = plan(docs, block)
    sized = sized.select("rid", "doc_id", "key", "size")
    by_row = takes.groupBy("rid", "epoch").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("parts"), F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    # rows that repeat both doc_id and text share a key: their parts are pooled and their text is joined once
    pooled = by_row.join(sized, "rid").groupBy("doc_id", "key").agg(F.collect_list(F.struct("epoch", "parts", (F.col("taken") == F.col("size")).alias("whole"))).alias("__takes")).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "__takes")
    joined = _with_texts(docs, pooled)
    cut = let(words(F.col("text")), lambda ws: F.array_join(F.flatten(F.transform(F.col("__t.parts"), lambda p: F.slice(ws, (p["lo"] + 1).cast("int"), (p["hi"] - p["lo"]).cast("int")))), " "))
    out = joined.withColumn("text", F.when(F.col("__t.whole"), F.col("text")).otherwise(cut)).drop("__t")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def _with_texts(docs: DataFrame, pooled: DataFrame) -> DataFrame:
    """Columns of ``docs``, and __t, an element of ``__takes`` of ``pooled`` (__id, __key, __takes), one row each. Rows that repeat both doc_id and text are read once."""
    own = docs.withColumn("__k", F.xxhash64(F.coalesce(F.col("text"), F.lit("")))).dropDuplicates(["doc_id", "__k"])
    return own.join(pooled, own["doc_id"].eqNullSafe(F.col("__id")) & (own["__k"] == F.col("__key"))).select(*(own[c] for c in docs.columns), F.explode("__takes").alias("__t"))


def sharded(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """What each output shard holds: (shard, sid, j, n_words, text), one row for each slot, its block's words joined by one space."""
    sized, _, takes = plan(docs, block)
    part = F.struct("sid", "j", "shard", "at", "lo", "hi")
    pooled = takes.join(sized.select("rid", "doc_id", "key"), "rid").groupBy("doc_id", "key").agg(F.collect_list(part).alias("__takes")).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "__takes")
    own = docs.select("doc_id", "text")
    cut = F.slice(words(F.col("text")), (F.col("__t.lo") + 1).cast("int"), (F.col("__t.hi") - F.col("__t.lo")).cast("int"))
    pieces = _with_texts(own, pooled).select("__t.sid", "__t.j", "__t.shard", F.struct("__t.at", "__t.lo", cut.alias("ws")).alias("p"))
    ws = F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["ws"]))
    return pieces.groupBy("shard", "sid", "j").agg(ws.alias("ws")).select("shard", "sid", "j", F.size("ws").cast("long").alias("n_words"), F.array_join("ws", " ").alias("text"))


def draws(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(shard, sid, n): how many slots of each source an output shard drew."""
    return plan(docs, block)[1].groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("n"))


def write_shards(docs: DataFrame, out: str, block: int = BLOCK) -> None:
    """Writes ``sharded`` as Parquet under ``out``, which must not exist, one folder for each shard."""
    sharded(docs, block).repartition("shard").write.partitionBy("shard").parquet(out)


def op4(spark, sf_dir: str) -> DataFrame:
    """Contract query over the whole of ``documents``."""
    sized, _, takes = plan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    taken = takes.groupBy("rid").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"), F.collect_set("shard").alias("shards"))
    return sized.join(taken, "rid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source", F.array_sort(F.coalesce("shards", F.array().cast("array<long>"))).alias("shards"))
