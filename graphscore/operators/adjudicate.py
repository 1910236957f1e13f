"""Verdicts on tool edges against ground truth, tier by tier, each relationship claimed at most once.

First rule that applies: an unresolved self-loop is an abstention; an endpoint that is no node is wrong; a source that is
bound to no symbol is wrong (files and imports stand for themselves). Then, among the relationships of that source and type
in order: the first unclaimed one with that target, by identity or within BAND lines of it in its file; else the first
unclaimed one with the target's name. Else the edge is excused if the ground truth has such a row that can't be scored, and wrong
if not. Like matching, this runs as a sorted stream by source and type; targets are looked up by hash, so a source with very many
relationships costs no more for each edge than one with few. Tools don't compete, so a source of very many edges is dealt out by tool, each with its
own copy of the ground truth's rows.

Sources, targets, places and names are only ever tested for equality, so edges carry 64-bit hashes of them, taken once for each node: two sources
are confused if their hashes agree, and then matter only where the hashes of targets or names agree as well.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import is_scoreable
from ..functions.names import norm_path
from ..schemas import BAND, EDGE_TYPES, EXTENDED_TYPES, MEMBER_KINDS
from ..staging import staged
from . import dedupe

#: Edges of one source and type from which on they are dealt out by tool. Counted by HOT_PARTS parts of all sources: those that share a part with many edges are dealt too.
HOT, HOT_PARTS = 100_000, 200_003
ABSTAINED, WRONG, TARGET, NAME, EXCUSED = "abstained", "fp", "target", "name", "unscoreable"
_VERDICTS = (WRONG, TARGET, NAME, EXCUSED)
_OUT = [("scope", pa.string()), ("tool", pa.string()), ("ord", pa.int64()), ("type", pa.string()), ("resolved", pa.bool_()), ("verdict", pa.string()), ("oracle_ord", pa.int64())]


def _digest(*columns: Column) -> Column:
    """64 bits that stand for the columns' values; xxhash64 passes over nulls, so which are null counts too."""
    return F.xxhash64(*columns, *(c.isNull() for c in columns[1:]))


def _held(test: Column, digest: Column) -> Column:
    """``digest``, or 0 for none."""
    return F.when(test, digest).otherwise(F.lit(0).cast("long"))


def source_key(path: Column, local_id: Column) -> Column:
    return _digest(path, local_id)


def target_key(path: Column, local_id: Column) -> Column:
    """Null without an id."""
    return F.when(local_id.isNotNull(), _digest(path, local_id))


def named_key(path: Column, name: Column) -> Column:
    """What stands for a class without a symbol; differs from all source keys."""
    return _digest(path, name, F.lit("name"))


def _place(path: Column, line: Column) -> Column:
    """A line of a file; the lines around it have the numbers around it."""
    return _held(F.coalesce(path != "", F.lit(False)) & line.isNotNull(), F.shiftright(F.xxhash64(path), 1) + line)


def text_key(text: Column) -> Column:
    return F.when(text.isNotNull(), F.xxhash64(text))


def _named(text: Column) -> Column:
    """Names that are absent equal each other here."""
    return _held(text.isNotNull(), F.xxhash64(text))


def ends(nodes: DataFrame, matches: DataFrame, symbols: DataFrame) -> DataFrame:
    """Nodes (last of an id), the name of the id's first row (first), and the symbols they are bound to: bpath, bid, bname, bkind, bparent."""
    named = symbols.select(F.col("ord").alias("oracle_ord"), norm_path(F.coalesce("path", F.lit(""))).alias("bpath"), F.col("localId").alias("bid"), F.col("name").alias("bname"), F.col("kind").alias("bkind"), F.col("parentLocalId").alias("bparent"))
    # a node is bound by its id: of the rows of an id, the last that is matched
    held = matches.where("oracle_ord is not null").join(nodes.select("tool", F.col("ord").alias("tool_ord"), "id"), ["tool", "tool_ord"])
    held = held.groupBy("tool", "id").agg(F.max_by("oracle_ord", "tool_ord").alias("oracle_ord")).join(named, "oracle_ord").drop("oracle_ord")
    return dedupe.last_by_id(nodes.select("tool", "id", "ord", "name", "path", "kind", "startLine"), F.min_by("name", "ord").alias("first")).join(held, ["tool", "id"], "left")


def bound_edges(edges: DataFrame, full: DataFrame) -> DataFrame:
    """``edges`` with what scoring asks of both endpoints in ``full`` (see ends), null where that is no node:

    from_node (its ord), from_kind, from_symbol and from_self (the source as the symbol it is bound to, and as a file), from_file and from_path (its path as written, and normalised);
    to_there, to_kind, to_file, to_place, to_name, to_target (the symbol it is bound to), to_called (that symbol's name, or its own), to_first (the name of the first row of its id).
    """
    path, c = norm_path(F.col("path")), F.col
    file = text_key(F.nullif(c("path"), F.lit("")))
    at = lambda node: F.xxhash64("tool", node)
    start = full.select(at("id").alias("start"), c("ord").alias("from_node"), c("kind").alias("from_kind"), F.when(c("bid").isNotNull(), source_key(c("bpath"), c("bid"))).alias("from_symbol"), source_key(path, c("path")).alias("from_self"), file.alias("from_file"), _named(path).alias("from_path"))
    end = full.select(at("id").alias("end"), F.lit(True).alias("to_there"), c("kind").alias("to_kind"), file.alias("to_file"), _place(path, c("startLine")).alias("to_place"), _named(c("name")).alias("to_name"), target_key(c("bpath"), c("bid")).alias("to_target"), text_key(F.coalesce("bname", "name")).alias("to_called"), text_key(c("first")).alias("to_first"))
    key = lambda node: F.when(c(node).isNotNull(), at(node))
    asked = edges.select("tool", "ord", "type", "resolved", key("fromId").alias("start"), key("toId").alias("end"), (c("fromId") == c("toId")).alias("loop"))
    return asked.join(end, "end", "left").drop("end").join(start.where("start is not null"), "start", "left").drop("start")


def scope_of_edges(bound: DataFrame) -> DataFrame:
    """``bound`` with the table each edge is scored in (scope: main, member (IMPLEMENTS of members), extended; null for file imports and other types), its verdict if that takes no ground truth (rule), and else what it is compared with (key)."""
    c, t = F.col, F.col("type")
    member = (t == "IMPLEMENTS") & F.coalesce(c("from_kind").isin(*MEMBER_KINDS), F.lit(False))
    file_import = (t == "IMPORTS") & (F.coalesce(c("to_kind"), F.lit("")) == "File")
    scope = F.when(t.isin(*EXTENDED_TYPES), "extended").when(member, "member").when(t.isin(*EDGE_TYPES) & ~file_import, "main")
    own_file = (t == "IMPORTS") | F.coalesce(c("from_kind") == "File", F.lit(False))
    rule = F.when(c("loop") & c("resolved").eqNullSafe(False), ABSTAINED).when(c("from_node").isNull() | c("to_there").isNull(), WRONG).when(~own_file & c("from_symbol").isNull(), WRONG)
    out = bound.withColumns({"scope": scope, "rule": rule, "source": F.when(own_file, c("from_self")).otherwise(c("from_symbol"))})
    return out.withColumn("key", F.when(c("scope").isNotNull() & c("rule").isNull(), _key(c("source")))).drop("source", "from_symbol", "from_self", "from_kind")


def _key(source: Column) -> Column:
    return F.xxhash64(source, "scope", "type")


def scope_of_oracle(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """The same for ground truth, by the kind of the symbol (last of its raw path and id) an edge comes from."""
    kinds = symbols.groupBy(F.col("path").alias("fromPath"), F.col("localId").alias("fromLocalId")).agg(F.max_by("kind", "ord").alias("from_kind"))
    t, scope = F.col("type"), F.lit("main")
    implements = F.coalesce(t == "IMPLEMENTS", F.lit(False))
    # only this type asks for the source's kind
    asked = edges.where(implements).join(kinds, ["fromPath", "fromLocalId"], "left")
    member = F.coalesce(F.col("from_kind").isin(*MEMBER_KINDS), F.lit(False))
    others = edges.where(~implements).withColumn("scope", F.when(t.isin(*EXTENDED_TYPES), "extended").when(t.isin(*EDGE_TYPES), scope))
    return asked.withColumn("scope", F.when(member, "member").otherwise(scope)).drop("from_kind").unionByName(others)


def relations(oracle: DataFrame) -> DataFrame:
    """``oracle`` (with a scope) as it is compared: ord, scope, type, scoreable, sites, resolutionTier; source (see source_key) and file (normalised);
    relation (equal for rows that collapse into one, see dedupe.oracle_edges; the target_key where known), placed (known to be in some file), place, name; of imports the files as written (from_id, to_file)."""
    c, path = F.col, norm_path(F.col("targetPath"))
    known = F.coalesce(c("targetLocalId"), F.lit("")) != ""
    imports = c("type") == "IMPORTS"
    return oracle.select(
        "ord", "scope", "type", is_scoreable(c("scoreable")).alias("scoreable"), F.coalesce("siteCount", F.lit(1)).alias("sites"), "resolutionTier",
        source_key(norm_path(c("fromPath")), c("fromLocalId")).alias("source"), _named(norm_path(c("fromPath"))).alias("file"),
        F.when(known, target_key(F.coalesce(path, F.lit("")), c("targetLocalId"))).otherwise(_digest(c("targetName"), F.lit(None).cast("string"))).alias("relation"), known.alias("known"), F.coalesce(path != "", F.lit(False)).alias("placed"),
        _place(path, c("targetStartLine")).alias("place"), _named(c("targetName")).alias("name"), F.when(imports, text_key(c("fromLocalId"))).alias("from_id"), F.when(imports, text_key(F.nullif(c("targetPath"), F.lit("")))).alias("to_file"),
    )


class _Source:
    """Relationships of one source and type, and what one tool at a time has claimed of them."""

    def __init__(self):
        self.by_id: dict[int, list[int]] = {}
        self.by_line: dict[int, list[int]] = {}
        self.by_name: dict[int, list[int]] = {}
        self.seen: set[int] = set()
        self.excused: set[int] = set()
        self.claimed: set[int] = set()
        self.heads: dict[int, int] = {}

    def add(self, at: int, relation: int, target: int, place: int, name: int) -> bool:
        """Whether this is a new relationship; the first of equal ones stands for all."""
        if relation in self.seen:
            return False
        self.seen.add(relation)
        if target:
            self.by_id.setdefault(target, []).append(at)
        if place:
            self.by_line.setdefault(place, []).append(at)
        self.by_name.setdefault(name, []).append(at)
        return True

    def _first(self, rows: list[int]) -> int | None:
        at, claimed = rows[0], self.claimed
        if at not in claimed:
            return at
        k, n = self.heads.get(id(rows), 1), len(rows)
        while k < n and rows[k] in claimed:
            k += 1
        self.heads[id(rows)] = k
        return rows[k] if k < n else None

    def judge(self, target: int, place: int, name: int) -> tuple[int, int | None]:
        """The verdict's number in _VERDICTS, and the row that is claimed."""
        best = None
        if self.seen:
            if target and (rows := self.by_id.get(target)):
                best = self._first(rows)
            if place and self.by_line:
                for line in range(place - BAND, place + BAND + 1):
                    if (rows := self.by_line.get(line)) and (at := self._first(rows)) is not None and (best is None or at < best):
                        best = at
            if best is not None:
                self.claimed.add(best)
                return 1, best
            if (rows := self.by_name.get(name)) and (best := self._first(rows)) is not None:
                self.claimed.add(best)
                return 2, best
        return (3 if name in self.excused else 0), None


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a key one after the other: relationships (part 0), rows that can't be scored (1), edges (2) by tool. Edges with their verdicts, and how many relationships there were, by scope and type."""
    key, tool, source = None, None, _Source()
    found: Counter = Counter()
    for batch in batches:
        part = batch.column("part").to_numpy()
        tools = batch.column("tool").dictionary_encode()
        names = [*tools.dictionary.to_pylist(), None]
        codes = tools.indices.fill_null(len(names) - 1).to_numpy().tolist()
        places = (batch.column("type"), batch.column("scope"))
        verdicts, claims = [], []
        rows = zip(*(batch.column(c).to_numpy().tolist() for c in ("key", "part", "ord", "target", "place", "name", "relation")), codes, strict=True)
        for k, (new, what, at, target, place, name, relation, code) in enumerate(rows):
            if new != key:
                key, tool, source = new, None, _Source()
            if what == 2:
                if tool != names[code]:
                    tool, source.claimed, source.heads = names[code], set(), {}
                verdict, claim = source.judge(target, place, name)
                verdicts.append(verdict)
                claims.append(claim)
            elif what == 1:
                source.excused.add(name)
            elif source.add(at, relation, target, place, name) and code == len(names) - 1:
                found[places[1][k].as_py(), places[0][k].as_py()] += 1
        at = pa.array(np.flatnonzero(part == 2))
        take = lambda c: batch.column(c).take(at)  # noqa: E731, B023
        said = pa.DictionaryArray.from_arrays(pa.array(verdicts, pa.int8()), pa.array(_VERDICTS)).cast(pa.string())
        yield pa.RecordBatch.from_arrays([take("scope"), take("tool"), take("ord"), take("type"), take("resolved"), said, pa.array(claims, pa.int64())], names=[n for n, _ in _OUT])
    counted = [(scope, None, n, type_, None, None, None) for (scope, type_), n in found.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in counted], t) for k, (_, t) in enumerate(_OUT)], names=[n for n, _ in _OUT])


def judged(scoped: DataFrame, related: DataFrame) -> DataFrame:
    """(scope, tool, ord, type, resolved, verdict, oracle_ord) for every edge of ``scoped`` that has a scope, against ``related`` (see relations). Rows without a tool tell in ord how many relationships of their scope and type a task has met."""
    c, zero = F.col, F.lit(0).cast("long")
    ruled = scoped.where("scope is not null and rule is not null").select("scope", "tool", "ord", "type", "resolved", c("rule").alias("verdict"), F.lit(None).cast("long").alias("oracle_ord"))
    asked = scoped.where("key is not null").select("key", F.lit(2).alias("part"), "tool", "ord", F.coalesce("to_target", zero).alias("target"), c("to_place").alias("place"), c("to_name").alias("name"), zero.alias("relation"), "scope", "type", "resolved")
    truth = related.where("scope is not null").select(_key(c("source")).alias("key"), F.when(c("scoreable"), 0).otherwise(1).alias("part"), F.lit(None).cast("string").alias("tool"), "ord", F.when(c("known") & c("placed"), c("relation")).otherwise(zero).alias("target"), "place", "name", "relation", "scope", "type", F.lit(None).cast("boolean").alias("resolved"))
    share = F.pmod("key", F.lit(HOT_PARTS)).alias("share")
    hot = staged(asked.groupBy(share).agg(F.count(F.lit(1)).alias("n")).where(c("n") > HOT).select("share", F.lit(True).alias("hot")))
    if not hot.isEmpty():
        # the tools: a handful, whatever the graphs' sizes; hot parts: one for each HOT edges at most
        asked, truth = (x.withColumn("share", share).join(F.broadcast(hot), "share", "left").drop("share") for x in (asked, truth))
        asked = asked.withColumn("key", F.when(c("hot"), F.xxhash64("key", "tool")).otherwise(c("key"))).drop("hot")
        tools = scoped.select("tool").distinct().agg(F.sort_array(F.collect_set("tool")).alias("tools"))
        # one of the copies is without a tool, and counted
        each = truth.crossJoin(F.broadcast(tools)).withColumn("of", F.explode(F.when(c("hot"), c("tools")).otherwise(F.array(F.lit(None).cast("string")))))
        truth = each.withColumn("key", F.when(c("hot"), F.xxhash64("key", "of")).otherwise(c("key"))).withColumn("tool", F.when(c("of") != F.element_at("tools", 1), c("of"))).drop("hot", "tools", "of")
    rows = asked.unionByName(truth)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "key").sortWithinPartitions("key", "part", "tool", "ord")
    return rows.mapInArrow(_judged, "scope string, tool string, ord long, type string, resolved boolean, verdict string, oracle_ord long").unionByName(ruled)


def verdicts(scoped: DataFrame, oracle: DataFrame) -> DataFrame:
    """(scope, tool, ord, type, verdict, oracle_ord) for every edge of ``scoped`` that has a scope; ``oracle`` has one too."""
    return edges_of(judged(scoped, relations(oracle)))


def edges_of(judged: DataFrame) -> DataFrame:
    return judged.where("tool is not null").drop("resolved")


def collapsed(oracle: DataFrame) -> DataFrame:
    """Scoreable relationships of each scope; ``oracle`` has a scope."""
    return dedupe.oracle_edges(oracle.where("scope is not null"))
