"""Node-link documents: one JSON object with arrays of nodes and links.

A document may be of any size: it is read in pieces that end before a "{", by as many tasks as its file has splits. A first reading tells how many quotes and
brackets each split holds, so that the second knows of each split whether it begins in a string, how deep, and in which array. Elements go to Spark's JSON
reader one by one. What is left without them is a small document that is read whole, so that a truncated or malformed one fails the job. Elements that begin in one split and end in another,
and what stands outside of elements, go through the driver. A folder is read in the order of its files' names, as one document in parts that end at line ends, or as several documents. The text is UTF-8.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import link_edge_type
from ..functions.names import bare_name, base_name, line_marker
from ..staging import staged

#: The arrays that are read, and the fields of their elements.
ARRAYS = {
    "nodes": "id STRING, label STRING, metadata STRUCT<kind: STRING, language: STRING>, source_file STRING, source_location STRING",
    "links": "source STRING, target STRING, relation STRING, confidence STRING, confidence_score DOUBLE",
}
_QUOTE, _OPEN, _CLOSE, _ESCAPE = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
for _chars, _kind in ((b'"', _QUOTE), (b"{[", _OPEN), (b"}]", _CLOSE), (b"\\", _ESCAPE)):
    _KIND[list(_chars)] = _kind
_KEY = re.compile(rb'(?<!\\)"([^"\\]*)"\s*:\s*\Z')
_COMMA = re.compile(rb"\s*,\s*")
#: Parts of an element's row: all of it; its beginning, a middle, its end, where it goes on in other splits. Or text outside of elements.
_WHOLE, _HEAD, _MIDDLE, _TAIL, _OUTSIDE = range(5)


def _marks(text: bytes, inside: int) -> tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]:
    """Brackets outside of strings (places, +1 or -1) and whether the end is in a string, if the beginning is (``inside``); then the brackets if it is the other way round."""
    a = np.frombuffer(text, np.uint8)
    kinds = _KIND[a]
    at = np.flatnonzero(kinds)
    k = kinds[at]
    slash = at[k == _ESCAPE]
    if len(slash):
        # a quote is escaped by an odd number of backslashes
        runs = np.flatnonzero(np.diff(slash, prepend=-2) != 1)
        last = np.append(runs[1:], len(slash)) - 1
        odd = slash[last[(last - runs) % 2 == 0]] + 1
        keep = (k != _ESCAPE) & ~((k == _QUOTE) & np.isin(at, odd, assume_unique=True))
        at, k = at[keep], k[keep]
    quotes = k == _QUOTE
    within = (np.cumsum(quotes) + inside) & 1
    step = np.where(k == _OPEN, 1, -1)
    out, other = ~quotes & (within == 0), ~quotes & (within == 1)
    return at[out], step[out], int(within[-1]) if len(at) else inside, at[other], step[other]


def _key(text: bytes, at: int) -> str | None:
    """Of the array that opens at ``at``, the name if it is one that is read."""
    found = text[at : at + 1] == b"[" and _KEY.search(text[max(0, at - 1000) : at])
    return next((k for k in ARRAYS if found and found[1] == k.encode()), None)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes]]:
    """Rows (value, f, b) as ((f, b), text): the text of one split, piece after piece, with the braces between pieces."""
    for batch in batches:
        values, f, b = batch.columns
        same = pc.and_(pc.equal(f[1:], f[:-1]), pc.equal(b[1:], b[:-1])) if len(batch) > 1 else pa.array([], pa.bool_())
        cuts = [0, *(np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1).tolist(), len(batch)]
        for i, j in zip(cuts, cuts[1:]):
            if i < j:
                yield (f[i].as_py(), b[i].as_py()), b"{".join(values[i:j].to_pylist())


def _joined(chunks: Iterator[tuple[tuple[str, int], bytes]]) -> Iterator[tuple[tuple[str, int], bool, bytes]]:
    """The same, with the brace before each text but a file's first, and whether a split begins."""
    seen = None
    for split, text in chunks:
        new, seen = split != seen, split
        yield split, new, text if new and split[1] == 0 else b"{" + text


@dataclass
class _Shape:
    """What a split does to the state, for a beginning outside of strings and for one inside: change of depth, and at each depth from the first the array that opened last."""

    odd: int = 0
    depth: list[int] = field(default_factory=lambda: [0, 0])
    opened: list[dict[int, str | None]] = field(default_factory=lambda: [{}, {}])

    def add(self, text: bytes) -> None:
        at, step, odd, other, other_step = _marks(text, self.odd)
        for h, (at, step) in enumerate(((at, step), (other, other_step))):
            after = np.cumsum(step) + self.depth[h]
            opens = np.flatnonzero(step == 1)[::-1]
            levels, which = np.unique(after[opens], return_index=True)
            for level, x in zip((levels - 1).tolist(), opens[which].tolist()):
                self.opened[h][level] = _key(text, int(at[x]))
            if len(after):
                self.depth[h] = int(after[-1])
        self.odd = odd


_SHAPE = "f string, b long, odd int, shape string"


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[str, int], _Shape] = {}
    for split, new, text in _joined(_chunks(batches)):
        if new:
            found[split] = _Shape()
        found[split].add(text)
    rows = [(f, b, x.odd, json.dumps([x.depth, [list(o.items()) for o in x.opened]])) for (f, b), x in found.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.string()))], names=["f", "b", "odd", "shape"])


@dataclass
class _State:
    """Where a split begins: its number, in a string or not, how deep, in which of the arrays."""

    no: int
    inside: int
    depth: int
    array: str | None


def _states(rows: list) -> dict[tuple[str, int], _State]:
    out, inside, depth, array = {}, 0, 0, None
    for no, r in enumerate(sorted(rows, key=lambda r: (r["f"], r["b"]))):
        out[r["f"], r["b"]] = _State(no, inside, depth, array)
        depths, opened = json.loads(r["shape"])
        array = dict(opened[inside]).get(1 - depth, array)
        depth += depths[inside]
        inside ^= r["odd"]
    if depth or inside:
        raise ValueError("a node-link document is truncated")
    return out


_ROW = {"no": pa.int64(), "array": pa.string(), "k": pa.int64(), "part": pa.int32(), "text": pa.binary()}


class _Split:
    """Reads one split: batches of rows (no, array, k, part, text); k counts an array's elements here, and texts outside of elements."""

    def __init__(self, state: _State):
        self.no, self.inside, self.depth, self.array = state.no, state.inside, state.depth, state.array
        #: Of an element that hasn't ended: its text here, and whether it began here. Text since the last element, and whether there was one.
        self.element: list[bytes] = []
        self.begun, self.loose, self.after = False, b"", state.depth >= 3
        self.counts = dict.fromkeys([*ARRAYS, None], 0)
        self.rows: list[tuple] = []

    def _row(self, array: str | None, part: int, text: bytes) -> None:
        self.rows.append((self.no, array, self.counts[array], part, text))
        self.counts[array] += part in (_WHOLE, _HEAD, _OUTSIDE)

    def _close(self, text: bytes) -> None:
        if self.array:
            self._row(self.array, _WHOLE if self.begun else _TAIL, b"".join([*self.element, text]))
        self.element, self.begun, self.after = [], False, True

    def _batch(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*self.rows), _ROW.values())], names=list(_ROW))
            self.rows = []

    def add(self, text: bytes) -> Iterator[pa.RecordBatch]:
        at, step, self.inside, _, _ = _marks(text, self.inside)
        after = np.cumsum(step) + self.depth
        starts, ends = at[(step == 1) & (after == 3)].tolist(), (at[(step == -1) & (after == 2)] + 1).tolist()
        opened = at[(step == 1) & (after == 2)].tolist()
        place = 0
        if self.depth >= 3:
            if ends:
                place = ends.pop(0)
                self._close(text[:place])
            else:
                self.element.append(text)
                place = len(text)
        self.depth = int(after[-1]) if len(after) else self.depth
        last = starts.pop() if len(starts) > len(ends) else None
        gaps = [text[i:j] for i, j in zip([place, *ends], starts)]
        if starts and not opened and self.after and all(_COMMA.fullmatch(x) for x in {self.loose + gaps[0], *gaps[1:]}):
            # nothing but elements with commas between them
            self.loose = b""
            yield from self._batch()
            if self.array:
                self._objects(text, starts)
                n, k = len(starts), self.counts[self.array]
                columns = (np.full(n, self.no), [self.array] * n, np.arange(k, k + n), np.full(n, _WHOLE), [text[i:j] for i, j in zip(starts, ends)])
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _ROW.values())], names=list(_ROW))
                self.counts[self.array] += n
            place = ends[-1]
        else:
            for start, end, gap in zip(starts, ends, gaps):
                self._begin(text, start, opened, gap)
                self._close(text[start:end])
                place = end
        if last is not None:
            self._begin(text, last, opened, text[place:last])
            self.element, place = [text[last:]], len(text)
        self.loose += text[place:]
        if opened:
            self.array = _key(text, opened[-1])
        yield from self._batch()

    def _begin(self, text: bytes, start: int, opened: list[int], gap: bytes) -> None:
        gap, self.loose = self.loose + gap, b""
        while opened and opened[0] < start:
            self.array = _key(text, opened.pop(0))
        self._objects(text, [start])
        if not (self.after and _COMMA.fullmatch(gap)):
            self._row(None, _OUTSIDE, gap + b"{}")
        self.begun = self.after = True

    def _objects(self, text: bytes, starts: list[int]) -> None:
        if self.array and any(text[x] != ord("{") for x in starts):
            raise ValueError(f"an element of {self.array} is no object")

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.element and self.array:
            self._row(self.array, _HEAD if self.begun else _MIDDLE, b"".join(self.element))
        if self.loose:
            self._row(None, _OUTSIDE, self.loose)
        yield from self._batch()


def _elements(states: dict[tuple[str, int], _State], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split = None
    for key, new, text in _joined(_chunks(batches)):
        if new:
            if split:
                yield from split.end()
            split = _Split(states[key])
        yield from split.add(text)
    if split:
        yield from split.end()


def _outside(texts: list[bytes], counts: dict[str, int]) -> list[dict]:
    """The documents, each element an empty object (one for those that commas part)."""
    text, place, out = b"".join(texts).decode("utf-8-sig"), 0, []
    while text[place:].strip():
        doc, place = json.JSONDecoder().raw_decode(text, re.compile(r"\s*").match(text, place).end())
        out.append(doc)
    if not out or not all(isinstance(d, dict) and all(d.get(a) is None or (isinstance(d[a], list) and all(x == {} for x in d[a])) for a in ARRAYS) for d in out):
        raise ValueError("a node-link document is an object with arrays of objects")
    if any(bool(counts.get(a)) != any(d.get(a) for d in out) for a in ARRAYS):
        raise ValueError("an array's name and its bracket stand in two files")
    return out


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, links, commit) of the document, as they are; nodes and links in order (ord)."""
    raw = spark.read.option("lineSep", "{").text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    states = _states(raw.mapInArrow(_shapes, _SHAPE).collect())
    rows = raw.mapInArrow(lambda it: _elements(states, it), "no long, array string, k long, part int, text binary")
    parse = lambda text, a: F.when(F.col("array") == a, F.from_json(text.cast("string"), T.StructType.fromDDL(ARRAYS[a]), {"mode": "FAILFAST"})).alias(a)
    whole, text = F.col("part") == _WHOLE, F.col("text")
    rows = staged(rows.select("no", "array", "k", "part", *(parse(F.when(whole, text), a) for a in ARRAYS), F.when(~whole, text).alias("text")))

    n = {(r["no"], r["array"]): r["n"] for r in rows.where(F.col("part").isin(_WHOLE, _HEAD) & F.col("array").isNotNull()).groupBy("no", "array").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], dict.fromkeys(ARRAYS, 0)
    for no in range(len(states)):
        for a in ARRAYS:
            before.append((no, a, total[a]))
            total[a] += n.get((no, a), 0)
    parts = sorted(rows.where(F.col("text").isNotNull()).select("no", "array", "k", "part", "text").collect(), key=lambda r: (r["no"], r["part"] == _HEAD, r["k"]))
    docs = _outside([bytes(r["text"]) for r in parts if r["part"] == _OUTSIDE], total) if states else []
    cut: list[list] = []
    for r in parts:
        if r["part"] == _HEAD:
            cut.append([r["no"], r["array"], r["k"], bytes(r["text"])])
        elif r["part"] in (_MIDDLE, _TAIL):
            cut[-1][3] += bytes(r["text"])
    joined = spark.createDataFrame([(no, a, k, t.decode()) for no, a, k, t in cut], "no long, array string, k long, text string").select("no", "array", "k", *(parse(F.col("text"), a) for a in ARRAYS))
    every = rows.where(F.col("part") == _WHOLE).select("no", "array", "k", *ARRAYS).unionByName(joined)
    first = F.broadcast(spark.createDataFrame(before, "no long, array string, before long"))
    each = lambda a: every.where(F.col("array") == a).join(first, ["no", "array"]).select((F.col("before") + F.col("k")).alias("ord"), f"{a}.*")
    commits = [(None if (c := d.get("built_at_commit")) is None else c if isinstance(c, str) else json.dumps(c),) for d in docs]
    return each("nodes"), each("links"), spark.createDataFrame(commits, "commitSha string")


def classified(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with a kind: a file is labelled with its file's name; what ends in () is a method if a method link leads to it, else a function; the rest is unknown."""
    methods = links.where("relation = 'method'").select(F.col("target").alias("id")).distinct().withColumn("__method", F.lit(True))
    label = F.col("label")
    call = F.when(F.col("__method"), "Method").otherwise("Function")
    kind = F.when(label == base_name(F.col("source_file")), "File").when(label.endswith("()"), call).otherwise("Unknown")
    return nodes.join(methods, "id", "left").withColumn("kind", kind).drop("__method")


def nodes(raw: DataFrame, links: DataFrame, tool: str) -> DataFrame:
    name = F.when(F.col("kind") == "File", F.col("label")).otherwise(bare_name(F.col("label")))
    return classified(raw, links).select(F.lit(tool).alias("tool"), "ord", "id", name.alias("name"), F.coalesce("source_file", F.lit("")).alias("path"), "kind", line_marker(F.col("source_location")).alias("startLine"), F.lit(None).cast("int").alias("endLine"), F.lit(None).cast("string").alias("parentId"), F.lit(None).cast("string").alias("originalKind"), F.col("id").alias("toolId"))


def edges(links: DataFrame, tool: str) -> DataFrame:
    """Extracted links are resolved; the confidence is the score, or 1 for resolved and 0.5 for other links."""
    resolved = F.coalesce(F.col("confidence") == "EXTRACTED", F.lit(False))
    out = links.select(F.lit(tool).alias("tool"), "ord", F.col("source").alias("fromId"), F.col("target").alias("toId"), link_edge_type(F.col("relation")).alias("type"), resolved.alias("resolved"), F.coalesce("confidence_score", F.when(resolved, 1.0).otherwise(0.5)).alias("confidence"), F.col("relation").alias("edgeKind"))
    return out.where("type <> 'UNKNOWN'")
