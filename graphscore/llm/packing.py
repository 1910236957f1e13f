"""Token ids packed into fixed-length rows: best-fit decreasing with a segment tree over remaining capacities.

Texts are tokenised with a public vocabulary whose path is a parameter. A document longer than a row is cut into full rows
and a rest, so no token is lost. Pieces are packed inside groups of about GROUP tokens within one task: no shuffle, and
memory doesn't follow the size of a partition. The result is an ordinary table, so a lost task is run again and files are
committed by Spark's writer.

A row of the packed table: ``ids`` (``length`` little-endian unsigned integers of ``id_bytes``, padded), ``cu_seqlens``
(cumulative segment lengths, from 0), ``positions`` (as ids; from 0 again at each segment, 0 in the padding), and for
each segment its document and its number in the document (``doc_ids``, ``pieces``).

Defined results: null and empty texts have no tokens and hence no segment; null or repeated doc_ids are kept with their
segments; special tokens' names inside a text are ordinary text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import lean
from .hashing import batches, released, rowwise

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LENGTH = 2048
GROUP = 4_000_000
#: Characters of a text that are encoded at a time, or little more.
PART = 200_000
# Fixed value: how byte-level BPE vocabularies of this kind part a text.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PACKED = "ids binary, id_bytes int, n_tokens int, cu_seqlens array<int>, positions binary, doc_ids array<long>, pieces array<int>"

_GAP = re.compile(r"(?<=\S) (?=\S)")
_loaded: dict[str, Tokenizer] = {}


class Tokenizer:
    """Byte-level BPE. A single space between two other characters always parts tokens, so long texts are encoded part by part."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.dtype = np.dtype("<u2") if max(ranks.values()) < 65_535 else np.dtype("<u4")
        self.pad = max(ranks.values()) + 1

    def ids(self, text: str) -> np.ndarray:
        parts, at = [], 0
        while at < len(text):
            gap = _GAP.search(text, at + PART) if len(text) - at > PART else None
            end = gap.start() if gap else len(text)
            parts.append(np.array(self.encoding.encode_ordinary(text[at:end]), self.dtype))
            at = end
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, self.dtype), *parts])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self.ids(t) for t in texts]

    def decode(self, ids: np.ndarray) -> str:
        return self.encoding.decode([int(i) for i in ids])


def tokenizer(path: str = VOCABULARY) -> Tokenizer:
    """Loaded once for each worker."""
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]


class Capacities:
    """Bins by remaining capacity 0 .. length; a segment tree finds the least capacity that is enough."""

    def __init__(self, length: int):
        self.width = 1 << length.bit_length()
        self.tree = [0] * (2 * self.width)
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, capacity: int, bin_: int) -> None:
        self.bins[capacity].append(bin_)
        at = capacity + self.width
        while at:
            self.tree[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (capacity, bin) for the least capacity of ``need`` or more."""
        at = need + self.width
        if not self.tree[at]:
            while at > 1 and not (at % 2 == 0 and self.tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.width:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        capacity = at - self.width
        while at:
            self.tree[at] -= 1
            at >>= 1
        return capacity, self.bins[capacity].pop()


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Indexes of ``sizes`` (1 .. length) by bin: best-fit decreasing, ties in order."""
    bins: list[list[int]] = []
    free = Capacities(length)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        got = free.take(sizes[k])
        capacity, b = got or (length, len(bins))
        if got is None:
            bins.append([])
        bins[b].append(k)
        if capacity > sizes[k]:
            free.add(capacity - sizes[k], b)
    return bins


def _packed(docs: list[tuple], length: int, pad: int, dtype: np.dtype) -> Iterator[tuple]:
    pieces = [(i, n, ids[at : at + length]) for i, ids in docs for n, at in enumerate(range(0, len(ids), length))]
    for bin_ in best_fit([len(p[2]) for p in pieces], length):
        row, positions, lengths = np.full(length, pad, dtype), np.zeros(length, dtype), [0]
        for k in bin_:
            a, b = lengths[-1], lengths[-1] + len(pieces[k][2])
            row[a:b] = pieces[k][2]
            positions[a:b] = np.arange(b - a)
            lengths.append(b)
        yield row.tobytes(), dtype.itemsize, lengths[-1], lengths, positions.tobytes(), [pieces[k][0] for k in bin_], [pieces[k][1] for k in bin_]


def _rows(path: str, length: int):
    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    names = [x.split()[0] for x in PACKED.split(", ")]

    def sent(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
        for some in batches(rows, lambda r: 2 * len(r[0])):
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in some], t) for k, t in enumerate(kinds)], names=names)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, docs, total = tokenizer(path), [], 0
        for batch in it:
            texts = ((i, t or "") for i, t in rowwise(batch))
            for rows in batches(texts, lambda r: len(r[1])):
                coded = tok.encode([t for _, t in rows])
                docs += [(r[0], ids) for r, ids in zip(rows, coded, strict=True) if len(ids)]
                total += sum(map(len, coded))
                if total >= GROUP:
                    yield from sent(_packed(docs, length, tok.pad, tok.dtype))
                    docs, total = [], 0
        if docs:
            yield from sent(_packed(docs, length, tok.pad, tok.dtype))
        docs.clear()
        released()

    return run


def packed(docs: DataFrame, path: str = VOCABULARY, length: int = LENGTH) -> DataFrame:
    """The packed table of ``docs`` (doc_id, text); see the module for its columns. ``path``: a vocabulary that every executor has. ``length`` is at most 65,535."""
    if not 1 <= length <= 65_535:
        raise ValueError("length must be 1 to 65,535")
    return lean(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(_rows(path, length), PACKED)


def unpacked(rows: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, ids array<int>): the segments of a packed table, one row each."""
    kinds = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("ids", pa.list_(pa.int32()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], f"<u{r['id_bytes']}")
                cu = r["cu_seqlens"]
                out += [{"doc_id": d, "piece": p, "ids": ids[a:b].tolist()} for d, p, a, b in zip(r["doc_ids"], r["pieces"], cu, cu[1:], strict=False)]
            yield pa.RecordBatch.from_pylist(out, kinds)

    return rows.mapInArrow(run, "doc_id long, piece int, ids array<int>")


def write_packed(docs: DataFrame, out: str, path: str = VOCABULARY, length: int = LENGTH) -> None:
    """Writes the packed table as Parquet files under ``out``, which must not exist."""
    packed(docs, path, length).write.parquet(out)


def op8(spark, sf_dir: str) -> DataFrame:
    """All ``documents``, packed into rows of 2,048 tokens."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
