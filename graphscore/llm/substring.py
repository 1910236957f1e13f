"""Repeated passages: words under any window of 13 words that also starts in a document with a smaller doc_id.

Difference-cover anchors. Windows of ANCHOR = 7 words are hashed only where the position modulo PERIOD = 7 is in COVER =
{0, 1, 3}. Every difference modulo 7 is a difference of two members of COVER, so wherever two documents agree on 13 words
there is a shift below 7 that puts both on cover positions, and the 7-word anchor there lies inside the agreement. So:

1. anchors of all documents meet by hash; those seen in two documents or more are shared;
2. around shared anchors only, each match is extended: the 13-word windows over the anchor are hashed (128 bits, so that
   equal hashes stand for equal words) and meet by hash, and all but the smallest doc_id learn that their window is a repeat;
3. the words under repeated windows are removed.

What meets is packed: a task sends one row for each hash range and piece of input, holding arrays. A hash that many
documents of a piece share is settled within the piece and sent once; a task remembers (at most KNOWN) such hashes, and
settles them in its later pieces too. So a passage that a third of all documents hold costs a group a few entries for
each task, not one for each document.

Defined results: null, empty and blank texts have no words (kept text empty); documents of fewer than 13 words keep all;
repeated rows (same doc_id) don't remove each other's words and are each judged by their own text; a row whose doc_id is
null is kept whole and removes nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import checked, lean, staged
from .hashing import U, Words, batches, released, rowwise, window_starts, windows

SIZE = 13
PERIOD, COVER, ANCHOR = 7, (0, 1, 3), 7
#: Bytes of text for which one more hash range is made.
RANGE_BYTES = 4_000_000
#: Hashes that a task remembers as met in several documents; it loses nothing by forgetting some.
KNOWN = 100_000
PACKED = "part int, settled boolean, range int, hashes binary, base long, docs binary, tags binary, places binary"
_COVERED = np.isin(np.arange(PERIOD), COVER)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    cols = [c.cast(pa.large_binary()) if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else c for c in batch.columns]
    return rowwise(pa.RecordBatch.from_arrays(cols, batch.schema.names))


def _anchors(ws: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and start (in its text) of each anchor of the texts of SIZE words or more."""
    start, text = window_starts(ws.first, ANCHOR)
    place = start - ws.first[text]
    ok = _COVERED[place % PERIOD] & (ws.counts()[text] >= SIZE)
    start, text, place = start[ok], text[ok], place[ok]
    return windows(ws.hashes()[0], ANCHOR)[start], text, place


def _pack(part: int, settled: bool, rng: int, hashes: np.ndarray, docs: np.ndarray, tags=None, places=None) -> tuple:
    """One packed row; doc_ids are kept as 4-byte offsets where they fit."""
    base = int(docs.min()) if len(docs) else 0
    off = docs.astype(np.uint64) - np.uint64(base % (1 << 64))
    off = off.astype(np.uint32) if len(off) and int(off.max()) < 1 << 32 else off
    raw = lambda x: None if x is None else x.astype(np.uint32).tobytes()
    return part, settled, rng, hashes.tobytes(), base, off.tobytes(), raw(tags), raw(places)


def _unpack_docs(base: int, raw: bytes, n: int) -> np.ndarray:
    off = np.frombuffer(raw, np.uint32 if len(raw) == 4 * n else np.uint64).astype(np.uint64)
    return (off + np.uint64(base % (1 << 64))).view(np.int64)


def _ranges(bits: int, hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in PACKED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def _first_of_run(*xs: np.ndarray) -> np.ndarray:
    new = np.ones(len(xs[0]), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in xs], 0)
    return new


def _runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of equal values; none of an empty array."""
    cuts = [*np.flatnonzero(_first_of_run(x)).tolist(), len(x)]
    return zip(cuts[:-1], cuts[1:], strict=True)


class _Known:
    """Hashes (pairs of 64 bits) that a task has met in several documents, and the smallest doc_id it has sent for each; the latest KNOWN."""

    def __init__(self):
        self.h, self.g, self.doc = np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64)

    def least(self, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are known, and the doc_id of each (0 if not)."""
        if not len(self.h):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        k = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return (found := (self.h[k] == h) & (self.g[k] == g)), np.where(found, self.doc[k], 0)

    def add(self, h: np.ndarray, g: np.ndarray, doc: np.ndarray) -> None:
        h, g, doc = (np.concatenate(x)[:KNOWN] for x in ((h, self.h), (g, self.g), (doc, self.doc)))
        order = np.lexsort((doc, g, h))
        h, g, doc = h[order], g[order], doc[order]
        new = _first_of_run(h)
        self.h, self.g, self.doc = h[new], g[new], doc[new]


def _emit_anchors(bits: int):
    """(doc_id, text) to packed rows: the anchors of each piece once, and those that two of its documents share as settled."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known()
        for batch in it:
            for rows in batches(_rows(batch), lambda r: len(r[1])):
                ids = np.array([r[0] for r in rows], np.int64)
                h, text, _ = _anchors(Words([r[1] for r in rows]))
                h &= U((1 << 64) - (1 << (32 - bits)) if bits < 32 else (1 << 64) - 1)  # 32 bits besides the range
                order = np.lexsort((ids[text], h))
                h, doc = h[order], ids[text][order]
                new = _first_of_run(h)
                first, last = doc[new], doc[np.append(np.flatnonzero(new)[1:], len(h)) - 1] if len(h) else doc
                met, _ = known.least(h[new], h[new])
                several = first != last
                out, shared = [], (several | met)[np.cumsum(new) - 1] if len(h) else np.zeros(0, bool)
                if shared.any():
                    out.append(_pack(int(ids.sum()) % (1 << max(bits, 1)), True, 0, h[shared], doc[shared]))
                known.add(h[new][several], h[new][several], first[several])
                h, doc = h[new][~met], first[~met]
                rng = _ranges(bits, h)
                low = ((h << U(bits)) >> U(32)).astype(np.uint32)
                for a, b in _runs(rng):
                    out.append(_pack(int(rng[a]), False, int(rng[a]), low[a:b], doc[a:b]))
                if out:
                    yield _batch(out)
        released()

    return run


def _meet_anchors(bits: int):
    """Of one hash range: (doc_id, anchor) for every anchor that two documents or more have."""

    def run(table: pa.Table) -> pa.Table:
        ids, keys, low, docs = [], [], [], []
        for _, settled, rng, raw, base, off, _, _ in zip(*(c.to_pylist() for c in table.columns), strict=True):
            if settled:
                h = np.frombuffer(raw, U)
                keys.append(h)
                ids.append(_unpack_docs(base, off, len(h)))
            else:
                h = np.frombuffer(raw, np.uint32)
                low.append((U(rng) << U(64 - bits) if bits else U(0)) | (h.astype(U) << U(32 - bits)))
                docs.append(_unpack_docs(base, off, len(h)))
        if low:
            h, doc = np.concatenate(low), np.concatenate(docs)
            order = np.argsort(h, kind="stable")
            h, doc = h[order], doc[order]
            new = _first_of_run(h)
            many = (np.diff(np.append(np.flatnonzero(new), len(h))) > 1)[np.cumsum(new) - 1]
            keys.append(h[many])
            ids.append(doc[many])
        ids, keys = np.concatenate(ids), np.concatenate(keys)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "anchor": pa.array(keys.view(np.int64))})

    return run


def _emit_windows(bits: int):
    """(doc_id, text, tag, anchors) to packed rows: windows over shared anchors, smallest doc_id of a piece first."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known()
        for batch in it:
            for rows in batches(_rows(batch), lambda r: len(r[1])):
                ids, tags = np.array([r[0] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64).astype(np.uint32)
                ws = Words([r[1] for r in rows])
                h, text, place = _anchors(ws)
                h &= U((1 << 64) - (1 << (32 - bits)) if bits < 32 else (1 << 64) - 1)
                # anchors of each text that are shared: look (text, hash) up among (text, shared hash)
                shared = np.concatenate([np.zeros(0, U), *(np.array(r[3], np.int64).view(U) for r in rows)])
                owner = np.repeat(np.arange(len(rows)), [len(r[3]) for r in rows])
                salt = U(0x9E3779B97F4A7C15)
                ok = np.isin(h ^ (text.astype(U) * salt), shared ^ (owner.astype(U) * salt))
                text, place = text[ok], place[ok]
                counts = ws.counts()
                cover = np.zeros(len(ws) + 1, np.int64)
                lo, hi = np.maximum(place - (SIZE - ANCHOR), 0), np.minimum(place, counts[text] - SIZE)
                np.add.at(cover, ws.first[text] + lo, 1)
                np.add.at(cover, ws.first[text] + hi + 1, -1)
                start = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
                text = np.searchsorted(ws.first, start, "right") - 1
                place = start - ws.first[text]
                h, g = (windows(x, SIZE)[start] for x in ws.hashes())
                order = np.lexsort((ids[text], g, h))
                h, g, text, place = h[order], g[order], text[order], place[order]
                doc, new = ids[text], _first_of_run(h, g)
                if not len(h):
                    continue
                run_no, firsts = np.cumsum(new) - 1, doc[new]
                met, sent = known.least(h[new], g[new])
                least = np.where(met, np.minimum(firsts, sent), firsts)
                several = met | (doc[np.append(np.flatnonzero(new)[1:], len(h)) - 1] != firsts)
                known.add(h[new][several], g[new][several], least[several])
                out, later = [], doc > least[run_no]
                if later.any():  # repeats of a window within what the task has read
                    out.append(_pack(int(ids.sum()) % (1 << max(bits, 1)), True, 0, np.zeros(0, U), doc[later], tags[text[later]], place[later]))
                h, g, doc, text, place = h[~later], g[~later], doc[~later], text[~later], place[~later]
                rng = _ranges(bits, h)
                for a, b in _runs(rng):
                    out.append(_pack(int(rng[a]), False, int(rng[a]), np.concatenate([h[a:b], g[a:b]]), doc[a:b], tags[text[a:b]], place[a:b]))
                if out:
                    yield _batch(out)
        released()

    return run


def _meet_windows(table: pa.Table) -> pa.Table:
    """Of one hash range: (doc_id, tag, place) for every window that also starts in a document with a smaller doc_id."""
    got, open_ = [], []
    for _, settled, _, raw, base, off, tags, places in zip(*(c.to_pylist() for c in table.columns), strict=True):
        t, p = np.frombuffer(tags, np.uint32), np.frombuffer(places, np.uint32)
        x = (_unpack_docs(base, off, len(t)), t, p)
        got.append(x) if settled else open_.append((*x, *np.frombuffer(raw, U).reshape(2, -1)))
    if open_:
        doc, t, p, h, g = (np.concatenate(x) for x in zip(*open_, strict=True))
        order = np.lexsort((doc, g, h))
        doc, t, p, h, g = doc[order], t[order], p[order], h[order], g[order]
        new = _first_of_run(h, g)
        later = doc > doc[new][np.cumsum(new) - 1]
        got.append((doc[later], t[later], p[later]))
    doc, t, p = (np.concatenate(x) for x in zip(*got, strict=True))
    return pa.table({"doc_id": pa.array(doc, pa.int64()), "tag": pa.array(t.astype(np.int64)), "place": pa.array(p.astype(np.int64))})


def _kept(digest: bool):
    """(doc_id, text[, places]) to what is left of the words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for rows in batches(_rows(batch), lambda r: len(r[1] or b"")):
                ws = Words([r[1] or b"" for r in rows])
                cover = np.zeros(len(ws) + 1, np.int64)
                for k, r in enumerate(rows):
                    if len(r) > 2 and r[2]:
                        at = ws.first[k] + np.array(r[2], np.int64)
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + SIZE, -1)
                gone = np.cumsum(cover[:-1]) > 0
                removed = np.add.reduceat(np.append(gone, False), ws.first[:-1]) * (ws.counts() > 0)
                # kept words with one space after each: copy bytes of kept words and their first following space
                marks = np.zeros(len(ws.bytes) + 1, np.int64)
                marks[ws.start[~gone]] += 1
                marks[ws.end[~gone] + 1] -= 1
                keep = np.cumsum(marks[:-1]) > 0
                raw = ws.bytes.copy()
                raw[ws.end] = 32
                flat, upto = raw[keep].tobytes(), np.concatenate([[0], np.cumsum(keep)])
                edges = np.append(ws.start, len(ws.bytes))[ws.first]
                cut = upto[edges]
                left = [flat[a : max(a, b - 1)] for a, b in zip(cut[:-1], cut[1:], strict=True)]
                last = [hashlib.sha256(x).hexdigest() for x in left] if digest else [x.decode() for x in left]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(ws.counts().astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(last, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])
        released()

    return run


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, places): starts of the repeated windows of each document that has any; tag tells rows of one doc_id apart by text."""
    texts = lean(docs).where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(30, max(4, int(np.ceil(np.log2(total / RANGE_BYTES + 1)))))
    sent = texts.mapInArrow(_emit_anchors(bits), PACKED)
    hits = staged(sent.groupBy("part").applyInArrow(_meet_anchors(bits), "doc_id long, anchor long").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")))
    ids = checked(hits.select("doc_id"), 16)
    some = texts.join(ids, "doc_id", "left_semi").withColumn("tag", _tag("text")).join(hits, "doc_id").select("doc_id", "text", "tag", "anchors")
    found = some.mapInArrow(_emit_windows(bits), PACKED).groupBy("part").applyInArrow(_meet_windows, "doc_id long, tag long, place long")
    return staged(found.groupBy("doc_id", "tag").agg(F.collect_set("place").alias("places")))


def _tag(column: str):
    return F.xxhash64(column).bitwiseAND(F.lit(0xFFFFFFFF))


def without_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept), one row for each row of ``docs``; kept is the text that is left or, with ``digest``, its SHA-256."""
    found = repeats(docs)
    ids = checked(found.select("doc_id").distinct(), 16)
    texts = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, n_words long, n_removed long, kept string"
    clean = texts.join(ids, "doc_id", "left_anti").mapInArrow(_kept(digest), schema)
    cut = texts.join(ids, "doc_id", "left_semi").withColumn("tag", _tag("text")).join(found, ["doc_id", "tag"], "left").select("doc_id", "text", "places").mapInArrow(_kept(digest), schema)
    return clean.union(cut)


def op6(spark, sf_dir: str) -> DataFrame:
    """Contract query over the whole of ``documents``."""
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True).withColumnRenamed("kept", "kept_sha256")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT r, doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: {'i': i, 's': array_to_string(w[i:i + 12], ' ')}), recursive := true) FROM d WHERE len(w) >= 13),
m AS (SELECT s, min(doc_id) AS f FROM k WHERE doc_id IS NOT NULL GROUP BY s),
g AS (SELECT DISTINCT r, i + o AS j FROM k JOIN m USING (s), range(13) AS t(o) WHERE f < doc_id),
e AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM d),
q AS (SELECT e.r, count(*) FILTER (g.j IS NOT NULL) AS n, string_agg(x, ' ' ORDER BY e.j) FILTER (g.j IS NULL) AS t FROM e LEFT JOIN g ON g.r = e.r AND g.j = e.j GROUP BY e.r)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN q USING (r)
"""
