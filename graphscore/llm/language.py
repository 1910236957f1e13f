"""Language identification by Bayesian fusion of evidence.

For each row: log P(text | language) from byte trigrams, the language its markup declares, the suffix or path of its
address, and a prior for its host. Host priors come from grouped counts: hosts are smoothed towards their domain, domains
towards the whole table; a row's own count is left out of the counts of its host and domain. Tables that are identified together
(column ``of``) have priors of their own.

The trigram model is fitted on the first CLIP characters of at most SAMPLE labelled rows (of each language the smallest hashes of doc_id,
so reruns agree), or of one of each language if there are more; everything else covers all rows and whole texts.

Defined results: null or empty texts and missing evidence say nothing (all languages alike, the prior decides); a null host
is a host of its own; null or repeated ids are rows of their own; without labelled rows the languages are DEFAULT and the
text says nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import checked, lean, let, staged
from .hashing import batches, rowwise
from .markup import decoded, tags

SAMPLE, CLIP = 1000, 20_000
DEFAULT = ("de", "en", "es", "fr")
BITS = 16
#: Trigrams are no independent witnesses: a text counts as at most this many of them.
WITNESSES = 200.0
#: How often the declared language and the address are right.
DECLARED, ADDRESS = 0.9, 0.85
#: Rows that a domain (the corpus) counts for in the prior of its hosts (domains).
HOST_WEIGHT, DOMAIN_WEIGHT = 5.0, 20.0
# Country suffixes that point to a language.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "nl": "nl", "pt": "pt", "br": "pt", "pl": "pl", "se": "sv"}

_LANG = re.compile(r"(?i)(?:\A|[\s\"'])(?:xml:)?lang\s*+=\s*+[\"']?([a-z]+)")
_CONTENT = re.compile(r"(?i)(?:\A|[\s\"'])content\s*+=\s*+[\"']?([a-z]+)")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts (each between two spaces), and where each text's begin."""
    raw = _LOWER[np.frombuffer(b" " + b"  ".join(texts) + b"  ", np.uint8)].astype(np.uint32)
    at = np.cumsum([0, *(len(t) + 2 for t in texts)])
    h = (raw[:-2] * np.uint32(0x9E3779B1) + raw[1:-1] * np.uint32(0x85EBCA77) + raw[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - BITS)
    return h, np.minimum(at, len(h))


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    #: log P(trigram | language), one row by hash.
    table: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log P(text | language), tempered, one row for each text."""
        h, at = grams(texts)
        sums = np.zeros((len(texts), len(self.languages)))
        each = self.table[h]
        for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            if len(texts[k]):
                sums[k] = each[a:b].mean(0, dtype=np.float64) * ((b - a) / (1 + (b - a) / WITNESSES))
        return sums - sums.max(1, keepdims=True) if len(texts) else sums


def fit(rows: list[tuple[str, str]]) -> TextModel:
    """From (language, text) pairs, by smoothed counts."""
    languages = tuple(sorted({x for x, _ in rows})) or DEFAULT
    counts = np.full((1 << BITS, len(languages)), 0.1)
    for k, x in enumerate(languages):
        h, _ = grams([t.encode() for y, t in rows if y == x])
        counts[:, k] += np.bincount(h, minlength=1 << BITS)[: 1 << BITS]
    table = np.log(counts / counts.sum(0))
    return TextModel(languages, (table - table.mean(1, keepdims=True)).astype(np.float32))


def sample(docs: DataFrame, n: int = SAMPLE) -> list[tuple[str, str]]:
    """At most ``n`` labelled rows (lang, begin of text) of ``docs``, as many of each language where it has them, and one at least. Rows are chosen by id alone; of rows that share an id and a language one counts."""
    labelled = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    each = max(1, n // max(1, labelled.select("lang").distinct().count()))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = labelled.select("lang", "doc_id").withColumn("k", F.row_number().over(order)).where(F.col("k") <= each).select(F.col("lang").alias("__lang"), F.col("doc_id").alias("__id")).distinct()
    some = labelled.join(checked(staged(ids), 32), (F.col("lang") == F.col("__lang")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    some = some.groupBy("lang", "doc_id").agg(F.min(F.struct(F.xxhash64("text"), F.substring("text", 1, CLIP).alias("text"))).alias("x"))
    return sorted((r["lang"], r["text"]) for r in some.select("lang", "x.text").collect())


def read(page: str) -> tuple[str, str | None]:
    """The text between tags, without scripts, styles and comments, and the language that the page declares, if any: the first of its html tag or of its meta tags."""
    out, language, at = [], None, 0
    for t in tags(page):
        out.append(page[at : t.start])
        at = t.end
        if t.inner >= 0 and t.name not in ("script", "style"):
            out.append(page[t.start : t.inner].partition(">")[2])
        if language is None and not t.close:
            m = _LANG.search(t.attributes) if t.name == "html" else _CONTENT.search(t.attributes) if t.name == "meta" and "content-language" in t.attributes.lower() else None
            language = m[1].lower() if m else None
    out.append(page[at:])
    return decoded(" ".join(out)), language


def address(url: str | None) -> tuple[str | None, str | None, str | None]:
    """Host, domain (its last two labels; three where the last but one is short, as in co.uk) and the language that path or suffix point to."""
    if not url:
        return None, None, None
    m = re.match(r"(?i)\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)", url)
    host, path = (m[1].lower().strip("."), m[2]) if m else (url.split("/")[0].lower(), "")
    labels = host.split(".")
    domain = ".".join(labels[-3:] if len(labels) > 2 and len(labels[-2]) <= 3 and len(labels[-1]) == 2 else labels[-2:])
    lead = path.strip("/").split("/")[0].lower()[:5].split("-")[0].split("_")[0]
    known = set(SUFFIXES.values())
    return host, domain, lead if lead in known else labels[0] if labels[0] in known else SUFFIXES.get(labels[-1])


def _evidence(model, markup: bool):
    """(id, text or html, url or source) to (id, host, domain, loglik)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: TextModel = model.value
        index, n = {x: k for k, x in enumerate(m.languages)}, len(m.languages)

        def says(language: str | None, right: float) -> np.ndarray:
            out = np.zeros(n)
            if language in index and n > 1:
                out += log((1 - right) / (n - 1))
                out[index[language]] = log(right)
            return out

        for batch in it:
            for rows in batches(rowwise(batch), lambda r: len(r[1] or "")):
                pages = [(read(r[1]) if markup else (r[1], None)) if r[1] else ("", None) for r in rows]
                texts = [t for t, _ in pages]
                like = m.scores([t.encode() for t in texts])
                places = [address(r[2]) if markup else (r[2], None, None) for r in rows]
                if markup:
                    for k in range(len(rows)):
                        like[k] += says(pages[k][1], DECLARED) + says(places[k][2], ADDRESS)
                yield pa.RecordBatch.from_pydict({"id": pa.array([r[0] for r in rows], pa.int64()), "host": pa.array([p[0] for p in places], pa.string()), "domain": pa.array([p[1] for p in places], pa.string()), "loglik": pa.array(list(like), pa.list_(pa.float64()))})

    return run


def _best(scores: Column) -> Column:
    """Index (from 0) of the largest score, the first of equals."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def identified(rows: DataFrame, model: TextModel) -> DataFrame:
    """``rows`` (staged; with host, domain, loglik and, of several tables, ``of``) and lang, probability: evidence fused with the host's prior."""
    n = len(model.languages)
    of = F.col("of") if "of" in rows.columns else F.lit("")
    total_of = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)
    counted = rows.select(of.alias("t"), F.col("host").alias("h"), F.col("domain").alias("d"), _best(F.col("loglik")).alias("k"))
    each = [F.sum((F.col("k") == j).cast("double")).alias(f"c{j}") for j in range(n)]
    hosts = staged(counted.groupBy("t", "d", "h").agg(*each))
    sums = F.array(*(F.sum(f"c{j}") for j in range(n)))
    domains = hosts.groupBy(F.col("t").alias("dt"), F.col("d").alias("dd")).agg(sums.alias("in_domain"))
    tables = hosts.groupBy(F.col("t").alias("tt")).agg(sums.alias("s")).select("tt", F.transform("s", lambda c: (c + 1) / (total_of(F.col("s")) + n)).alias("in_table"))
    counts = hosts.select("t", "d", "h", F.array(*(F.col(f"c{j}") for j in range(n))).alias("in_host"))
    counts = counts.join(domains, F.col("t").eqNullSafe(F.col("dt")) & F.col("d").eqNullSafe(F.col("dd"))).join(tables, F.col("t").eqNullSafe(F.col("tt"))).drop("dt", "dd", "tt")
    known = checked(staged(counts), 64 + 24 * n)

    x = rows.withColumn("__of", of).join(known, F.col("__of").eqNullSafe(F.col("t")) & F.col("domain").eqNullSafe(F.col("d")) & F.col("host").eqNullSafe(F.col("h"))).drop("t", "d", "h", "__of")
    top = F.col("in_table")
    smooth = lambda counts, up, weight: let(total_of(counts), lambda s: F.zip_with(counts, up, lambda c, u: (c + weight * u) / (s + weight)))

    def fused(own: Column) -> Column:
        less = lambda xs: F.transform(xs, lambda v, j: v - F.when(j == own, 1.0).otherwise(0.0))
        prior = let(smooth(less(F.col("in_domain")), top, DOMAIN_WEIGHT), lambda up: smooth(less(F.col("in_host")), up, HOST_WEIGHT))
        scores = F.zip_with(F.col("loglik"), prior, lambda e, p: e + F.log(p))

        def ended(s: Column) -> Column:
            return F.struct(F.element_at(F.array(*map(F.lit, model.languages)), _best(s) + 1).alias("lang"), (F.lit(1.0) / total_of(F.transform(s, lambda v: F.exp(v - F.array_max(s))))).alias("probability"))

        return let(scores, ended)

    x = x.withColumn("x", let(_best(F.col("loglik")), fused))
    return x.select(*rows.columns, F.col("x.lang").alias("lang"), F.round("x.probability", 6).alias("probability"))


def evidence(source: DataFrame, model: TextModel, id_: str, text: str, place: str, markup: bool) -> DataFrame:
    """(id, host, domain, loglik) of ``source``: of web pages by html and url, else of plain texts whose ``place`` stands for the host."""
    shared = source.sparkSession.sparkContext.broadcast(model)
    return lean(source.select(F.col(id_).cast("long"), F.col(text).cast("string"), F.col(place).cast("string"))).mapInArrow(_evidence(shared, markup), "id long, host string, domain string, loglik array<double>")


def op7(spark, sf_dir: str) -> DataFrame:
    """Language of every row of ``pages``, and of ``documents`` (whose source stands for the host; their lang is used for the sample only)."""
    docs, pages = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = fit(sample(docs))
    rows = evidence(pages, model, "page_id", "html", "url", True).withColumn("of", F.lit("page")).union(evidence(docs, model, "doc_id", "text", "source", False).withColumn("of", F.lit("document")))
    found = identified(staged(rows), model)
    ids = [F.when(F.col("of") == kind, F.col("id")).alias(name) for kind, name in (("document", "doc_id"), ("page", "page_id"))]
    return found.select(*ids, "host", "lang", "probability")
