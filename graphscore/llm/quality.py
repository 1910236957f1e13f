"""Quality rules as weak supervision: rules vote good, bad or abstain; EM estimates how often each is right.

Everything runs as DataFrame expressions. The only thing that reaches the driver is the table of vote patterns (at
most 3 ** len(RULES) rows, whatever the input) folded into one row of parameters.

Defined results: a null or empty text has no words, so it fails the base rules and is rejected; a row whose doc_id is
null or repeated is judged by its own text; an empty table gives an empty result and the prior parameters; other
columns pass through (a clashing ``quality`` column is replaced).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import let, staged, words

#: Words in the windows that are looked for twice.
WINDOW = 8
ITERATIONS = 25
#: A word with no letter or digit.
LETTERLESS = r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])"


def _covered(hashes: Column) -> Column:
    """Words under windows whose hash occurs twice or more; ``hashes`` by start position."""

    def marked(s: Column) -> Column:
        last = F.size(s) - 1
        twin = lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(s, k + 1)["h"] == x["h"]))
        starts = F.filter(F.transform(s, lambda x, k: F.when(twin(x, k), x["i"]).otherwise(F.lit(-1))), lambda p: p >= 0)
        return let(F.array_sort(starts), lambda ps: F.aggregate(F.transform(ps, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(ps, k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return let(F.array_sort(pairs), marked)


def _repeat_words(ws: Column) -> Column:
    windows = F.transform(F.sequence(F.lit(1), F.size(ws) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(ws, i, WINDOW)))
    counted = let(windows, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(_covered(hs)))
    return F.when(F.size(ws) > WINDOW, counted).otherwise(F.lit(0))


def features(text: Column) -> Column:
    """A struct of the counts that the rules look at."""
    t = F.coalesce(text, F.lit(""))
    kept_chars = lambda keep: F.length(F.regexp_replace(t, f"[^{keep}]+", ""))
    lines = let(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda ls: F.struct(F.size(ls).alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("dup")))
    counts = let(words(text), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), F.length(F.array_join(ws, "")).cast("long").alias("word_chars"), _repeat_words(ws).cast("long").alias("n_repeat_words")))
    return let(
        F.struct(counts.alias("c"), lines.alias("l")),
        lambda x: F.struct(
            x["c"]["n_words"].alias("n_words"), x["c"]["word_chars"].alias("word_chars"), kept_chars("#*$%&|<>").cast("long").alias("n_symbols"),
            x["l"]["dup"].cast("long").alias("n_dup_lines"), x["c"]["n_repeat_words"].alias("n_repeat_words"), x["l"]["n"].cast("long").alias("n_lines"), kept_chars("A-Z").cast("long").alias("n_upper"), kept_chars("!?").cast("long").alias("n_shouts"),
            kept_chars(r"\p{L}").cast("long").alias("n_letters"), F.regexp_count(t, F.lit(LETTERLESS)).cast("long").alias("n_letterless"),
        ),
    )


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


#: Each rule votes -1 (bad), 1 (good) or 0 (abstains), from the features ``f``. Most only ever object: that a text shows
#: no sign of one fault says little. Each common kind of junk sets off two rules, or EM could not tell a rule from noise.
RULES = {
    "length": lambda f: _vote(f["n_words"] < 20, F.lit(False)),
    "repetition": lambda f: _vote(100 * f["n_repeat_words"] > 30 * f["n_words"], F.lit(False)),
    "duplicate_lines": lambda f: _vote(10 * f["n_dup_lines"] > 3 * f["n_lines"], F.lit(False)),
    "symbols": lambda f: _vote(10 * f["n_symbols"] > f["n_words"], F.lit(False)),
    "letters": lambda f: _vote(10 * f["n_letters"] < 8 * f["word_chars"], F.lit(False)),
    "letterless_words": lambda f: _vote(10 * f["n_letterless"] > f["n_words"], F.lit(False)),
    "capitals": lambda f: _vote(2 * f["n_upper"] > f["word_chars"], F.lit(False)),
    "shouting": lambda f: _vote(10 * f["n_shouts"] > 2 * f["n_words"], F.lit(False)),
    "prose": lambda f: _vote((f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 15 * f["n_words"]), (f["n_words"] >= 20) & (f["word_chars"] >= 3 * f["n_words"]) & (f["word_chars"] <= 10 * f["n_words"])),
}


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 20) | (100 * f["n_repeat_words"] > 30 * f["n_words"])


def votes(f: Column) -> Column:
    return F.array(*(rule(f) for rule in RULES.values()))


@dataclass(frozen=True)
class Model:
    """Prior probability of good quality and, by rule, how likely each class is to be voted bad or good (else the rule abstains)."""

    prior: float
    #: By rule: P(bad vote | bad), P(good vote | bad), P(bad vote | good), P(good vote | good).
    rates: tuple[tuple[float, float, float, float], ...]

    def accuracy(self) -> list[float | None]:
        """By rule, how often it is right when it votes."""
        out = []
        for bb, gb, bg, gg in self.rates:
            right, wrong = (1 - self.prior) * bb + self.prior * gg, (1 - self.prior) * gb + self.prior * bg
            out.append(right / (right + wrong) if right + wrong else None)
        return out


#: Added to what EM counts, as (bad class, good class) of objecting: a rule objects to 4 in 10 bad and 1 in 100 good texts until the data say otherwise.
PSEUDO = 10.0


def fit(voted: DataFrame, column: str = "votes", iterations: int = ITERATIONS) -> Model:
    """EM over all rows' vote patterns (Dawid-Skene with abstentions). An objection may never speak for good quality and the prior stays in 0.05..0.95, so the classes can't swap."""
    m = len(RULES)
    # One row: patterns in natural order, so that sums of doubles agree from run to run.
    table = voted.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("t"))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    rate = lambda r, bad, good, s: F.when(s == -1, r[bad]).when(s == 1, r[good]).otherwise(1 - r[bad] - r[good])

    def good(acc: Column, v: Column) -> Column:
        terms = F.zip_with(v, acc["r"], lambda s, r: F.log(rate(r, "bg", "gg", s) / rate(r, "bb", "gb", s)))
        return F.lit(1.0) / (1 + F.exp(-(F.log(acc["p"] / (1 - acc["p"])) + add(terms))))

    def step(acc: Column, _: Column) -> Column:
        def again(ts: Column) -> Column:
            of_good, of_bad = add(F.transform(ts, lambda x: x["n"] * x["g"])), add(F.transform(ts, lambda x: x["n"] * (1 - x["g"])))
            share = lambda j, vote, w: add(F.transform(ts, lambda x: F.when(x["v"][j] == vote, x["n"] * w(x["g"])).otherwise(F.lit(0.0))))

            def rates(j: int) -> Column:
                if_bad = lambda vote, start: (share(j, vote, lambda g: 1 - g) + start * PSEUDO) / (of_bad + PSEUDO)
                if_good = lambda vote, start: (share(j, vote, lambda g: g) + start * PSEUDO) / (of_good + PSEUDO)
                x = F.struct(if_bad(-1, 0.4).alias("bb"), if_bad(1, 0.1).alias("gb"), if_good(-1, 0.01).alias("bg"), if_good(1, 0.3).alias("gg"))
                # at most an even rate for the good class: an objection is evidence against, or none
                return let(x, lambda y: F.struct(y["bb"].alias("bb"), y["gb"].alias("gb"), F.least(y["bg"], y["bb"]).alias("bg"), y["gg"].alias("gg")))

            p = F.coalesce(F.try_divide(of_good, of_good + of_bad), F.lit(0.5))
            return F.struct(F.greatest(F.lit(0.05), F.least(F.lit(0.95), p)).alias("p"), F.array(*(rates(j) for j in range(m))).alias("r"))

        return let(F.transform(F.col("t"), lambda x: F.struct(x["v"].alias("v"), x["n"].alias("n"), good(acc, x["v"]).alias("g"))), again)

    begin = F.struct(*(F.lit(x).alias(k) for k, x in (("bb", 0.4), ("gb", 0.1), ("bg", 0.01), ("gg", 0.3))))
    start = F.struct(F.lit(0.8).alias("p"), F.array(*[begin] * m).alias("r"))
    row = table.select(F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, step).alias("x")).first()["x"]
    return Model(row["p"], tuple(tuple(r) for r in row["r"]))


def posterior(v: Column, model: Model) -> Column:
    """Probability of good quality given the votes ``v``."""
    from math import log

    score = F.lit(log(model.prior / (1 - model.prior)))
    for j, (bb, gb, bg, gg) in enumerate(model.rates):
        score = score + F.when(v[j] == -1, F.lit(log(bg / bb))).when(v[j] == 1, F.lit(log(gg / gb))).otherwise(F.lit(log((1 - bg - gg) / (1 - bb - gb))))
    return F.lit(1.0) / (1 + F.exp(-score))


def _judged(docs: DataFrame, text: str, model: Model | None, name: str) -> DataFrame:
    x = docs.withColumn(name, features(F.col(text)))
    x = x.withColumn(name, F.struct(F.col(name).alias("features"), votes(F.col(name)).alias("votes")))
    v, f = F.col(f"{name}.votes"), F.col(f"{name}.features")
    if model is None:
        x = staged(x)  # features cost far more than a copy of the texts, so they are computed once for fit and verdict
        model = fit(x.select(v.alias("votes")))
    p = posterior(v, model)
    return x.withColumn(name, F.struct(f.alias("features"), v.alias("votes"), p.alias("posterior"), base_failed(f).alias("base_failed"), (~base_failed(f) & (p >= 0.5)).alias("kept")))


def judged(docs: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """``docs`` with a struct ``quality``: features, votes, posterior, base_failed and kept. Without ``model``, one is fitted on all rows first."""
    return _judged(docs.drop("quality"), text, model, "quality")


def good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, all columns unchanged; the model is fitted on all rows first."""
    return _judged(docs, text, None, "__judged").where("__judged.kept").select(*docs.columns)


def op10(spark, sf_dir: str) -> DataFrame:
    """Contract query: the features are staged once (a few numbers a row), so each text is read once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    f = F.col("f")
    rows = staged(docs.select("doc_id", features(F.col("text")).alias("f")).select("doc_id", "f", votes(f).alias("votes")))
    p = posterior(F.col("votes"), fit(rows))
    return rows.select("doc_id", *(f[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), base_failed(f).alias("base_failed"), (~base_failed(f) & (p >= 0.5)).alias("kept"), F.round(p, 6).alias("posterior"))
