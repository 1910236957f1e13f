"""Personal data: exact patterns, and spans found by a character-level bidirectional LSTM with CRF transitions.

The network is written and trained in numpy, on a bounded number of labelled snippets made by ``snippets``. Every kind of
span holds a digit or an "@" by definition, so only the surroundings of such characters are read by the network, wherever
they stand in the text; the surroundings are cut into overlapping windows, and each character takes its label from the
window in which it stands most centrally. A span of the network is added if it passes the checks of its kind (digits,
Luhn, parts) and overlaps no span of the patterns.

Defined results: a null or empty text has no spans; null or repeated doc_ids are rows of their own; an empty table gives
an empty result; other columns are ignored. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import lean
from .hashing import batches, rowwise

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
WINDOW, STRIDE, AROUND = 96, 48, 40
EMBED, HIDDEN = 10, 16

_TRIGGER = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match always starts where a run of digits does: from later in the run it would fail as well
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in text.split("."))


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by start, then kind."""
    if not _TRIGGER.search(text):
        return []
    out: list[Span] = []
    last = 0
    for m in _DOMAIN.finditer(text):
        a = m.start()
        while a > last and text[a - 1] in _LOCAL:
            a -= 1
        if a < m.start():
            out.append(("email", a, m.end()))
            last = m.end()
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _octets(m[0])]
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _valid(kind: str, span: str) -> bool:
    """Whether a span of the network is of its kind."""
    d = _digits(span)
    if kind == "email":
        local, _, domain = span.partition("@")
        return bool(local) and "@" not in domain and re.fullmatch(r"[^\s@.]+(?:\.[^\s@.]+)+", domain) is not None
    if kind == "ip":
        return re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", span) is not None and _octets(span)
    if kind == "card":
        return re.fullmatch(r"[0-9](?:[\s./_-]?[0-9])+", span) is not None and 14 <= len(d) <= 19 and luhn(d)
    return re.fullmatch(r"\(?[0-9][\s().0-9/-]+[0-9]", span) is not None and len(d) != len(span) and 10 <= len(d) <= 15 and "." not in span.replace(".", "", 1) * (span.count(".") == 3)


def _class(c: str) -> int:
    o = ord(c)
    if 33 <= o < 127:
        return o - 30 + (32 if 65 <= o < 91 else 0)  # capitals as small letters
    return 1 if c.isspace() else 2


_CLASS = np.array([_class(chr(k)) for k in range(128)])
CLASSES = 100


def classes(text: str) -> np.ndarray:
    """Class of each character: 0 is padding, 1 white space, 2 other than ASCII."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full(len(points), 2)
    low = points < 128
    out[low] = _CLASS[points[low]]
    return out


def snippets(n: int = 1300, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Labelled windows (classes and labels): prose with personal data in many shapes, and numbers that are none."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice(["ra", "ne", "tion", "the", "ol", "mi", "ber", "que", "st", "en", "al", "é", "ung"]) for _ in range(rng.randint(1, 4)))
    letters = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    name = lambda: letters() if rng.random() < 0.4 else rng.choice([word(), f"{word()}.{word()}", f"{word()}{digits(2)}", f"{word()}_{word()}.{digits(2)}"])

    def card() -> str:
        body = digits(15)
        full = next(body + c for c in "0123456789" if luhn(body + c))
        gap = rng.choice(["", " ", "-", ".", "/"])
        return gap.join(full[k : k + 4] for k in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([f"+{digits(1)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(2)} {a} {b} {c}", f"0{digits(3)}/{digits(7)}", f"0{a} {b} {c}"])

    def email() -> str:
        local, domain = name(), f"{rng.choice([word, letters])()}.{rng.choice(['com', 'org', 'net', 'de', 'co.uk', 'example'])}"
        if rng.random() < 0.6:  # letters beyond ASCII, which the patterns don't know
            at = rng.randint(0, len(local))
            local = local[:at] + rng.choice("éüñøß") + local[at:]
        if rng.random() < 0.4:
            at = rng.randint(0, domain.index("."))
            domain = domain[:at] + rng.choice("éüñøß") + domain[at:]
        return f"{local}@{domain}"

    make = {"email": email, "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), "card": card, "phone": phone}
    none = [lambda: digits(4), lambda: f"{digits(1)}.{digits(1)}", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"${digits(3)}.{digits(2)}", lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(16, 40))), lambda: digits(rng.randint(1, 12)), lambda: f"{digits(2)}:{digits(2)}", lambda: f"@{word()}", lambda: f"{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"{digits(1)},{digits(3)},{digits(3)}", lambda: f"{word()}@{word()}"]
    xs, ys = np.zeros((n, WINDOW), int), np.zeros((n, WINDOW), int)
    for i in range(n):
        text, y = "", []

        def put(piece: str, kind: str | None = None, y=y) -> str:
            k = 0 if kind is None else 1 + 2 * KINDS.index(kind)
            y.extend(([k] + [k + 1 if k else 0] * (len(piece) - 1)) if piece else [])
            return piece

        while len(text) < WINDOW:
            for _ in range(rng.randint(1, 6)):
                text += put(word() + rng.choice(["", "", ",", ".", "***", "!!"]) + rng.choice([" ", " ", "\n"]))
            if rng.random() < 0.65:
                kind = rng.choice(KINDS)
                text += put(rng.choice(["", "(", "<", '"']) if kind != "phone" else "") + put(make[kind](), kind)
            else:
                text += put(rng.choice(none)())
            text += put(rng.choice([" ", ". ", ", ", "\n", "*** ", ") "]))
        cut = rng.randint(0, max(0, len(text) - WINDOW))
        xs[i], ys[i] = classes(text)[cut : cut + WINDOW], y[cut : cut + WINDOW]
        if ys[i, 0] and ys[i, 0] % 2 == 0:
            ys[i, 0] -= 1
        if rng.random() < 0.5:  # as the last window of a stretch is padded
            end = rng.randint(24, WINDOW)
            xs[i, end:] = ys[i, end:] = 0
    return xs, ys


class Network:
    """Embedding, one bidirectional LSTM layer, linear scores, CRF transitions."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        init = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
        self.p = {"emb": r.standard_normal((CLASSES, EMBED)).astype(np.float32) * 0.5, "wx": init(2, EMBED, 4 * HIDDEN), "wh": init(2, HIDDEN, 4 * HIDDEN), "b": np.zeros((2, 1, 4 * HIDDEN), np.float32), "wo": init(2 * HIDDEN, LABELS), "bo": np.zeros(LABELS, np.float32), "tr": np.zeros((LABELS, LABELS), np.float32)}
        self.p["b"][:, :, HIDDEN : 2 * HIDDEN] = 1  # remember by default

    def scores(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Label scores of windows ``x`` (n, t); ``keep`` gets what the backward pass needs."""
        p, (n, t), h_ = self.p, x.shape, HIDDEN
        e = p["emb"][x]
        both = np.stack([e, e[:, ::-1]])
        z = both @ p["wx"][:, None] + p["b"][:, None]
        h, c = np.zeros((2, n, h_), np.float32), np.zeros((2, n, h_), np.float32)
        hs = np.zeros((2, n, t, h_), np.float32)
        steps = []
        for k in range(t):
            a = z[:, :, k] + h @ p["wh"]
            s = 1 / (1 + np.exp(-a[..., : 3 * h_]))
            g = np.tanh(a[..., 3 * h_ :])
            old, was = c, h
            c = s[..., h_ : 2 * h_] * c + s[..., :h_] * g
            tc = np.tanh(c)
            h = s[..., 2 * h_ :] * tc
            hs[:, :, k] = h
            if keep is not None:
                steps.append((s, g, old, tc, was))
        hidden = np.concatenate([hs[0], hs[1][:, ::-1]], -1)
        if keep is not None:
            keep += [both, steps, hidden]
        return hidden @ p["wo"] + p["bo"]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log-likelihood a window, and its gradients."""
        p, (n, t), h_ = self.p, x.shape, HIDDEN
        kept: list = []
        e = self.scores(x, kept).astype(np.float64)
        both, steps, hidden = kept
        tr = p["tr"].astype(np.float64)
        fw, bw = np.zeros((t, n, LABELS)), np.zeros((t, n, LABELS))
        fw[0] = e[:, 0]
        for k in range(1, t):
            fw[k] = np.logaddexp.reduce(fw[k - 1][:, :, None] + tr, 1) + e[:, k]
        for k in range(t - 2, -1, -1):
            bw[k] = np.logaddexp.reduce(tr[None] + (e[:, k + 1] + bw[k + 1])[:, None, :], 2)
        logz = np.logaddexp.reduce(fw[-1], 1)
        gold = np.eye(LABELS)[y]
        de = (np.exp(fw + bw - logz[None, :, None]).transpose(1, 0, 2) - gold) / n
        pairs = np.zeros_like(tr)
        for k in range(1, t):
            pairs += np.exp(fw[k - 1][:, :, None] + tr + (e[:, k] + bw[k])[:, None, :] - logz[:, None, None]).sum(0)
        went = np.zeros_like(tr)
        np.add.at(went, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        loss = (logz - np.take_along_axis(e, y[..., None], 2).sum((1, 2)) - tr[y[:, :-1], y[:, 1:]].sum(1)).mean()

        de = de.astype(np.float32)
        grads = {"tr": ((pairs - went) / n).astype(np.float32), "wo": np.einsum("nth,ntl->hl", hidden, de), "bo": de.sum((0, 1))}
        dh_all = de @ p["wo"].T
        dh_all = np.stack([dh_all[..., :h_], dh_all[:, ::-1, h_:]])
        dz = np.zeros((2, n, t, 4 * h_), np.float32)
        dwh, dh, dc = np.zeros_like(p["wh"]), np.zeros((2, n, h_), np.float32), np.zeros((2, n, h_), np.float32)
        for k in range(t - 1, -1, -1):
            s, g, old, tc, was = steps[k]
            i, f, o = s[..., :h_], s[..., h_ : 2 * h_], s[..., 2 * h_ :]
            dh = dh + dh_all[:, :, k]
            dc = dc + dh * o * (1 - tc * tc)
            d = np.concatenate([dc * g * i * (1 - i), dc * old * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], -1)
            dz[:, :, k] = d
            dwh += was.transpose(0, 2, 1) @ d
            dh, dc = d @ p["wh"].transpose(0, 2, 1), dc * f
        grads |= {"wh": dwh, "b": dz.sum((1, 2))[:, None], "wx": np.einsum("antd,antg->adg", both, dz)}
        dx = dz @ p["wx"][:, None].transpose(0, 1, 3, 2)
        grads["emb"] = np.zeros_like(p["emb"])
        np.add.at(grads["emb"], x, dx[0] + dx[1][:, ::-1])
        return float(loss), grads

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 14, size: int = 45, rate: float = 0.02, seed: int = 5) -> float:
        """Adam; returns the last epoch's mean loss."""
        r, first, second, step, mean = np.random.default_rng(seed), {}, {}, 0, 0.0
        for epoch in range(epochs):
            order, losses = r.permutation(len(x)), []
            for a in range(0, len(x), size):
                loss, grads = self.gradients(x[order[a : a + size]], y[order[a : a + size]])
                losses.append(loss)
                step += 1
                for k, g in grads.items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first.get(k, 0) + 0.1 * g
                    second[k] = 0.99 * second.get(k, 0) + 0.01 * g * g
                    self.p[k] -= (rate * (0.5 if epoch > epochs * 0.6 else 1) * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
            mean = float(np.mean(losses))
        return mean

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Viterbi labels of windows."""
        e, tr = self.scores(x), self.p["tr"]
        n, t = x.shape
        best, back = e[:, 0], np.zeros((t, n, LABELS), np.int64)
        for k in range(1, t):
            a = best[:, :, None] + tr
            back[k] = a.argmax(1)
            best = a.max(1) + e[:, k]
        out = np.zeros((n, t), np.int64)
        out[:, -1] = best.argmax(1)
        for k in range(t - 1, 0, -1):
            out[:, k - 1] = back[k][np.arange(n), out[:, k]]
        return out


@functools.lru_cache(1)
def network() -> Network:
    net = Network()
    net.train(*snippets())
    return net


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches within AROUND of a digit or "@", merged where they meet."""
    out: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def network_spans(texts: list[str], net: Network, size: int = 512) -> list[list[Span]]:
    """Spans that the network labels in each text, reconciled over its windows."""
    jobs = []  # text, start of the window
    parts = [regions(t) for t in texts]
    for k, rs in enumerate(parts):
        jobs += [(k, at, b) for a, b in rs for at in (range(a, max(a + 1, b - WINDOW + STRIDE), STRIDE))]
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by text: how central the window was that labels a character, and its label
    coded = {k: classes(texts[k]) for k, rs in enumerate(parts) if rs}
    for j in range(0, len(jobs), size):
        some = jobs[j : j + size]
        x = np.zeros((len(some), WINDOW), int)
        for i, (k, at, b) in enumerate(some):
            piece = coded[k][at : min(b, at + WINDOW)]
            x[i, : len(piece)] = piece
        for (k, at, b), ys in zip(some, net.decode(x), strict=True):
            if k not in held:
                held[k] = np.full(len(coded[k]), -1, np.int16), np.zeros(len(coded[k]), np.int8)
            n = min(b, at + WINDOW) - at
            # an outer edge of the region is no edge: nothing beyond it can be part of a span
            far = np.full(n, WINDOW)
            now = np.minimum(np.arange(n) if at else far, np.arange(n)[::-1] if at + n < b else far)
            depth, label = held[k][0][at : at + n], held[k][1][at : at + n]
            better = now > depth
            depth[better], label[better] = now[better], ys[:n][better]
    out: list[list[Span]] = [[] for _ in texts]
    for k, (_, label) in sorted(held.items()):
        start = kind = end = None
        where = np.flatnonzero(label)
        for at, y in [*zip(where.tolist(), label[where].tolist(), strict=True), (None, 0)]:
            if kind is not None and at == end and y == 2 + 2 * kind:
                end = at + 1
                continue
            if kind is not None:
                out[k].append((KINDS[kind], start, end))
                kind = None
            if y:
                kind, start, end = (y - 1) // 2, at, at + 1
    return out


def spans(texts: list[str], net: Network) -> list[tuple[list[Span], list[Span]]]:
    """Of each text, the spans of the patterns, and all spans, by start, then kind."""
    base = [base_spans(t) for t in texts]
    out = []
    for text, own, more in zip(texts, base, network_spans(texts, net), strict=True):
        new = []
        for kind, a, b in more:
            while a < b and (text[a].isspace() or text[a] in "\"'<>[]{},;:"):
                a += 1
            while a < b and (text[b - 1].isspace() or text[b - 1] in "\"'<>[]{},;:.!?*"):
                b -= 1
            edge = (a and text[a - 1].isdigit()) or (b < len(text) and text[b].isdigit())
            if a < b and not edge and _valid(kind, text[a:b]) and not any(x < b and a < y for _, x, y in own):
                new.append((kind, a, b))
        out.append((own, sorted(own + new, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))))
    return out


def _joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def detected(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added), one row for each row of ``docs`` (doc_id, text). Counts and hash are of the patterns' spans; n_added counts the network's."""
    shared = docs.sparkSession.sparkContext.broadcast(net or network())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for rows in batches(rowwise(batch), lambda r: len(r[1] or "")):
                found = spans([r[1] or "" for r in rows], shared.value)
                cols = {"doc_id": pa.array([r[0] for r in rows], pa.int64())}
                for kind in KINDS:
                    cols[f"n_{kind}"] = pa.array([sum(s[0] == kind for s in b) for b, _ in found], pa.int64())
                cols["base_sha256"] = pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b, _ in found], pa.string())
                cols["spans"] = pa.array([_joined(s) for _, s in found], pa.string())
                cols["n_added"] = pa.array([len(s) - len(b) for b, s in found], pa.int64())
                yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return lean(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, schema)


def op5(spark, sf_dir: str) -> DataFrame:
    """Contract query over the whole of ``documents``."""
    return detected(spark.read.parquet(f"{sf_dir}/documents.parquet"))
