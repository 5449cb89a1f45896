"""Language identification with a small byte convolutional network, trained in numpy.

Method. Text becomes folded bytes in windows of a fixed length. Filters of several widths slide over
byte embeddings; their outputs are max-pooled over the window, and a softmax layer gives the language.
A filter's output is a sum of one table row per byte in its width, so that inference is table lookups
over pairs of bytes instead of products. A document's score is the mean of its windows' log
probabilities, over all windows of the whole text.

Training fits on the driver, on a bounded sample with documented bounds (`fit`): at most `per_language` labelled
documents of each language, chosen by a hash of doc_id; the `languages` most frequent languages, so that rarer ones are
not learned; and of a text of more than three times `excerpt` characters its head, middle and tail of that
length each. Predictions read whole texts.

Defined results: a null text, or one without a letter, is `und` with score 0.0. Without any labelled
document everything is `und`. Null labels are not used. Ties go to the first language by name. Repeated
rows are judged each on its own; extra columns come back as they are. An empty table gives no rows; very long texts are
read whole, window by window.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, small_batches

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 4), 16, 8
LETTER = re.compile(r"[^\W\d_]")

#: Bytes to symbols: a-z by letter without case, all bytes from 0x80 kept, white space and the rest by kind.
SYMBOL = np.full(256, 1, np.uint8)
SYMBOL[[0x20, *range(9, 14)]] = 0
SYMBOL[48:58] = 2
SYMBOL[97:123] = np.arange(3, 29)
SYMBOL[65:91] = np.arange(3, 29)
SYMBOL[128:256] = np.arange(29, 157)
N_SYMBOLS = 157


def windows(data: bytes) -> np.ndarray:
    """(windows, WINDOW) symbols of a whole text; the last window ends with the text, short ones are padded."""
    s = SYMBOL[np.frombuffer(data, np.uint8)]
    n = max(1, -(-len(s) // WINDOW))
    if len(s) < WINDOW:
        return np.pad(s, (0, WINDOW - len(s)))[None]
    starts = np.minimum(np.arange(n) * WINDOW, len(s) - WINDOW)
    return s[starts[:, None] + np.arange(WINDOW)]


class Net:
    """Embedding, one filter bank a width, max pooling, softmax."""

    def __init__(self, classes: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.classes = classes
        self.e = (r.standard_normal((N_SYMBOLS, EMBED)) * 0.5).astype(np.float32)
        self.w = {k: (r.standard_normal((k, EMBED, FILTERS)) / np.sqrt(k * EMBED)).astype(np.float32) for k in WIDTHS}
        self.b = {k: np.zeros(FILTERS, np.float32) for k in WIDTHS}
        self.v = (r.standard_normal((FILTERS * len(WIDTHS), len(classes))) * 0.2).astype(np.float32)
        self.c = np.zeros(len(classes), np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.e, *(self.w[k] for k in WIDTHS), *(self.b[k] for k in WIDTHS), self.v, self.c]

    def step(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross-entropy."""
        n = len(x)
        emb = self.e[x]
        pooled, where = [], {}
        for k in WIDTHS:
            m = WINDOW - k + 1
            z = sum(emb[:, j : j + m] @ self.w[k][j] for j in range(k)) + self.b[k]
            at = z.argmax(1)
            where[k] = at
            pooled.append(np.take_along_axis(z, at[:, None], 1)[:, 0])
        a = np.concatenate(pooled, 1)
        h = np.maximum(a, 0)
        z = h @ self.v + self.c
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        gv, gc = h.T @ p, p.sum(0)
        ga = (p @ self.v.T) * (a > 0)
        ge, gw, gb = np.zeros_like(self.e), {}, {}
        rows = np.arange(n)[:, None]
        for i, k in enumerate(WIDTHS):
            g = ga[:, i * FILTERS : (i + 1) * FILTERS]
            gb[k] = g.sum(0)
            gw[k] = np.zeros_like(self.w[k])
            for j in range(k):
                sym = x[rows, where[k] + j]
                gw[k][j] = np.einsum("nfe,nf->ef", self.e[sym], g)
                np.add.at(ge, sym, g[:, :, None] * self.w[k][j].T[None])
        return [ge, *(gw[k] for k in WIDTHS), *(gb[k] for k in WIDTHS), gv, gc]

    def tables(self) -> "Tables":
        return Tables(self)


class Tables:
    """The trained network for inference: the filters' sums for each pair of symbols."""

    def __init__(self, net: Net):
        self.classes, self.v, self.c = net.classes, net.v, net.c
        one = {k: np.einsum("se,jef->jsf", net.e, net.w[k]) for k in WIDTHS}
        pair = lambda t, u: (t[:, None] + u[None]).reshape(-1, FILTERS)
        # one gather serves the width of 2 and both halves of the width of 4
        self.head = np.concatenate([pair(*one[2]), pair(*one[4][:2])], 1).astype(np.float32)
        self.tail = pair(*one[4][2:]).astype(np.float32)
        self.b2, self.b4 = net.b[2], net.b[4]

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.classes)), np.float32)
        for at in range(0, len(x), 64):
            part = x[at : at + 64].astype(np.int32)
            code = part[:, :-1] * N_SYMBOLS + part[:, 1:]
            head = self.head[code]
            two = head[:, :, :FILTERS].max(1) + self.b2
            four = (head[:, :-2, FILTERS:] + self.tail[code[:, 2:]]).max(1) + self.b4
            z = np.maximum(np.concatenate([two, four], 1), 0) @ self.v + self.c
            z -= z.max(1, keepdims=True)
            out[at : at + 64] = z - np.log(np.exp(z).sum(1, keepdims=True))
        return out


def train(texts: list[str], langs: list[str], per_text: int = 4, epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 7, per_epoch: int = 4000) -> Tables | None:
    """per_text windows from random places of each text; Adam, per_epoch windows an epoch at most."""
    r = np.random.default_rng(seed)
    classes = sorted(set(langs))
    if not classes:
        return None
    xs, ys = [], []
    for t, lang in zip(texts, langs, strict=True):
        w = windows(t.encode())
        w = w[r.choice(len(w), min(per_text, len(w)), replace=False)]
        short = r.random(len(w)) < 0.25  # short texts come padded
        for row in w[short]:
            row[int(r.integers(24, WINDOW)) :] = 0
        xs.append(w)
        ys += [classes.index(lang)] * len(w)
    x, y = np.concatenate(xs), np.array(ys)
    # rare languages count as much as frequent ones
    share = np.bincount(y, minlength=len(classes))
    net = Net(classes, seed)
    mean, square, t = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()], 0
    steps = max(20, min(len(x), per_epoch) // batch)
    weight = (1 / share)[y] / (1 / share)[y].sum()
    for _ in range(epochs):
        for _ in range(steps):
            pick = r.choice(len(x), batch, p=weight)
            t += 1
            for p, g, m, s in zip(net.params(), net.step(x[pick], y[pick]), mean, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return net.tables()


def held_out(doc_id="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_sample(docs: DataFrame, per_language: int, languages: int, excerpt: int) -> tuple[list[str], list[str]]:
    """At most per_language rows of each of the languages most frequent ones; a text of more than three excerpts gives
    three of them."""
    known = docs.where("lang is not null and text is not null").where(~held_out()).select("doc_id", "lang", "text")
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    rank = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30))
    keep = F.lit(False)
    for r in counts:
        keep |= (F.col("lang") == r["lang"]) & (rank < int(min(1.0, 0.9 * per_language / r["count"]) * (1 << 30)) + 1)
    n = F.length("text")
    parts = [F.substring("text", p, F.lit(excerpt)) for p in (F.lit(1), (n / 2).cast("int") - excerpt // 2, n - excerpt)]
    text = F.when(n <= 3 * excerpt, F.col("text")).otherwise(F.concat_ws(" ", *parts))
    rows = known.where(keep).select("lang", text.alias("text")).limit(per_language * max(1, len(counts))).collect()
    rows = sorted((r["lang"], r["text"]) for r in rows)
    rows = [r for r in rows if LETTER.search(r[1])]
    return [t for _, t in rows], [lang for lang, _ in rows]


def fit(docs: DataFrame, per_language: int = 400, languages: int = 200, excerpt: int = 2048) -> Tables | None:
    """The model of the labelled rows that are not held out. The driver holds at most per_language * languages texts of at
    most 3 * excerpt characters."""
    return train(*training_sample(docs, per_language, languages, excerpt))


PREDICTION = "lang_pred string, score double"


def classify(model: Tables | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    if model is None:
        return langs, scores
    able = [i for i, t in enumerate(texts) if t is not None and LETTER.search(t)]
    at = 0
    while at < len(able):  # a bounded number of windows at a time, except for one longer text
        xs, who, size = [], [], 0
        while at < len(able) and (not xs or size < 4096):
            w = windows(texts[able[at]].encode())
            xs.append(w)
            who.append(able[at])
            size += len(w)
            at += 1
        logs = model.log_probs(np.concatenate(xs))
        first = np.concatenate([[0], np.cumsum([len(w) for w in xs])[:-1]])
        mean = np.add.reduceat(logs.astype(np.float64), first, 0) / np.array([len(w) for w in xs])[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for i, row in zip(who, p, strict=True):
            langs[i], scores[i] = model.classes[int(row.argmax())], float(row.max())
    return langs, scores


def predict(docs: DataFrame, model: Tables | None) -> DataFrame:
    """The input's rows with lang_pred and score (which replace columns of those names)."""
    keep = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    small_batches(docs.sparkSession)
    source = docs.select(*[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(keep)])
    names, at = [*keep, "lang_pred", "score"], keep.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size depends on the constants above only

    def work(batches):
        net = shared.value
        for b in batches:
            langs, scores = classify(net, b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)

    from pyspark.sql import types as T

    fields = [T.StructField(c, f.dataType, f.nullable) for c, f in zip(keep, source.schema.fields, strict=True)]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return source.mapInArrow(work, schema)
