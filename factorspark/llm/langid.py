"""Language identification by a byte convolutional network in numpy.

A text's UTF-8 bytes (A-Z in lower case, what is no letter as one blank) are cut in windows of ``WINDOW`` bytes, the last
one padded. Filters of widths 2, 3 and 4 run over each window; a filter is a table of weights for each byte value at each
of its places. Max pooling over the window, a rectifier and a softmax layer give a distribution over languages; a
text's is the mean of its windows' logits, weighted by their letters. Training is plain gradient descent with the
gradient going to the place each maximum came from.

At inference the places of a filter are merged in tables over byte pairs, so that a width-4 filter costs two look-ups.

Bounds: at most ``DOCUMENTS`` texts a language are fitted (the least hashes of their ids), ``WINDOWS`` windows of each;
every window of every text is read to predict. Defined results: null text or text without a letter is ``und`` with score
0, and so is every text where there is nothing to learn from; ties go to the language first in order; repeated rows get equal
results; rows without an id are predicted, and take no part in training.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map
from .sampling import fold

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 12
DOCUMENTS, WINDOWS = 400, 4
EPOCHS, BATCH, RATE, SEED = 12, 128, 0.01, 5
#: Range of the places that ids are hashed to.
RANGE = 1 << 40
#: Windows that are taken together at inference.
TOGETHER = 256
#: Slope of the rectifier below zero.
LEAK = 0.01
UNDETERMINED = "und"

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(windows, letters of each); only windows with letters."""
    raw = _FOLD[np.frombuffer(text.encode(), np.uint8)]
    n = -(-len(raw) // WINDOW)
    out = np.full(n * WINDOW, 0x20, np.uint8)
    out[: len(raw)] = raw
    out = out.reshape(n, WINDOW)
    letters = (out != 0x20).sum(axis=1)
    return out[letters > 0], letters[letters > 0]


def rectified(x: np.ndarray) -> np.ndarray:
    """What a filter passes on, in training and in use alike."""
    return np.maximum(x, LEAK * x)


class Net:
    def __init__(self, names: list[str], tables: list[np.ndarray], bias: np.ndarray, dense: np.ndarray, offset: np.ndarray):
        self.names, self.tables, self.bias, self.dense, self.offset = names, tables, bias, dense, offset

    def pairs(self) -> list[list[np.ndarray]]:
        """For each width, look-up tables over byte pairs, and one over single bytes where the width is odd."""
        out = []
        for t in self.tables:
            t = t.astype(np.float32)
            own = [(t[i][:, None, :] + t[i + 1][None, :, :]).reshape(65536, -1) for i in range(0, len(t) - 1, 2)]
            out.append([*own, t[-1]] if len(t) % 2 else own)
        return out

    def logits(self, x: np.ndarray, pairs: list[list[np.ndarray]]) -> np.ndarray:
        """(windows, languages)."""
        out = []
        for a in range(0, len(x), TOGETHER):
            part = x[a : a + TOGETHER].astype(np.int32)
            pair = part[:, :-1] << 8 | part[:, 1:]
            pooled = []
            for width, own in zip(WIDTHS, pairs, strict=True):
                n = WINDOW - width + 1
                total = own[0][pair[:, :n]]
                if width % 2:
                    total += own[1][part[:, width - 1 :]]
                elif width == 4:
                    total += own[1][pair[:, 2 : 2 + n]]
                pooled.append(total.max(axis=1))
            h = rectified(np.concatenate(pooled, axis=1) + self.bias)
            out.append(h @ self.dense + self.offset)
        return np.concatenate(out) if out else np.empty((0, len(self.names)))


def train(x: np.ndarray, y: np.ndarray, names: list[str]) -> Net:
    rnd = np.random.default_rng(SEED)
    tables = [rnd.normal(0, 0.1, (w, 256, FILTERS)) for w in WIDTHS]
    bias, dense, offset = np.zeros(FILTERS * len(WIDTHS)), rnd.normal(0, 0.3, (FILTERS * len(WIDTHS), len(names))), np.zeros(len(names))
    params = [*tables, bias, dense, offset]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    t = 0
    for _ in range(EPOCHS):
        order = rnd.permutation(len(x))
        for a in range(0, len(x), BATCH):
            pick = order[a : a + BATCH]
            part, t = x[pick].astype(np.int64), t + 1
            pooled, where = [], []
            for width, tab in zip(WIDTHS, tables, strict=True):
                n = WINDOW - width + 1
                total = sum(tab[i][part[:, i : i + n]] for i in range(width))
                best = total.argmax(axis=1)
                where.append(best)
                pooled.append(np.take_along_axis(total, best[:, None], 1)[:, 0])
            pre = np.concatenate(pooled, axis=1) + bias
            h = rectified(pre)
            z = h @ dense + offset
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            p /= len(pick)
            dh = (p @ dense.T) * np.where(pre > 0, 1.0, LEAK)
            grads = []
            for k, (width, best) in enumerate(zip(WIDTHS, where, strict=True)):
                g = np.zeros((width, 256, FILTERS))
                own = dh[:, k * FILTERS : (k + 1) * FILTERS]
                for i in range(width):
                    at = np.take_along_axis(part, best + i, 1) * FILTERS + np.arange(FILTERS)
                    g[i] = np.bincount(at.ravel(), own.ravel(), 256 * FILTERS).reshape(256, FILTERS)
                grads.append(g)
            grads += [dh.sum(axis=0), h.T @ p, p.sum(axis=0)]
            for i, (param, g) in enumerate(zip(params, grads, strict=True)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                param -= RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Net(names, tables, bias, dense, offset)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held_out: int = 1) -> Net:
    """Fit on texts with a language whose fold is not the held-out one."""
    rows = docs.filter((fold(id_col, folds) != held_out) & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"))
    # The least hashes of each language: a threshold from its count leaves about four times as many as wanted, so that
    # ranking is over few rows however many a language has.
    counts = F.broadcast(rows.groupBy("l").agg(F.count("*").alias("n")))  # a row a language
    place = F.pmod(F.xxhash64("i"), F.lit(RANGE))
    few = rows.join(counts, "l").filter(place.cast("double") * F.col("n") < F.lit(4.0 * DOCUMENTS * RANGE))
    order = Window.partitionBy("l").orderBy(place, F.xxhash64("i"), "i")
    chosen = few.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= DOCUMENTS).select("i", "l").distinct()
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "i").select("i", "l", "t")  # DOCUMENTS ids a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            l, x = [], []
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own, letters = windows(text or "")
                for k in np.argsort(-letters, kind="stable")[:WINDOWS].tolist():
                    l.append(lang)
                    x.append(own[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(l, pa.string()), pa.array(x, pa.binary())], names=["l", "x"])

    got = arrow_map(texts, run, "l string, x binary").toPandas().sort_values(["l", "x"])
    if not len(got):
        return Net([], [], np.empty(0), np.empty((0, 0)), np.empty(0))
    names = sorted(got["l"].unique())
    return train(np.stack([np.frombuffer(b, np.uint8) for b in got["x"]]), np.array([names.index(l) for l in got["l"]]), names)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = net.pairs()
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [t or "" for t in part.column(1).to_pylist()]
                cut = [windows(t) if net.names and has_letter(t) else (np.empty((0, WINDOW), np.uint8), np.empty(0, np.int64)) for t in texts]
                n = np.array([len(x) for x, _ in cut])
                z = net.logits(np.concatenate([x for x, _ in cut]), pairs) if n.any() else np.empty((0, len(net.names)))
                letters = np.concatenate([w for _, w in cut])
                lang, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
                some = np.flatnonzero(n)
                if len(some):
                    first = (np.cumsum(n) - n)[some]
                    mean = np.add.reduceat(z * letters[:, None], first, axis=0) / np.add.reduceat(letters, first)[:, None]
                    p = np.exp(mean - mean.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    for i, k in zip(some.tolist(), p.argmax(axis=1).tolist(), strict=True):
                        lang[i] = net.names[k]
                    for i, q in zip(some.tolist(), p.max(axis=1).tolist(), strict=True):
                        score[i] = q
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["id", "lang", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), run, f"id {kind}, lang string, score double")
