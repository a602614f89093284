"""Quality classifier from positive and unlabelled texts.

Features of a whole text: shares of byte classes and of the class pairs that follow each other, how much words and lines
repeat, and word lengths. The class prior of the unlabelled texts is estimated from them and the trusted positives alone, by best bin on
held-back rows (the least ratio of unlabelled to positive mass above a score, with a confidence margin, less one standard error). The classifier is a small network trained in numpy on the non-negative unbiased risk of Kiryo et al.: with positives P, unlabelled U and prior p,

    p * loss(P, +) + max(0, loss(U, -) - p * loss(P, -))

where a step whose second term has gone negative climbs it instead of descending. Labels of bad texts are not used at all.

Bounds: at most ``POSITIVES`` trusted positives and ``UNLABELLED`` texts are fitted (the least hashes of their ids); every
text is scored. Defined results: null or empty text scores 0 (it has no content to vouch for); with no positives or no
unlabelled texts to learn from, every other text scores 0.5; repeated rows score alike; labels, language, source and id are
no features; rows without an id are scored, and take no part in training.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .sampling import first_by_hash, fold

#: Rows that are fitted at most.
POSITIVES, UNLABELLED = 3000, 6000
HIDDEN, EPOCHS, RATE, DECAY, SEED = 16, 400, 0.01, 1e-3, 11
#: From this score on a text is predicted to be good.
THRESHOLD = 0.3

_CLASS = np.zeros(256, np.int64)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 8 if _b >= 128 else 0 if _c == " " else 1 if _c in "\n\r" else 2 if _c.islower() else 3 if _c.isupper() else 4 if _c.isdigit() else 5 if _c in ".,;:?'\"()-" else 6 if _c == "!" else 7 if _c in "|" else 9
CLASSES = 10
N_FEATURES = 2 * CLASSES + CLASSES * CLASSES + 7


def features(text: str | None) -> np.ndarray:
    raw = (text or "").encode()
    out = np.zeros(N_FEATURES, np.float32)
    if not raw:
        return out
    c = _CLASS[np.frombuffer(raw, np.uint8)]
    share = np.bincount(c, minlength=CLASSES) / len(c)
    pairs = np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES) / max(1, len(c) - 1)
    words = raw.split()
    n = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    again = sum(x == y for x, y in zip(words, words[1:], strict=False)) / n
    top = max(Counter(words).values(), default=0) / n
    distinct = len(set(words)) / n
    out[:CLASSES] = share
    out[CLASSES : 2 * CLASSES] = np.sqrt(share)
    out[2 * CLASSES : -7] = np.sqrt(pairs)
    out[-7:] = [np.log1p(len(words)) / 8, distinct * np.log1p(n) / 8, again, top, len(raw) / n / 10, 1 - len(set(lines)) / max(1, len(lines)), min(1.0, again * 4)]
    return out


class Net:
    """One hidden layer on standardised features; logistic score."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: float):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2 = mean, scale, w1, b1, w2, b2

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int = SEED) -> Net:
    """prior None: plain positive-against-unlabelled scores, for estimating the prior."""
    rnd = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-2
    x = np.clip((both - mean) / scale, -6, 6)
    is_p = np.arange(len(x)) < len(positive)
    n_p, n_u = int(is_p.sum()), int((~is_p).sum())
    w1, b1 = rnd.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN)
    w2, b2 = rnd.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)
    params = [w1, b1, w2, b2]
    m, v = [np.zeros_like(a) for a in params], [np.zeros_like(a) for a in params]
    for t in range(1, EPOCHS + 1):
        h = np.tanh(x @ w1 + b1)
        g = h @ w2 + b2
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        down = np.logaddexp(0, g)  # loss of a text taken as bad
        if prior is None:
            d = np.where(is_p, (s - 1) / n_p, s / n_u)
        else:
            rest = down[~is_p].mean() - prior * down[is_p].mean()
            sign = 1.0 if rest >= 0 else -1.0
            d = np.where(is_p, (sign > 0) * prior * (s - 1) / n_p - sign * prior * s / n_p, sign * s / n_u)
        dh = np.outer(d, w2) * (1 - h * h)
        grads = [x.T @ dh + DECAY * w1, dh.sum(axis=0), h.T @ d + DECAY * w2, np.array([d.sum()])]
        for i, (p, gr) in enumerate(zip(params, grads, strict=True)):
            m[i] = 0.9 * m[i] + 0.1 * gr
            v[i] = 0.999 * v[i] + 0.001 * gr**2
            p -= RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Net(mean, scale, w1, b1, w2, float(b2[0]))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Best-bin estimate of the share of good texts among the unlabelled, from scores of rows the scorer was not fitted on.

    The ratio bounds the share from above, so one standard error is taken off.
    """
    half_p, half_u = np.arange(len(positive)) % 2 == 0, np.arange(len(unlabelled)) % 2 == 0
    if half_p.sum() < 20 or half_u.sum() < 20:
        return 0.5
    net = fit(positive[half_p], unlabelled[half_u], None)
    p, u = np.sort(net.margin(positive[~half_p])), np.sort(net.margin(unlabelled[~half_u]))
    margin = 0.5 * (np.sqrt(np.log(40) / (2 * len(p))) + np.sqrt(np.log(40) / (2 * len(u))))
    cut = p
    q_p = 1 - np.searchsorted(p, cut, "left") / len(p)
    q_u = 1 - np.searchsorted(u, cut, "left") / len(u)
    best = np.argmin((q_u + margin) / np.maximum(q_p, 1e-9))
    share = q_u[best] / q_p[best]
    return float(np.clip(share - np.sqrt(max(0.0, share * (1 - share)) / len(p)), 0.05, 0.95))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held_out: int = 0) -> Net:
    """Fit on trusted positives and unlabelled texts whose fold is not the held-out one."""
    trainable = fold(id_col, folds) != held_out
    positive = first_by_hash(labels.filter((F.col(label_col) == 1) & trainable).select(id_col).distinct(), id_col, POSITIVES).withColumn("p", F.lit(True))
    unlabelled = first_by_hash(docs.filter(trainable).select(id_col), id_col, UNLABELLED).distinct().withColumn("p", F.lit(False))
    chosen = positive.unionByName(unlabelled)
    texts = docs.select(id_col, F.col(text_col).alias("t")).join(F.broadcast(chosen), id_col).select("p", "t")  # at most POSITIVES + UNLABELLED ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], names=["p", "f"])

    got = arrow_map(texts, run, "p boolean, f binary").toPandas().sort_values(["p", "f"])  # an order of their own: tasks end in any order
    x = np.stack([np.frombuffer(f, np.float32) for f in got["f"]]) if len(got) else np.empty((0, N_FEATURES), np.float32)
    p = got["p"].to_numpy(bool)
    if not p.any() or p.all():
        return Net(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros((N_FEATURES, 1)), np.zeros(1), np.zeros(1), 0.0)
    rnd = np.random.default_rng(SEED)
    positive, unlabelled = rnd.permutation(x[p]), rnd.permutation(x[~p])
    return fit(positive, unlabelled, estimate_prior(positive, unlabelled))


def _scores(net: Net, texts: pa.Array) -> np.ndarray:
    x = np.stack([features(t.as_py()) for t in texts])
    return np.where(x.any(axis=1), net.score(x), 0.0)


def score(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(net, batch.column(1)))], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), run, f"id {kind}, score double")


def keep_good(docs: DataFrame, net: Net, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_scores(net, batch.column(batch.schema.get_field_index(text_col))) >= threshold))

    return arrow_map(docs, run, docs.schema)
