"""Benchmark decontamination: passages within a small edit distance of a benchmark item, found through CGK embeddings.

Texts and items are strings of words (runs of letters and digits, lower case); an item is in a document if some passage
is within ``floor((1 - similarity) * words of the item)`` word edits of it.

1. Sound filter. ``k`` edits destroy at most ``q * k`` of an item's word q-grams, so only windows that hold at least
   ``n - q + 1 - q * k`` q-grams of the benchmark can match, for the n of a class that asks least (the bound falls where n
   passes a multiple of 5, so that need not be its shortest item). It drops no match; it leaves about the contaminated passages.
2. Candidates. The remaining item-sized windows are embedded by the random walk of Chakraborty, Goldenberg and Koucky:
   at step j the walk writes its current word and moves on if a random bit for (j, word) says so, which turns edit
   distance into Hamming distance. ``REPEATS`` walks, each with ``SAMPLED`` sampled positions, are the hash tables of a
   bit-sampling LSH; an item and a window that agree on one table's samples are a candidate. Items are taken in classes
   of similar size, and a class's samples lie where its shortest item still has words.
3. Verification. Word-level edit distance of each candidate to the best end of its window, exactly.

Items are small next to documents: they travel to the tasks in blocks of ``ITEMS``, one pass over the texts a block. A benchmark of k blocks
costs k passes.

Defined results: null or word-less items and texts match nothing; equal items match separately; repeated rows give
repeated results; a document and an item give one row, for the passage that agrees with the item in most tables
if that is near enough, else for the one with the fewest edits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow_map
from .words import hash_words, letters, mix

#: Walks (hash tables), and samples of each.
REPEATS, SAMPLED = 32, 2
#: Items that a task holds at a time.
ITEMS = 50_000
#: Bytes of text that are taken together.
CHUNK = 1 << 21
#: Items of fewer words are filtered by single words, others by word triples.
SHORT = 10
PAD = np.uint64(0)

_LETTERS = letters(np.array([chr(b).isalnum() if b < 128 else True for b in range(256)]))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of every text, number of words of each text)."""
    raw = [(t or "").lower().encode() for t in texts]
    buf = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    if not len(buf):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    h, start, _ = hash_words(buf, _LETTERS)
    stop = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
    return h | np.uint64(1), np.diff(np.r_[0, np.searchsorted(start, stop)])  # odd: never PAD


def grams(h: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the word q-grams at every start (the last q - 1 starts have none)."""
    if q == 1:
        return h
    if len(h) < q:
        return np.empty(0, np.uint64)
    m = len(h) - q + 1
    return mix(sum(h[i : i + m] * np.uint64(2 * i + 0x51ED270B) for i in range(q)))


@dataclass
class Class:
    """Items of similar size, ready to be looked up."""

    low: int
    high: int
    sizes: list[int]  # distinct numbers of words of its items
    steps: int
    salt: np.ndarray  # (steps, REPEATS)
    samples: np.ndarray  # (REPEATS, SAMPLED), steps at which words are taken
    keys: np.ndarray  # sorted bucket keys
    owner: np.ndarray  # item of each key


class Index:
    """A block of items: their q-grams, and hash tables of their embeddings."""

    def __init__(self, items: list[tuple[object, str | None]], similarity: float = 0.8):
        h, counts = word_hashes([t for _, t in items])
        parts = np.split(h, np.cumsum(counts)[:-1]) if len(items) else []
        kept = [(i, w) for (i, _), w in zip(items, parts, strict=True) if len(w)]
        self.names = [i for i, _ in kept]
        self.words = [w for _, w in kept]
        self.slack = 1 - similarity
        self.classes: dict[int, list[Class]] = {1: [], 3: []}
        self.gram: dict[int, np.ndarray] = {}
        self.bloom: dict[int, np.ndarray] = {}
        size = np.array([len(w) for w in self.words], np.int64)
        low = 1
        while low <= size.max(initial=0):
            high = max(low, min(int(low * 1.5), SHORT - 1)) if low < SHORT else int(low * 1.5)
            mine = np.flatnonzero((size >= low) & (size <= high))
            if len(mine):
                self.classes[1 if low < SHORT else 3].append(self._class(mine, int(size[mine].min()), int(size[mine].max())))
            low = high + 1
        for q, own in self.classes.items():
            if own:
                few = [w for w in self.words if (len(w) < SHORT) == (q == 1)]
                self.gram[q] = np.unique(np.concatenate([grams(w, q) for w in few]))
                table = np.zeros(1 << 22, bool)
                table[self.gram[q] >> np.uint64(42)] = True
                self.bloom[q] = table

    def edits(self, n: int) -> int:
        return int(n * self.slack + 1e-9)

    def _class(self, mine: np.ndarray, low: int, high: int) -> Class:
        rnd = np.random.default_rng(low)
        steps = max(SAMPLED, 2 * low - low // 2)
        samples = np.stack([np.sort(rnd.choice(steps, SAMPLED, replace=False)) for _ in range(REPEATS)])
        salt = rnd.integers(0, 1 << 63, (steps, REPEATS), dtype=np.uint64)
        made = Class(low, high, sorted({len(self.words[i]) for i in mine}), steps, salt, samples, np.empty(0, np.uint64), np.empty(0, np.int64))
        flat = np.concatenate([np.r_[self.words[i], np.full(steps, PAD)] for i in mine])
        long = np.array([len(self.words[i]) + steps for i in mine])
        start = np.cumsum(long) - long
        keys = embed(made, flat, start, start + long)
        owner = np.repeat(mine, REPEATS)
        order = np.argsort(keys.reshape(-1), kind="stable")
        made.keys, made.owner = keys.reshape(-1)[order], owner[order]
        return made


def embed(c: Class, h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """(windows, REPEATS) bucket keys: each walk from ``start``, reading PAD from ``stop`` on."""
    h = np.append(h, PAD)
    at = np.repeat(start[:, None], REPEATS, axis=1)
    key = np.tile(np.arange(REPEATS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(start), 1))
    taken = np.zeros((c.steps, REPEATS), bool)
    taken[c.samples.T, np.arange(REPEATS)] = True
    for j in range(int(c.samples.max()) + 1):
        word = np.where(at < stop[:, None], h[np.minimum(at, len(h) - 1)], PAD)
        if taken[j].any():
            r = np.flatnonzero(taken[j])
            key[:, r] = mix(key[:, r] * np.uint64(0xBF58476D1CE4E5B9) ^ word[:, r])
        at += ((word ^ c.salt[j]) * np.uint64(0x94D049BB133111EB) >> np.uint64(63)).astype(np.int64)
    return key


def edit_distances(a: list[np.ndarray], b: list[np.ndarray], limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair: least word edits between a[i] and a prefix of b[i], and that prefix's length; limit[i] + 1 if over the limit.

    Only the diagonals within the largest limit are computed, and pairs are dropped once no cell of a row is within theirs.
    """
    m, band = len(a), int(limit.max())
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    long = int(la.max())
    left = np.zeros((m, long), np.uint64)
    right = np.full((m, long + 2 * band + 1), np.uint64(2))  # words have odd hashes: 2 equals none
    for i in range(m):
        left[i, : la[i]] = a[i]
        right[i, band : band + lb[i]] = b[i][: right.shape[1] - band]
    d = np.arange(2 * band + 1, dtype=np.int32)
    far = np.int32(1 << 20)
    row = np.tile(np.where(d >= band, d - band, far), (m, 1))
    edits, end, live = limit.astype(np.int64) + 1, np.zeros(m, np.int64), np.arange(m)
    for i in range(1, long + 1):
        step = row + (left[live, i - 1 : i] != right[live, i - 1 : i + 2 * band])
        step[:, :-1] = np.minimum(step[:, :-1], row[:, 1:] + 1)
        row = np.minimum(np.minimum.accumulate(step - d, axis=1) + d, far)
        done = la[live] == i
        if done.any():
            at = live[done]
            final = np.where((i + d - band)[None] <= lb[at][:, None], row[done], far)
            best = final.argmin(axis=1)
            got = final[np.arange(len(at)), best]
            good = got <= limit[at]
            edits[at[good]], end[at[good]] = got[good], i + d[best[good]] - band
        if done.any() or i % 8 == 0:
            keep = ~done & (row.min(axis=1) <= limit[live])
            row, live = row[keep], live[keep]
            if not len(live):
                break
    return edits, end


def find(index: Index, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, first word, words, edits) of each text's best passage near each item."""
    h, counts = word_hashes(texts)
    n = len(h)
    if not n or not index.names:
        return []
    stop_of = np.cumsum(counts)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for q, classes in index.classes.items():
        if not classes:
            continue
        g = grams(h, q)
        hit = index.bloom[q][g >> np.uint64(42)]
        some = np.flatnonzero(hit)
        table = index.gram[q]
        exact = table[np.minimum(np.searchsorted(table, g[some]), len(table) - 1)] == g[some]
        hit = np.zeros(n + 1, np.int64)
        hit[some[exact] + 1] = 1
        count = np.cumsum(hit)  # hits before each start
        if not count[-1]:
            continue
        for c in classes:
            need = max(1, min(n - (q - 1) - q * index.edits(n) for n in c.sizes))
            reach = c.high + index.edits(c.high)
            last = np.minimum(np.arange(n) + reach, n)
            start = np.flatnonzero(count[last] - count[:n] >= need)
            if not len(start):
                continue
            stop = stop_of[np.searchsorted(stop_of, start, side="right")]
            inside = count[np.minimum(start + reach, stop)] - count[start] >= need  # within the same text
            start, stop = start[inside], stop[inside]
            for a in range(0, len(start), 20_000):
                _candidates(index, c, h, start[a : a + 20_000], stop[a : a + 20_000], stop_of, best)
    first = stop_of - counts
    return [(t, i, s - int(first[t]), length, e) for (t, i), (e, s, length) in sorted(best.items())]


def _candidates(index: Index, c: Class, h: np.ndarray, start: np.ndarray, stop: np.ndarray, stop_of: np.ndarray, best: dict) -> None:
    keys = embed(c, h, start, stop).reshape(-1)
    lo, hi = np.searchsorted(c.keys, keys, "left"), np.searchsorted(c.keys, keys, "right")
    found = hi - lo
    at = np.flatnonzero(found)
    if not len(at):
        return
    each = found[at]
    pos = np.repeat(lo[at] - np.cumsum(each) + each, each) + np.arange(int(each.sum()))
    window, item = np.repeat(at // REPEATS, each), c.owner[pos]
    text = np.searchsorted(stop_of, start[window], side="right")
    pairs, tables = np.unique(np.stack([text, item, window], axis=1), axis=0, return_counts=True)
    # The window of a text that agrees with an item in most tables is tried first; others only where that one fails.
    order = np.lexsort((pairs[:, 2], -tables, pairs[:, 1], pairs[:, 0]))
    pairs = pairs[order]
    first = np.r_[True, (pairs[1:, :2] != pairs[:-1, :2]).any(axis=1)]
    _verify(index, h, start, stop, pairs[first], stop_of, best)
    rest = pairs[~first]
    _verify(index, h, start, stop, rest[[(t, i) not in best for t, i in rest[:, :2].tolist()]], stop_of, best)


def _verify(index: Index, h: np.ndarray, start: np.ndarray, stop: np.ndarray, pairs: np.ndarray, stop_of: np.ndarray, best: dict) -> None:
    for a in range(0, len(pairs), 4096):
        part = pairs[a : a + 4096]
        items = [index.words[i] for i in part[:, 1].tolist()]
        limit = np.array([index.edits(len(w)) for w in items])
        spans = [h[s : min(s + len(w) + k, e)] for s, e, w, k in zip(start[part[:, 2]].tolist(), stop[part[:, 2]].tolist(), items, limit.tolist(), strict=True)]
        edits, length = edit_distances(items, spans, limit)
        for p in np.flatnonzero(edits <= limit).tolist():
            key = int(part[p, 0]), int(part[p, 1])
            got = int(edits[p]), int(start[part[p, 2]]), int(length[p])
            if key not in best or got < best[key]:
                best[key] = got


def chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) in pieces of about CHUNK bytes; a longer text is a piece of its own."""
    first, size, held = 0, 0, []
    for k, text in enumerate(batch.column(column)):
        text = text.as_py()
        held.append(text)
        size += len(text or "")
        if size >= CHUNK:
            yield first, held
            first, size, held = k + 1, 0, []
    if held:
        yield first, held


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[object, str | None]]]:
    """The items in bounded blocks, streamed through the driver."""
    held = []
    for row in items.select(items[id_col].alias("i"), items[text_col].alias("t")).toLocalIterator():
        held.append((row["i"], row["t"]))
        if len(held) == ITEMS:
            yield held
            held = []
    if held:
        yield held


#: Indexes stay with the worker process from task to task; only the last few are kept.
_INDEXES: dict[int, Index] = {}


def _index(token: int, block: list, similarity: float) -> Index:
    if token not in _INDEXES:
        while len(_INDEXES) > 3:
            _INDEXES.pop(next(iter(_INDEXES)))
        _INDEXES[token] = Index(block, similarity)
    return _INDEXES[token]


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = 0.8) -> DataFrame:
    """(id, item_id, first_word, n_words, edits): a row for each document and item that it holds."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    item_arrow = to_arrow_type(items.schema[item_id].dataType)  # ids of items may be of any type
    schema = f"id {kind}, item_id {item_kind}, first_word bigint, n_words bigint, edits int"
    out = None
    for block in item_blocks(items, item_id, item_text):
        shared, key = spark.sparkContext.broadcast(block), uuid.uuid4().int

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            index = _index(key, shared.value, similarity)
            for batch in batches:
                for first, texts in chunks(batch, 1):
                    if got := find(index, texts):
                        text, item, start, length, edits = (list(x) for x in zip(*got, strict=True))
                        ids = batch.column(0).take(pa.array([first + t for t in text]))
                        yield pa.RecordBatch.from_arrays([ids, pa.array([index.names[i] for i in item], item_arrow), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(edits, pa.int32())], names=["id", "item_id", "first_word", "n_words", "edits"])

        part = arrow_map(rows, run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that hold no item, in one pass without a shuffle."""
    spark = docs.sparkSession
    out = docs
    for block in item_blocks(items, item_id, item_text):
        shared, key = spark.sparkContext.broadcast(block), uuid.uuid4().int

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            index = _index(key, shared.value, similarity)
            for batch in batches:
                at = batch.schema.get_field_index(text_col)
                clean = np.ones(batch.num_rows, bool)
                for first, texts in chunks(batch, at):
                    clean[[first + t for t, *_ in find(index, texts)]] = False
                yield batch.filter(pa.array(clean))

        out = arrow_map(out, run, docs.schema)
    return out
