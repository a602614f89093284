"""SimHash near-duplicate groups through a Gray-order hierarchical index.

A document's fingerprint has a bit set where over half of its word shingles' hashes have it. Fingerprints link at ``bits``
or fewer differing bits; groups are the connected components of the links.

The index. Distinct fingerprints are factored under *upper nodes*: shared bit patterns under a mask. With the 64 bits cut
in m blocks, two fingerprints within k bits agree on at least m - k whole blocks, so the masks of all choices of m - k
blocks bring every pair together under some node and lose none. m grows with the number of fingerprints, so that a
node stays small. Under a node the fingerprints are sorted by Gray rank, so that neighbours share long runs of bits;
leaves of 64 neighbours, and above them groups of leaves, store the bits that all their members share. The search walks
pairs of groups from the top down, adds up the differences in shared bits and drops a pair of groups as soon as they
exceed k. Nodes with more than ``NODE`` members are factored again under longer masks, by the same argument on the
bits that are still free, before any task has to hold them.

Links leave a node as a spanning forest (one edge a member at most), never as all pairs.

Nodes of the wide index (below) are not factored again: a task holds the fingerprints, 32 bytes each, of one sampled pattern, which
for a group of near copies with fingerprints of their own can be as many as the group has members. Texts and their shingle sets are never
held that way: they are verified in parts of bounded size.

Defined results: null text counts as empty; a text without words has fingerprint zero and links like any other; fewer
words than a shingle make one shingle; repeated rows share a fingerprint; null ids never name a component (it is null
only if every id in it is null); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, map_batches, raw
from .components import components, join_labels
from .words import mix

#: Members above which a node is factored again before it is searched.
NODE = 20_000
#: Parts of a component's fingerprints on their way to its name.
SALTS = 32
#: Most fingerprints whose component is broadcast.
SHARED = 1024
#: Members of a leaf, and leaves of a group.
LEAF, GROUP = 64, 32
#: Nodes up to this size are compared member by member.
FLAT = 512
#: Pairs that are compared at a time.
STEP_PAIRS = 1 << 16
ALL = (1 << 64) - 1


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    w = raw(text or "").lower().split()
    if not w:
        return 0
    hash64 = xxhash.xxh64_intdigest
    if len(w) <= words:
        got = [hash64(b" ".join(w), seed)]
    else:
        line = b" ".join(w)
        size = np.fromiter(map(len, w), np.int64, len(w))
        end = np.cumsum(size + 1) - 1
        got = [hash64(line[i:j], seed) for i, j in zip((end - size)[: 1 - words].tolist(), end[words - 1 :].tolist(), strict=True)]
    bits = np.unpackbits(np.array(got, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(got), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), run, f"id {kind}, fp bigint")


def gray_rank(fp: Column) -> Column:
    """Position of ``fp`` in the reflected Gray sequence, shifted so that signed order is unsigned order."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def masks(free: int, blocks: int, match: int) -> list[int]:
    """The masks of every choice of ``match`` blocks when the set bits of ``free`` are cut in ``blocks`` runs."""
    bits = [i for i in range(64) if free >> i & 1]
    cuts = [bits[len(bits) * b // blocks : len(bits) * (b + 1) // blocks] for b in range(blocks)]
    each = [sum(1 << i for i in c) for c in cuts]
    return [sum(c) for c in combinations(each, match)]


def first_masks(n: int, bits: int) -> list[int]:
    """Masks for ``n`` fingerprints: as few blocks as keep the expected node within FLAT."""
    for match in range(1, bits + 1):
        found = masks(ALL, bits + match, match)
        if n >> min(m.bit_count() for m in found) <= FLAT:
            return found
    return found


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _shared(x: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """For every ``step`` neighbours, the bits that all have and the bits that any has: they share what is equal in both."""
    at = np.arange(0, len(x), step)
    return np.bitwise_and.reduceat(x, at, axis=0), np.bitwise_or.reduceat(x, at, axis=0)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints whose last axis is their words."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def _search(x: np.ndarray, label: np.ndarray, bits: int) -> None:
    """Link the Gray-sorted members (rows of words) of one large node, top down."""
    n = len(x)
    low, high = _shared(x, LEAF)
    glow, ghigh = _shared(low, GROUP)[0], _shared(high, GROUP)[1]

    def near(al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray) -> np.ndarray:
        shared = ~(al ^ ah) & ~(bl ^ bh)
        return np.bitwise_count((al ^ bl) & shared).sum(axis=-1, dtype=np.int32) <= bits

    for g in range(len(glow)):
        for h in g + np.flatnonzero(near(glow[g][None], ghigh[g][None], glow[g:], ghigh[g:])):
            left, right = np.arange(g * GROUP, min((g + 1) * GROUP, len(low))), np.arange(h * GROUP, min((h + 1) * GROUP, len(low)))
            p, q = np.nonzero(near(low[left][:, None], high[left][:, None], low[right][None], high[right][None]))
            p, q = left[p], right[q]
            order = np.flatnonzero(p <= q)
            for i, j in zip(p[order].tolist(), q[order].tolist(), strict=True):
                a, b = slice(i * LEAF, min((i + 1) * LEAF, n)), slice(j * LEAF, min((j + 1) * LEAF, n))
                la, lb = label[a], label[b]
                if la[0] == lb[0] and (la == la[0]).all() and (lb == lb[0]).all():
                    continue  # all in one component already
                r, s = np.nonzero(_apart(x[a][:, None], x[b][None]) <= bits)
                join_labels(label, r + a.start, s + b.start)


def link(node: np.ndarray, x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, least-index member of its group) among rows sorted by (node, Gray rank)."""
    n = len(x)
    start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    size = np.diff(np.r_[start, n])
    label = np.arange(n)
    room = np.repeat(start + size, size) - np.arange(n)  # members from here to the node's end
    room[np.repeat(size > FLAT, size)] = 0
    at = np.flatnonzero(room > 1)
    for d in range(1, int(room.max(initial=0))):
        at = at[room[at] > d]
        if not len(at):
            break
        open_ = at[label[at] != label[at + d]]  # what is connected already needs no comparison, and its pairs are never held
        for k in range(0, len(open_), STEP_PAIRS):
            some = open_[k : k + STEP_PAIRS]
            hit = some[_apart(x[some], x[some + d]) <= bits]
            if len(hit):
                join_labels(label, hit, hit + d)
    for s, k in zip(start[size > FLAT].tolist(), size[size > FLAT].tolist(), strict=True):
        own = np.arange(k)
        _search(x[s : s + k], own, bits)
        label[s : s + k] = own + s
    got = np.flatnonzero(label != np.arange(n))
    return got, label[got]


def _nodes(fps: DataFrame, under: list[int]) -> DataFrame:
    """(fp, mask, pattern): each fingerprint under each of the masks."""
    each = F.explode(F.array(*[F.lit(signed(m)) for m in under])).alias("mask")
    return fps.select("fp", each).withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))


def _edges(nodes: DataFrame, bits: int, order: Column) -> DataFrame:
    """Spanning forests of the links under each node. ``nodes`` has mask, pattern, fp (a long, or bytes)."""
    kind = nodes.schema["fp"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of the node that is still open

        def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts).combine_chunks()
            mask, pattern = (rows.column(c).to_numpy() for c in ("mask", "pattern"))
            node = np.cumsum(np.r_[0, (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])])
            fp = rows.column("fp")
            x = np.frombuffer(b"".join(fp.to_pylist()), "<u8").reshape(len(node), -1) if kind == "binary" else fp.to_numpy().view(np.uint64).reshape(-1, 1)
            u, v = link(node, x, bits)
            return pa.RecordBatch.from_arrays([fp.take(pa.array(u)).combine_chunks(), fp.take(pa.array(v)).combine_chunks()], names=["u", "v"])

        def key(batch: pa.RecordBatch, row: int) -> tuple[int, int]:
            return batch.column(0)[row].as_py(), batch.column(1)[row].as_py()

        for batch in batches:
            if not batch.num_rows:
                continue
            mask, pattern = (batch.column(i).to_numpy() for i in (0, 1))
            other = np.flatnonzero((mask != mask[-1]) | (pattern != pattern[-1]))
            cut_at = int(other[-1]) + 1 if len(other) else 0
            if held and key(held[-1], 0) != key(batch, 0):
                yield flush(held)
                held = []
            if cut_at:
                yield flush([*held, batch.slice(0, cut_at)])
                held = []
            held.append(batch.slice(cut_at))
        if held:
            yield flush(held)

    dealt = nodes.repartition("mask", "pattern").select("mask", "pattern", "fp", order.alias("g"))
    return arrow_map(dealt.sortWithinPartitions("mask", "pattern", "g").select("mask", "pattern", "fp"), run, f"u {kind}, v {kind}")


def links(fps: DataFrame, bits: int = 4) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) that connect exactly what links of ``bits`` connect."""
    under = first_masks(fps.count(), bits)
    nodes = _nodes(fps, under)
    out = None
    while True:
        hot = cut(nodes.groupBy("mask", "pattern").agg(F.count("*").alias("n")).filter(F.col("n") > NODE).select("mask", "pattern"))
        finer = {m: [m | s for s in masks(ALL & ~m, bits + 1, 1)] for m in under}
        if hot.isEmpty() or (ALL.bit_count() - max(m.bit_count() for m in under)) <= 2 * bits:
            found = _edges(nodes, bits, gray_rank(F.col("fp")))
            return found if out is None else out.unionByName(found)
        found = _edges(nodes.join(hot, ["mask", "pattern"], "left_anti"), bits, gray_rank(F.col("fp")))
        out = found if out is None else out.unionByName(found)
        rest = nodes.join(hot, ["mask", "pattern"], "left_semi")
        table = F.create_map(*[x for m, s in finer.items() for x in (F.lit(signed(m)), F.array(*[F.lit(signed(y)) for y in s]))])
        nodes = rest.select("fp", F.explode(table[F.col("mask")]).alias("mask")).distinct()
        nodes = cut(nodes.withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask"))))
        under = sorted({y for s in finer.values() for y in s})


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """(id, fp, component_id) for every row; component_id is the smallest id reachable over links."""
    table = cut(fingerprints(docs, id_col, text_col, words))
    return _named(table, lambda fps: links(fps, bits))


def _named(table: DataFrame, linked: Callable[[DataFrame], DataFrame], *keep: str) -> DataFrame:
    """(id, fp, component_id, columns of ``keep``) from (id, fp, ...) and the links between distinct fingerprints."""
    extra = [F.first(c).alias(c) for c in table.columns if c not in ("id", "fp", *keep)]
    fps = cut(table.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n"), *extra))
    roots = components(linked(fps))
    fps, table = fps.select("fp", "least", "n"), table.select("id", "fp", *keep)
    # Only fingerprints that met another one need a component; the rest are alone with their own documents. A component's
    # fingerprints are many rows of one key where a group is large, so they are salted on the way back.
    met = fps.drop("n").join(roots.withColumnRenamed("node", "fp"), "fp")
    lowest = met.groupBy("root").agg(F.min("least").alias("low")).join(fps.select(F.col("fp").alias("root"), "least"), "root").select("root", F.least("low", "least").alias("component_id"))
    salts = lowest.select("root", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    named = met.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(salts, ["root", "salt"]).select("fp", "component_id")
    named = named.unionByName(lowest.select(F.col("root").alias("fp"), "component_id"))
    by_fp = fps.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n")
    # Fingerprints of more than 1/SHARED of the documents, at most SHARED of them, find their documents where those are read.
    total = fps.agg(F.sum("n")).first()[0] or 0
    common = F.broadcast(by_fp.filter(F.col("n") * SHARED >= total).select("fp", "component_id"))
    settled = table.join(common, "fp").select("id", "fp", "component_id", *keep)
    rest = table.join(common, "fp", "left_anti").join(by_fp.filter(F.col("n") * SHARED < total), "fp").select("id", "fp", "component_id", *keep)
    return settled.unionByName(rest)


# Near copies by similarity: wide fingerprints.

#: Bits of a wide fingerprint; links are sought until a pair at the threshold shares a mask with this probability.
WIDE, RECALL = 256, 0.99
#: Candidates differ in bits up to the average at the threshold and so many standard deviations.
SPREAD = 3
#: Members, and bytes of shingle sets, of a candidate group's part; two parts meet in a task.
PART, PART_BYTES = 20_000, 1 << 26
#: Candidates of a member that are verified at a time.
STEP = 2048


def shingle_digests(text: str | None, words: int = 5) -> list[bytes]:
    """A 16-byte digest of each distinct shingle of a text; none for a text without words."""
    w = raw(text or "").lower().split()
    if not w:
        return []
    line = b" ".join(w)
    digest = xxhash.xxh3_128_digest
    if len(w) <= words:
        return [digest(line)]
    size = np.fromiter(map(len, w), np.int64, len(w))
    end = np.cumsum(size + 1) - 1
    return list({digest(line[i:j]) for i, j in zip((end - size)[: 1 - words].tolist(), end[words - 1 :].tolist(), strict=True)})


def wide_fingerprint(text: str | None, words: int = 5) -> bytes:
    """The 256-bit fingerprint of a text's set of shingles, little-endian words."""
    got = shingle_digests(text, words)
    if not got:
        return bytes(WIDE // 8)
    half = np.frombuffer(b"".join(got), "<u8").reshape(-1, 2)
    more = mix(half * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))
    count = np.zeros(WIDE, np.int64)
    for a in range(0, len(half), 4096):
        both = np.ascontiguousarray(np.concatenate([half[a : a + 4096], more[a : a + 4096]], axis=1)).view(np.uint8)
        count += np.unpackbits(both, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(count * 2 > len(got), bitorder="little").tobytes()


def bit_rate(similarity: float) -> float:
    """Share of fingerprint bits in which two texts of this shingle (Jaccard) similarity differ, on average."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def wide_limit(similarity: float, deviations: float = 1) -> int:
    """Differing bits of texts at this similarity: the average and so many standard deviations."""
    p = bit_rate(similarity)
    return int(WIDE * p + deviations * math.sqrt(WIDE * p * (1 - p)))


def wide_plan(n: int, similarity: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a mask, masks): a mask has so many bits that unrelated fingerprints seldom meet, and there are so many
    masks that a pair at the threshold agrees on one of them with probability ``recall``."""
    size = max(16, math.ceil(math.log2(max(2, n) / 64)))
    agree = (1 - bit_rate(similarity)) ** size
    return size, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def wide_links(fps: DataFrame, similarity: float, recall: float = RECALL) -> DataFrame:
    """Candidate edges (u, v) between distinct fingerprints (fp bytes, w four longs), under sampled masks."""
    size, many = wide_plan(fps.count(), similarity, recall)
    rnd = np.random.default_rng(size)
    under = []
    for k in range(many):
        mask = np.zeros(WIDE, np.uint8)
        mask[rnd.choice(WIDE, size, replace=False)] = 1
        words = np.packbits(mask, bitorder="little").view("<i8").tolist()
        under.append(F.struct(F.lit(k).cast("bigint").alias("mask"), F.xxhash64(*[F.element_at("w", i + 1).bitwiseAND(F.lit(m)) for i, m in enumerate(words)]).alias("pattern")))
    nodes = fps.select("fp", "w", F.explode(F.array(*under)).alias("n")).select("fp", "w", "n.*")
    return _edges(nodes, wide_limit(similarity, SPREAD), gray_rank(F.element_at("w", 1)))


def alike(x: np.ndarray, sets: list[np.ndarray], side: np.ndarray, bits: int, similarity: float) -> tuple[list[int], list[int]]:
    """Edges that connect what pairs within ``bits`` of exact Jaccard ``similarity`` connect; of two sides, only pairs across.

    ``sets`` are sorted. A pair that is connected already is not compared.
    """
    n = len(x)
    size = np.array([len(s) for s in sets], np.int64)
    label = np.arange(n)
    across = side.min() != side.max()
    u: list[int] = []
    v: list[int] = []
    for i in range(n - 1):
        near = i + 1 + np.flatnonzero(_apart(x[i], x[i + 1 :]) <= bits)
        if across:
            near = near[side[near] != side[i]]
        near = near[np.minimum(size[near], size[i]) >= similarity * np.maximum(size[near], size[i]) - 1e-9]
        while True:
            near = near[label[near] != label[i]]
            if not len(near):
                break
            some, near = near[:STEP], near[STEP:]
            each = np.concatenate([sets[j] for j in some.tolist()])
            at = np.minimum(np.searchsorted(sets[i], each), size[i] - 1)
            shared = np.add.reduceat((sets[i][at] == each).astype(np.int64), np.cumsum(size[some]) - size[some])
            hit = some[shared >= similarity * (size[i] + size[some] - shared) - 1e-9]
            if len(hit):
                u += hit.tolist()
                v += [i] * len(hit)
                met = np.unique(np.r_[label[hit], label[i]])
                label[np.isin(label, met)] = met[0]
        if (label == label[0]).all():
            break
    return u, v


def verified(table: DataFrame, fps: DataFrame, found: DataFrame, similarity: float, words: int) -> DataFrame:
    """Edges (u, v) of exact shingle similarity among the groups that the candidate edges ``found`` connect.

    ``table`` has a text for each row number ``at``; ``fps`` names one for each fingerprint. A group's shingle sets come to
    one task, or, where they are more than PART or PART_BYTES, every two of its parts to one.
    """

    def shingle_sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [np.unique(np.frombuffer(b"".join(shingle_digests(t.as_py(), words)), "<u8")[::2]).tobytes() for t in batch.column(2)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.binary())], names=["root", "fp", "set"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u: list[bytes] = []
        v: list[bytes] = []
        held: list[pa.RecordBatch] = []  # the rows of the group that is still open
        open_key = None

        def flush() -> None:
            rows = pa.Table.from_batches(held)
            held.clear()
            fp = rows.column("fp").to_pylist()
            x = np.frombuffer(b"".join(fp), "<u8").reshape(len(fp), -1)
            sets = [np.frombuffer(s.as_buffer(), "<u8") if s.as_buffer().size else np.empty(0, np.uint64) for s in rows.column("set")]
            a, b = alike(x, sets, rows.column("part").to_numpy(), wide_limit(similarity, SPREAD), similarity)
            u.extend(fp[k] for k in a)
            v.extend(fp[k] for k in b)

        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in ("root", "i", "j")], strict=True))
            start = 0
            for end in range(1, len(keys) + 1):
                if end < len(keys) and keys[end] == keys[start]:
                    continue
                if keys[start] != open_key:
                    if held:
                        flush()
                    open_key = keys[start]
                held.append(batch.slice(start, end - start))
                start = end
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])
            u.clear()
            v.clear()
        if held:
            flush()
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])

    roots = components(found)
    members = roots.select(F.col("node").alias("fp"), "root").unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    texts = members.join(fps.select("fp", "at"), "fp").join(table.select("at", "text"), "at").select("root", "fp", "text")
    sets = cut(map_batches(texts, shingle_sets, "root binary, fp binary, set binary"))
    parts = F.ceil(F.greatest(F.count("*") / PART, F.sum(F.length("set")) / PART_BYTES)).cast("int")
    large = sets.groupBy("root").agg(parts.alias("parts")).filter("parts > 1")
    sets = sets.join(F.broadcast(large), "root", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    sets = sets.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    dealt = sets.select("root", "fp", "set", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("root", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "fp", "set")
    # Two parts meet in their own group, where their inner pairs are left out: a part's inner pairs are those of (part, part).
    return arrow_map(dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j"), run, "u binary, v binary")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, fp, component_id): groups of texts that links of at least this shingle similarity connect.

    A fingerprint of 64 bits is too coarse for a similarity of 0.8, at which about ten of its bits differ. Here it has 256,
    and upper nodes are masks of sampled bits instead of all choices of blocks: a pair at the threshold shares one with
    probability RECALL, closer pairs almost surely. Differing bits only find candidates; links are pairs whose sets of
    shingles have this Jaccard similarity exactly. Texts without words are equal to each other and to no other.
    """
    return _similar(docs, id_col, text_col, words, similarity).drop("mark")


def _similar(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """``similar_groups`` with a hash of each row's text (mark), which tells rows of one id apart."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = [wide_fingerprint(t.as_py(), words) for t in batch.column(1)]
        flat = pa.array(np.frombuffer(b"".join(fp), "<i8"))
        w = pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * len(fp) + 1, 4), pa.int32()), flat)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.binary()), w, batch.column(1)], names=["id", "fp", "w", "text"])

    table = map_batches(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), run, f"id {kind}, fp binary, w array<bigint>, text string")
    table = cut(table.withColumns({"at": F.monotonically_increasing_id(), "mark": F.xxhash64("text")}))
    return _named(table.drop("text"), lambda fps: verified(table, fps, wide_links(fps, similarity), similarity, words), "mark")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without the rows whose group of similar texts has a smaller id; rows without an id stay.

    Rows that share an id are judged each by its own text; those that repeat id and text stay or go together.
    """
    gone = _similar(docs, id_col, text_col, words, similarity).filter("id <> component_id").select(F.col("id").alias("_gone"), "mark").distinct()
    return docs.join(gone, (docs[id_col] == gone["_gone"]) & (F.xxhash64(docs[text_col]) == gone["mark"]), "left_anti").select(*[docs[c] for c in docs.columns])
