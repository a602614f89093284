"""Exact dedup, SimHash groups, token-id files and BPE against brute force, on small tables with awkward rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from factorspark.llm import bpe, components, exact_dedup, simhash, token_ids

SCHEMA = "doc_id bigint, text string, n bigint, id string"
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "a b c"), (5, "abc "), (5, "abc "), (6, "abc"), (None, "abc"), (7, "x" * 50_000 + " y"), (8, "Éß 漢字   z"), (9, "a\x1cb c"),
    (10, "don't  stop\n\nNOW <|endoftext|> ok"), (11, "line\nline two "), (None, None), (12, "Σ ΑΣ"),
]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 0, "x") for i, t in rows], SCHEMA).repartition(parts)


def big(seed=0, n=400):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["th", "er", "on", "an", "re"]) for _ in range(rnd.randint(1, 4)))
    base = [" ".join(word() for _ in range(rnd.randint(1, 90))) for _ in range(n // 4)]
    rows = []
    for i in range(n):
        w = rnd.choice(base).split(" ")
        if rnd.random() < 0.4:
            w[rnd.randrange(len(w))] = word()
        rows.append((i, rnd.choice([" ", "  ", "\n"]).join(w) if rnd.random() < 0.2 else " ".join(w)))
    return rows + [(n + i, base[0]) for i in range(n // 2)] + [(2 * n + i, t) for i, t in ODD if i is not None]


def want_exact(rows):
    group = {}
    for i, t in rows:
        group.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((i, t or ""))
    out = []
    for g in group.values():
        best = min(g, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        out += [(i, best[0], len(g)) for i, _ in g]
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [ODD, big(), []])
def test_exact_decisions(spark, rows):
    got = exact_dedup.decisions(frame(spark, rows)).collect()
    assert sorted(((r["id"], r["keep_id"], r["group_size"]) for r in got), key=str) == want_exact(rows)
    kept = [r["digest"] for r in got if r["kept"]]
    assert len(kept) == len(set(kept)) == len({bytes(r["digest"]) for r in got})


@pytest.mark.parametrize("rows", [ODD, big(), []])
def test_exact_keep_one(spark, rows):
    df = frame(spark, rows)
    got = exact_dedup.keep_one(df)
    assert got.columns == df.columns
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    keep = {norm(t): k for (i, t) in rows for (j, k, _) in want_exact(rows) if j == i}
    found = got.collect()
    assert sorted(norm(r["text"]) for r in found) == sorted({norm(t) for _, t in rows})
    assert len(keep) == len(found)


def brute_fingerprint(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_groups(fps, bits):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= bits:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("rows", [ODD, big(3, 240), []])
def test_simhash_groups(spark, rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    groups = brute_groups(fps, 4)
    least = {}
    for (i, _), g in zip(rows, groups, strict=True):
        least[g] = min(least.get(g, np.inf), np.inf if i is None else i)
    want = sorted(((i, f, None if least[g] == np.inf else least[g]) for (i, _), f, g in zip(rows, fps, groups, strict=True)), key=str)
    got = simhash.groups(frame(spark, rows)).collect()
    assert sorted(((r["id"], r["fp"] % (1 << 64), r["component_id"]) for r in got), key=str) == want


@pytest.mark.parametrize("n,spread", [(700, 6), (3000, 12), (3000, 30)])
def test_large_nodes_are_searched_whole(n, spread):
    rnd = np.random.default_rng(n + spread)
    x = np.zeros(n, np.uint64)
    for b in rnd.choice(64, spread, replace=False):
        x |= rnd.integers(0, 2, n).astype(np.uint64) << np.uint64(b)
    gray = lambda v: sum(((int(v) >> s).bit_count() & 1) << s for s in range(64))
    x = np.array(sorted(set(x.tolist()), key=gray), np.uint64)
    label = np.arange(len(x))
    simhash._search(x[:, None], label, 2)
    near = np.bitwise_count(x[:, None] ^ x[None]) <= 2
    want, old = np.arange(len(x)), None
    while old is None or (want != old).any():
        old, want = want, np.where(near, want[None], len(x)).min(axis=1)
    assert (label == want).all()


def test_hot_nodes_are_factored_again(spark, monkeypatch):
    rnd = np.random.default_rng(1)
    base = int(rnd.integers(0, 1 << 62))
    fps = sorted({base ^ (1 << int(rnd.integers(64))) ^ (1 << int(rnd.integers(64))) ^ (1 << int(rnd.integers(64))) for _ in range(400)})
    monkeypatch.setattr(simhash, "NODE", 60)
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp bigint")
    got = {r["node"]: r["root"] for r in components.components(simhash.links(df, 4)).collect()}
    groups = brute_groups(fps, 4)
    mine = [got.get(simhash.signed(f), simhash.signed(f)) for f in fps]
    pairs = lambda g: {tuple(sorted(map(str, k))) for k in [[f for f, y in zip(fps, g, strict=True) if y == x] for x in set(g)]}
    assert pairs(mine) == pairs(groups)


def test_masks_lose_no_pair():
    rnd = random.Random(4)
    for n in (10, 10**8, 10**10, 10**14):
        under = simhash.first_masks(n, 4)
        for _ in range(300):
            x = rnd.getrandbits(64)
            y = x
            for b in rnd.sample(range(64), 4):
                y ^= 1 << b
            assert any(x & m == y & m for m in under)


@pytest.mark.parametrize("share", [1 << 19, 100, 7])
def test_long_chains_settle(spark, monkeypatch, share):
    monkeypatch.setattr(components, "SHARE", share)
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "u bigint, v bigint").repartition(5)
    assert {(r["node"], r["root"]) for r in components.components(edges).collect()} == {(i, 0) for i in range(1, 301)}


@pytest.mark.parametrize("share", [1 << 19, 40])
def test_components_against_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(components, "SHARE", share)
    rnd = random.Random(7)
    name = [bytes([rnd.randrange(256) for _ in range(3)]) for _ in range(150)]
    pairs = [(rnd.randrange(150), rnd.randrange(150)) for _ in range(90)] + [(5, 5)]
    root = list(range(150))
    for _ in range(150):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b], key=name.__getitem__)
    df = spark.createDataFrame([(name[a], name[b]) for a, b in pairs], "u binary, v binary").repartition(4)
    got = {bytes(r["node"]): bytes(r["root"]) for r in components.components(df).collect()}
    assert got == {name[i]: name[r] for i, r in enumerate(root) if name[i] != name[r]}
    assert components.components(df.limit(0)).collect() == []


@pytest.mark.parametrize("rows", [ODD, big(5, 200), []])
def test_token_id_files(spark, tmp_path, rows):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    folder = f"file://{tmp_path}/ids"
    made = token_ids.write_ids(frame(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, folder=folder)
    got = token_ids.read_ids(made, folder).collect()
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    if len({i for i, _ in rows}) == len(rows):
        assert sorted(tuple(r) for r in got) == want
    assert sorted(((r["id"], r["ids_crc32"]) for r in got), key=str) == sorted(((i, c) for i, _, _, c in want), key=str)
    spans = sorted((r["start"], r["n_tokens"]) for r in got)  # one after another, without gaps
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))


def test_engines_agree_on_every_code_point():
    encoder = token_ids.TextEncoder(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 400):
        text = "".join(f"a{chr(c)}1 {chr(c)}b.{chr(c)}" for c in points[k : k + 400])
        assert encoder.fast.encode_ordinary(text) == encoder.library.encode(text, add_special_tokens=False).ids


def test_engines_agree_on_megabytes_of_one_kind():
    encoder = token_ids.TextEncoder(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    for text in ("a" + " " * 1_500_000 + "b", "\n" * 1_200_000, "z" * 1_000_000, "7" * 1_000_000, "\n " * 600_000, "x" + " " * (token_ids.RUN - 1) + "y", "\u3000" * 60_000 + "a", "\x1c" * 60_000, "-" * 300_000):
        assert (encoder.encode(text) == np.array(encoder.library.encode(text, add_special_tokens=False).ids, np.uint32)).all()


def test_ids_of_other_types_are_refused(spark, tmp_path):
    df = spark.sql("SELECT 1.5D AS doc_id, 'a' AS text")
    with pytest.raises(ValueError):
        token_ids.write_ids(df, public_tokenizers.path("byte_bpe_50k.json"), folder=f"file://{tmp_path}/ids")


def test_numbers_of_every_length_come_back():
    rnd = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (rnd.integers(0, 1 << 32, n) >> rnd.integers(0, 32, n)).astype(np.uint32)
        assert (token_ids.unpack(*token_ids.pack(x), n) == x).all()


@pytest.mark.parametrize("rows", [ODD, big(6, 200), []])
def test_bpe_both_ways(spark, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [tuple(r) for r in bpe.digest(frame(spark, rows), path).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    whole = bpe.encode(frame(spark, rows), path).collect()
    assert sorted((str(r["id"]), r["decoded"]) for r in whole) == sorted((str(i), library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in rows)


def test_blocks_cover_every_row_once(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "BLOCK_BYTES", 10)
    texts = ["a", None, "b" * 30, "", "cc", "d" * 9, "e", "f" * 10]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts), pa.array([5] * 8)], names=["id", "text", "p"])
    got = list(bpe._cut(iter([batch, batch])))
    assert [n for n, _ in got] == [(5 << 32) + k for k in range(len(got))]
    assert sum([b.column(1).to_pylist() for _, b in got], []) == texts * 2
    assert all(b.num_rows == 1 or sum(len(t or "") for t in b.column(1).to_pylist()) <= 10 for _, b in got)


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def similar_brute(texts, similarity=0.8):
    """For each text, the first of the texts that links of this exact shingle similarity lead to."""
    sets = [shingles(t) for t in texts]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    empty = [i for i, s in enumerate(sets) if not s]
    links = list(zip(empty, empty[1:], strict=False))
    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in holders[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        links += [(j, i) for j, n in shared.items() if n >= similarity * (len(s) + len(sets[j]) - n)]
    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def near_copies(seed=2, n=60):
    """Texts with copies of rising distance: (rows, {pair: Jaccard similarity})."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["th", "er", "on", "an", "re", "ti", "in"]) for _ in range(rnd.randint(1, 4)))
    rows = []
    for _ in range(n):
        base = [word() for _ in range(rnd.randint(150, 400))]
        rows.append((len(rows), " ".join(base)))
        for edits in (1, 2, 3, 30):
            w = list(base)
            for p in rnd.sample(range(len(w)), min(len(w), edits * len(w) // 150)):
                w[p] = word()
            rows.append((len(rows), " ".join(w)))
    sets = [shingles(t) for _, t in rows]
    pairs = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for g in range(n) for i, j in itertools.combinations(range(5 * g, 5 * g + 5), 2)}
    return rows, pairs


def test_similar_texts_are_grouped_and_others_left_alone(spark):
    rows, pairs = near_copies()
    got = {r["id"]: r["component_id"] for r in simhash.similar_groups(frame(spark, rows)).collect()}
    close = [p for p, j in pairs.items() if j >= 0.82]
    assert len(close) > 100 and np.mean([got[i] == got[j] for i, j in close]) >= 0.97
    assert all(got[i] != got[j] for (i, j), v in pairs.items() if v < 0.6)
    assert all(c // 5 == i // 5 for i, c in got.items())  # nothing across texts
    kept = {r["doc_id"] for r in simhash.keep_one(frame(spark, rows)).collect()}
    assert kept == {i for i, c in got.items() if i == c}
    assert simhash.similar_groups(frame(spark, [])).collect() == []


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    rnd = random.Random(3)
    own = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    text = own(200)
    rows = [(1, " ".join(text)), (2, " ".join([*text[:-1], "else"])), (2, " ".join(own(100))), (2, " ".join(own(90)))]
    kept = {(r["doc_id"], r["text"]) for r in simhash.keep_one(frame(spark, rows)).collect()}
    assert kept == {rows[0], rows[2], rows[3]}
    spaced = [(5, "a b"), (5, "ab "), (5, "ab "), (5, "\tab")] * 3
    assert len({r["text"] for k in (1, 3, 7) for r in exact_dedup.keep_one(frame(spark, spaced, k)).collect()}) == 1


def test_a_repeated_line_does_not_make_texts_similar(spark):
    rnd = random.Random(4)
    own = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    line = own(20)
    rows = [(i, " ".join(own(204) + line * 20)) for i in range(10)]
    assert max(len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for (_, a), (_, b) in itertools.combinations(rows, 2)) < 0.1
    assert {r["doc_id"] for r in simhash.keep_one(frame(spark, rows)).collect()} == set(range(10))


def banded(n=40, seed=6):
    """Pairs of texts with a shared run and own ends, of similarity 0.65 to 0.85: (rows, similarity of each pair)."""
    rnd = random.Random(seed)
    own = lambda k: [f"w{rnd.randrange(10**6)}" for _ in range(k)]
    rows, true = [], []
    for p in range(n):
        j = 0.65 + 0.2 * p / (n - 1)
        base, k = own(304), round(300 * (1 - j) / (2 * j))
        pair = [" ".join(base + own(k)) for _ in "ab"]
        rows += [(2 * p, pair[0]), (2 * p + 1, pair[1])]
        a, b = map(shingles, pair)
        true.append(len(a & b) / len(a | b))
    return rows, true


@pytest.mark.parametrize("parted", [False, True])
def test_links_are_judged_by_true_similarity(spark, monkeypatch, parted):
    if parted:
        monkeypatch.setattr(simhash, "PART_BYTES", 1000)
    rows, true = banded(40)
    got = {r["id"]: r["component_id"] for r in simhash.similar_groups(frame(spark, rows)).collect()}
    linked = [got[2 * p + 1] == 2 * p for p in range(len(true))]
    assert min(true) < 0.66 and max(true) > 0.84
    assert not any(hit for hit, j in zip(linked, true, strict=True) if j < 0.8)
    assert np.mean([hit for hit, j in zip(linked, true, strict=True) if j >= 0.8]) >= 0.9
    assert all(c // 2 == i // 2 for i, c in got.items())


def test_similar_groups_are_those_of_exact_similarity(spark):
    rows = big(9, 200) + [(7000 + i, t) for i, t in ODD if i is not None]
    sets = [shingles(t) for _, t in rows]
    least = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((least[a], least[b]), key=lambda k: rows[k][0])
            least = [x if k == y else k for k in least]
    want = sorted((i, rows[k][0]) for (i, _), k in zip(rows, least, strict=True))
    got = sorted((r["id"], r["component_id"]) for r in simhash.similar_groups(frame(spark, rows)).collect())
    assert all(w <= g for (_, g), (_, w) in zip(got, want, strict=True))  # nothing is linked below
    assert np.mean([a == b for a, b in zip(got, want, strict=True)]) >= 0.97
