"""BPE encoding and decoding through a table of distinct words.

Texts are cut into words at white space (the pre-tokenizer never matches across it). Documents are taken in blocks of up to
``BLOCK_BYTES`` of text. A block lists its distinct words once, in the order of their hashes, and keeps each document as positions in that
list. The lists are dealt by that hash: all blocks' mentions of a word meet in one bucket of the distinct-word table, where it is
encoded once. A bucket's lists stream past a bounded memory of its words, so that no task holds a bucket. The ids go back to the blocks in the order of their lists, and a document's are read off by position; each
id is joined to its piece of the vocabulary (a table of fixed size) to decode.

Word lists and ids travel as one compressed array for each block and bucket, not as a row a word, because most distinct
words of a large corpus are rare and a row each would outweigh the texts.

Lists carry a checksum of their words: a block that gets the ids of other words than its own (which one recomputed from an
unstable input could) stops the job rather than give a wrong answer.

Defined results: a null text counts as empty, and an empty text has no ids and decodes to the empty string; repeated rows
give repeated rows; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain
from operator import xor
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common as shared_plumbing
from .token_ids import pack, unpack
from .words import hash_words, letters

#: Words, and their bytes, that the memo of a bucket holds before it starts anew.
REMEMBERED, LETTERS = 1_000_000, 1 << 25
#: White space as the pre-tokenizer's pattern has it.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_LETTERS = letters(np.array([chr(b) not in "\t\n\v\f\r " for b in range(256)]))


def pieces(model_path: str) -> list[tuple[int, str]]:
    """(id, piece) of the whole vocabulary, added tokens too."""
    model = json.loads(Path(model_path).read_text(encoding="utf-8"))
    return sorted({(i, p) for p, i in model["model"]["vocab"].items()} | {(t["id"], t["content"]) for t in model["added_tokens"]})


def _zip(raw: bytes) -> bytes:
    return zlib.compress(raw, 1)


class Block:
    """The distinct words of a batch of texts, and every word's position among them.

    Words are told apart by a 64-bit hash; bytes are compared with those of the hash's first word, and if two words
    clash the block takes other hashes.
    """

    def __init__(self, texts: list[str | None]):
        raw = [SPACE.sub(" ", t).encode() if t and not t.isascii() else (t or "").encode() for t in texts]
        buf = np.frombuffer(b" ".join([*raw, b""]) or b" ", np.uint8)
        stops = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
        for seed in range(100):
            h, start, end = hash_words(buf, _LETTERS if not seed else letters(_LETTERS != 0, seed))
            self.keys, first, self.where = np.unique(h, return_index=True, return_inverse=True)
            self._raw, self._span = buf, (start[first], end[first])
            if self._told_apart(buf, start, end):
                break
        self.counts = np.diff(np.r_[0, np.searchsorted(start, stops)]).astype(np.uint32)

    def _told_apart(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> bool:
        """Whether every word has the bytes of its key's first word."""
        long, (a, b) = end - start, self._span
        if not np.array_equal(long, (b - a)[self.where]):
            return False
        for lo in range(0, len(long), 500_000):
            n = long[lo : lo + 500_000]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            if not np.array_equal(buf[np.repeat(start[lo : lo + 500_000], n) + step], buf[np.repeat(a[self.where[lo : lo + 500_000]], n) + step]):
                return False
        return True

    def dealt(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words in the order of the lists: by bucket, then by hash; the buckets that have some; where each begins)."""
        own = (self.keys % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(own, kind="stable")
        return order, *np.unique(own[order], return_index=True)

    def words(self, which: np.ndarray) -> list[bytes]:
        raw = self._raw.tobytes()
        a, b = self._span
        return [raw[i:j] for i, j in zip(a[which].tolist(), b[which].tolist(), strict=True)]


#: Text of a block, in bytes; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(number, rows) of the blocks of a partition: the number is the partition's and the block's place there.

    Blocks depend on the rows and their order alone, not on the batches in which they come.
    """
    held: list[pa.RecordBatch] = []
    room, k = BLOCK_BYTES, 0

    def close() -> tuple[int, pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held.clear()
        return (rows.column(2)[0].as_py() << 32) + k, rows

    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            before = int(size[first - 1]) if first else 0
            last = int(np.searchsorted(size, before + room, "right"))
            if last == first and not held:
                last = first + 1
            if last > first:
                held.append(batch.slice(first, last - first))
                room -= int(size[last - 1]) - before
                first = last
            if first < batch.num_rows:  # the next row does not fit
                yield close()
                room, k = BLOCK_BYTES, k + 1
    if held:
        yield close()


def _lists(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, mark, words): each block's distinct words of each bucket, in the order of their hashes, which the mark sums up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in _cut(batches):
            if batch.num_rows:
                block = Block(batch.column(1).to_pylist())
                if not len(block.keys):
                    continue  # no words: the block asks for nothing
                order, found, first = block.dealt(buckets)
                listed, ends = block.words(order), [*first[1:].tolist(), len(order)]
                parts = [_zip(b"\n".join(listed[i:j])) for i, j in zip(first.tolist(), ends, strict=True)]
                sums = np.bitwise_xor.reduceat(block.keys[order], first).view(np.int64)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(found, pa.int32()), "block": pa.array([number] * len(found), pa.int64()), "mark": pa.array(sums), "words": pa.array(parts, pa.binary())})

    return shared_plumbing.arrow_map(rows, run, "bucket int, block bigint, mark bigint, words binary")


class Memo:
    """Ids of the words of a bucket, each encoded once; within ``REMEMBERED`` words and ``LETTERS`` bytes, beyond which it starts anew."""

    def __init__(self, model: str):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.at: dict[bytes, int] = {}
        self.letters = 0
        self.long, self.begin, self.ids = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint32)]
        self.total = 0

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids one after another)"""
        if len(self.at) > REMEMBERED or self.letters > LETTERS:
            self.forget()
        new = [w for w in words if w not in self.at]
        if new:
            long, ids = encode_words([w.decode() for w in new], self.model)
            self.begin.append(self.total + np.cumsum(long) - long)
            self.long.append(long)
            self.ids.append(ids)
            self.total += len(ids)
            self.letters += sum(map(len, new))
            for w in new:
                self.at[w] = len(self.at)
        where = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        for kept in (self.long, self.begin, self.ids):
            if len(kept) > 1:
                kept[:] = [np.concatenate(kept)]
        long = self.long[0][where]
        end = np.cumsum(long)
        return long, self.ids[0][np.repeat(self.begin[0][where] - end + long, long) + np.arange(int(end[-1]) if len(end) else 0)]


def _coded(lists: DataFrame, model_path: str) -> DataFrame:
    """(block, bucket, n, mark, sizes, ids): the ids of each list's words. The lists of a bucket come one after another to its memo."""
    shared = lists.sparkSession.sparkContext.broadcast(Path(model_path).read_text(encoding="utf-8"))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, open_bucket = Memo(shared.value), None
        for batch in batches:
            for bucket, block, mark, packed in zip(*[batch.column(i).to_pylist() for i in range(3)], batch.column(3), strict=True):
                if bucket != open_bucket:
                    memo.forget()
                    open_bucket = bucket
                words = zlib.decompress(packed.as_buffer()).split(b"\n")
                long, ids = memo.look_up(words)
                sizes = _zip(long.astype(np.uint16 if long.max(initial=0) < 1 << 16 else np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([len(words)], pa.int32()), pa.array([mark], pa.int64()), pa.array([sizes], pa.binary()), pa.array([_zip(ids.tobytes())], pa.binary())],
                    names=["block", "bucket", "n", "mark", "sizes", "ids"],
                )

    dealt = lists.repartition("bucket").sortWithinPartitions("bucket", "block")
    return shared_plumbing.arrow_map(dealt, run, "block bigint, bucket int, n int, mark bigint, sizes binary, ids binary")


@lru_cache(2)
def _tokenizer(model: str) -> Tokenizer:
    """Kept by the worker from bucket to bucket."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
    tokenizer = Tokenizer.from_str(model)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def encode_words(listed: list[str], model: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of each word, all ids): every word through the library once."""
    tokenizer = _tokenizer(model)
    long, flat = [np.empty(0, np.int64)], [np.empty(0, np.uint32)]
    for a in range(0, len(listed), 10_000):
        got = [e.ids for e in tokenizer.encode_batch_fast(listed[a : a + 10_000], add_special_tokens=False)]
        long.append(np.fromiter(map(len, got), np.int64, len(got)))
        flat.append(np.fromiter(chain.from_iterable(got), np.uint32))
    return np.concatenate(long), np.concatenate(flat)


def _assemble(docs: DataFrame, model_path: str, id_col: str, text_col: str, digests: bool) -> DataFrame:
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).withColumn("p", F.spark_partition_id())
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = _coded(_lists(rows, buckets), model_path)
    pieces_of = spark.sparkContext.broadcast([p for _, p in pieces(model_path)])  # as large as the vocabulary

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in _cut(batches):
            if batch.num_rows:
                block = Block(batch.column(1).to_pylist())
                n = len(block.keys)
                listed, _, _ = block.dealt(buckets)
                place = np.empty(n, np.uint32)
                place[listed] = np.arange(n, dtype=np.uint32)
                common = np.argsort(-np.bincount(block.where, minlength=n), kind="stable")  # frequent words get small numbers
                rank = np.empty(n, np.uint32)
                rank[common] = np.arange(n, dtype=np.uint32)
                control, data = pack(rank[block.where])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()),
                        pa.array([n], pa.int32()),
                        pa.array(np.bitwise_xor.reduce(block.keys, keepdims=True).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0)),
                        pa.array([_zip(block.counts.tobytes())], pa.binary()),
                        pa.array([_zip(place[common].tobytes())], pa.binary()),
                        pa.array([control], pa.binary()),
                        pa.array([data], pa.binary()),
                    ],
                    names=["block", "n_words", "mark", "names", "counts", "common", "control", "data"],
                )

    left = shared_plumbing.arrow_map(rows, positions, f"block bigint, n_words int, mark bigint, names array<{kind}>, counts binary, common binary, control binary, data binary")
    out_type = pa.string() if digests else pa.list_(pa.int32())

    def run(own: pa.Table, coded: pa.Table) -> pa.Table:
        parts = []
        for row in own.select(["n_words", "mark", "counts", "common", "control", "data"]).to_pylist():
            n = row["n_words"]
            counts = np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
            common = np.frombuffer(zlib.decompress(row["common"]), np.uint32)
            where = common[unpack(row["control"], row["data"], int(counts.sum()))] if n else np.empty(0, np.uint32)
            got = sorted(coded.select(["bucket", "n", "mark", "sizes", "ids"]).to_pylist(), key=lambda r: r["bucket"])
            if sum(r["n"] for r in got) != n or reduce(xor, (r["mark"] for r in got), 0) != row["mark"]:
                raise RuntimeError("a block's words and ids are not of the same words: its input changed between reads")
            sizes = [np.frombuffer(raw := zlib.decompress(r["sizes"]), np.uint16 if len(raw) == 2 * r["n"] else np.uint32) for r in got]
            long = np.concatenate([np.empty(0, np.int64), *sizes])
            flat = np.concatenate([np.empty(0, np.uint32), *(np.frombuffer(zlib.decompress(r["ids"]), np.uint32) for r in got)])
            begin = np.cumsum(long) - long
            parts.append((counts, where, long, begin, flat))
        piece = pieces_of.value
        n_tokens, ids_out, text_out = [], [], []
        for counts, where, long, begin, flat in parts:
            spelled = [piece[i] for i in flat.tolist()]
            text = [" ".join(spelled[b : b + k]) for b, k in zip(begin.tolist(), long.tolist(), strict=True)]
            stop = 0
            for n in counts.tolist():
                mine = where[stop : stop + n]
                stop += n
                k = long[mine]
                end = np.cumsum(k)
                total = int(end[-1]) if n else 0
                ids = flat[np.repeat(begin[mine] - end + k, k) + np.arange(total)] if total else np.empty(0, np.uint32)
                decoded = " ".join([t for t in map(text.__getitem__, mine.tolist()) if t])  # a word without ids adds no blank
                n_tokens.append(total)
                ids_out.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() if digests else ids.astype(np.int32))
                text_out.append(hashlib.sha256(decoded.encode()).hexdigest() if digests else decoded)
        names = pa.concat_arrays([c.flatten() for c in own.column("names").chunks]) if own.num_rows else pa.array([], own.schema.field("names").type.value_type)
        return pa.table({"id": names, "n_tokens": pa.array(n_tokens, pa.int64()), "ids": pa.array(ids_out, out_type), "decoded": pa.array(text_out, pa.string())})

    schema = f"id {kind}, n_tokens bigint, ids {'string' if digests else 'array<int>'}, decoded string"
    return left.groupBy("block").cogroup(table.groupBy("block")).applyInArrow(run, schema)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decoded) of every document."""
    return _assemble(docs, model_path, id_col, text_col, digests=False)


def digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like ``encode`` with SHA-256 digests (lowercase hex) of the ids as little-endian u32 and of the decoded UTF-8 text."""
    return _assemble(docs, model_path, id_col, text_col, digests=True)
