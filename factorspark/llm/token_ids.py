"""Token ids as binary files: frequency-ranked ids, byte-aligned variable-length codes, control bytes kept apart.

A file is a sequence of blocks and ends with an index. A block holds whole documents in ascending id order, up to about
``BLOCK`` ids. It ranks its own ids by falling frequency (ties by id) and writes each rank as one to four bytes, least
significant first: rank 0..255 takes one byte, and so on. The lengths, less one, go as two bits an id into a separate run
of control bytes, four ids a byte, first id in the low bits. A reader decodes control bytes through a table of 256 entries
(four lengths a byte), sums lengths to offsets and gathers the data bytes, all in numpy.

    file    = magic "FSTK1\\n", blocks, index (JSON), length of the index (u64), magic
    block   = rank table (u32 ids in rank order), control bytes, data bytes, ids of each document (u32)

Ranks are local to a block, so one pass over the texts is enough, memory is bounded by a block, and a block decodes alone.

Files are written by the tasks of a range-partitioned, sorted job, under names that no second attempt of a task reuses;
the manifest names only the files of attempts that succeeded, so a lost executor leaves at most an unread file.

Defined results: a null text counts as empty; every document ends with ``end_id``; null ids sort first; repeated ids keep one
entry each; an empty table gives an empty manifest.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import arrow_map, cut, new_folder

MAGIC = b"FSTK1\n"
#: Ids after which a block is closed.
BLOCK = 2_000_000
#: Lengths that each control byte stands for.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1
#: Fixed value: the split pattern of the byte-level pre-tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Characters of white space in a row from which on a text is for the library.
RUN = 50_000
_RUN = re.compile(rf"[\s\x85]{{{RUN}}}")


class TextEncoder:
    """Encodes whole texts exactly as the tokenizers library does with the given byte-level BPE file.

    The ids come from a second engine that is built from the same file (its pieces in merge order, its split pattern): it is
    about five times as fast and gives the same ids, which the tests hold against the library on every code point and on
    megabytes of white space, of one letter and of digits. Two sorts of text go to the library itself: those with the
    string of an added token, whose id it gives, and those with a very long run of white space, for which the other engine's
    pattern matcher keeps a stack that overflows (from about 800,000 characters on; ``RUN`` is far below).
    """

    def __init__(self, model: str):
        spec = json.loads(model)
        self.special = [t["content"] for t in spec["added_tokens"]]
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in self.special}
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        self.library = Tokenizer.from_str(model)
        self.library.no_truncation()
        self.library.no_padding()

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special) or (len(text) >= RUN and _RUN.search(text)):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, then from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


#: Encoders stay with the worker process from task to task.
_ENCODERS: dict[int, TextEncoder] = {}


def encoder(model: str) -> TextEncoder:
    key = hash(model)
    if key not in _ENCODERS:
        _ENCODERS[key] = TextEncoder(model)
    return _ENCODERS[key]


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    n = len(ranks)
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    code = np.zeros(-(-n // 4) * 4, np.uint8)
    code[:n] = size - 1
    four = code.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    each = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), each[np.arange(4) < size[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The numbers that ``pack`` has written."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    raw = np.zeros((n, 4), np.uint8)
    raw[np.arange(4) < size[:, None]] = np.frombuffer(data, np.uint8)
    return raw.view("<u4").reshape(-1)


def write_block(ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, dict]:
    """One block as bytes, and its entry in the index."""
    seen, back, often = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.lexsort((seen, -often))
    rank = np.empty(len(seen), np.uint32)
    rank[order] = np.arange(len(seen), dtype=np.uint32)
    control, data = pack(rank[back])
    parts = [seen[order].astype("<u4").tobytes(), control, data, counts.astype("<u4").tobytes()]
    return b"".join(parts), {"ids": len(ids), "docs": len(counts), "bytes": [len(p) for p in parts]}


def read_block(raw: bytes, entry: dict) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids of each document) of a block."""
    cuts = np.cumsum([0, *entry["bytes"]])
    table, control, data, counts = (raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
    return np.frombuffer(table, "<u4")[unpack(control, data, entry["ids"])], np.frombuffer(counts, "<u4")


def write_ids(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0, folder: str | None = None) -> DataFrame:
    """Encode every text, write the files, and return the manifest: (part, path, docs, tokens, first), one row a file.

    Ids of documents are whole numbers or strings (the index of a file is JSON); other types are refused.
    ``first`` is the number of ids in the files before this one. Files are in id order of their part numbers.
    """
    spark = docs.sparkSession
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long", "string"):
        raise ValueError(f"{id_col} must be a whole number or a string")
    folder = folder or new_folder(spark, "token-ids")
    model = Path(model_path).read_text(encoding="utf-8")
    shared = spark.sparkContext.broadcast(model)  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, index, path, part = None, [], "", None
        held: list[np.ndarray] = []
        names: list = []
        docs_n = total = 0

        def close_block() -> None:
            counts = np.array([len(h) for h in held], np.uint32)
            raw, entry = write_block(np.concatenate(held), counts)
            index.append(entry | {"id": names[:]})
            out.write(raw)
            held.clear()
            names.clear()

        size = 0
        for batch in batches:
            if out is None and batch.num_rows:
                part = batch.column(2)[0].as_py()
                fs, base = pafs.FileSystem.from_uri(folder)
                fs.create_dir(base)
                path = f"{base}/part-{part:06d}-{uuid.uuid4().hex}.ids"
                out = fs.open_output_stream(path)
                out.write(MAGIC)
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder(shared.value).encode(text.as_py() or "")
                held.append(ids if end_id is None else np.append(ids, np.uint32(end_id)))
                names.append(key)
                docs_n += 1
                total += len(held[-1])
                size += len(held[-1])
                if size >= BLOCK:
                    close_block()
                    size = 0
        if out is None:
            return
        if held:
            close_block()
        tail = json.dumps(index).encode()
        out.write(tail + len(tail).to_bytes(8, "little") + MAGIC)
        out.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "docs": [docs_n], "tokens": [total]})

    ranged = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first())
    made = arrow_map(ranged.withColumn("part", F.spark_partition_id()), run, "part int, path string, docs bigint, tokens bigint")
    manifest = cut(made)  # a row a file; the files of a task that is run again are not named
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_file(folder: str, path: str) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(document ids, ids, ids of each document) block by block."""
    fs, _ = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(path) as f:
        end = f.size() - len(MAGIC) - 8
        f.seek(end)
        tail = int.from_bytes(f.read(8), "little")
        f.seek(end - tail)
        index = json.loads(f.read(tail))
        f.seek(len(MAGIC))
        for entry in index:
            yield entry["id"], *read_block(f.read(sum(entry["bytes"])), entry)


def read_ids(manifest: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for names, ids, counts in read_file(folder, path):
                    stop = np.cumsum(counts, dtype=np.int64)
                    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((stop - counts).tolist(), stop.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names, batch.schema.field(2).type), pa.array(start + stop - counts, pa.int64()), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"]
                    )
                    start += int(stop[-1]) if len(stop) else 0

    # A task a file or so: without a stated number of partitions the few rows of the manifest would meet in one.
    files = manifest.repartitionByRange(max(1, manifest.count()), "part").select("path", "first", F.lit(None).cast(id_type).alias("kind"))
    return arrow_map(files, run, f"id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")
