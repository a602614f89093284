"""What the span finders share: the span schema, maps over texts, digests in DataFrame functions, redaction."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: kind, start, end (code points, end exclusive)
Span = tuple[str, int, int]
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def ordered(spans: Iterable[Span], kinds: tuple[str, ...]) -> list[Span]:
    """By start, then kind as listed."""
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def matches(kind: str, pattern: re.Pattern, text: str, good: Callable[[re.Match], bool] = lambda m: True) -> list[Span]:
    """Leftmost non-overlapping matches; failing ones are dropped after the fact."""
    return [(kind, m.start(), m.end()) for m in pattern.finditer(text) if good(m)]


def free(spans: Iterable[Span], taken: Iterable[Span]) -> list[Span]:
    """The spans that touch none of ``taken`` and no earlier one of their own."""
    held: list[list[int]] = []  # what is taken, as disjoint intervals in order
    for a, b in sorted((a, b) for _, a, b in taken):
        if held and a < held[-1][1]:
            held[-1][1] = max(b, held[-1][1])
        else:
            held.append([a, b])
    out, k, done = [], 0, 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        while k < len(held) and held[k][1] <= a:
            k += 1
        if a >= done and (k == len(held) or b <= held[k][0]):
            out.append((kind, a, b))
            done = b
    return out


def span_table(docs: DataFrame, find: Callable[[list[str]], list[list[tuple[str, int, int, bool]]]], id_col: str, text_col: str) -> DataFrame:
    """(id, spans) of every row; a span says whether the patterns alone give it (base). Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = find([t.as_py() or "" for t in batch.column(1)])
            rows = [[{"kind": k, "start": a, "end": b, "base": base} for k, a, b, base in spans] for spans in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _TYPE)], names=["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), run, f"id {kind}, spans array<struct<kind:string,start:int,end:int,base:boolean>>")


def base_count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def listing(base: bool = False) -> Column:
    """kind:start:end of all spans, or of the base ones, comma-joined."""
    some = F.filter("spans", lambda s: s["base"]) if base else F.col("spans")
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: str, spans: Iterable[Span]) -> str:
    """``text`` with each span replaced by its kind in angle brackets; overlapping spans are one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]
