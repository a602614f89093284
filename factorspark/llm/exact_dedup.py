"""Exact deduplication by a heavy-hitter split, in DataFrame functions only.

Each text becomes a SHA-256 digest of itself without ASCII white space. A frequent-items sketch of the Misra-Gries
family (``approx_top_k``: decrement counters, error at most rows / counters) names the digests that may be frequent;
their exact counts and winners are then taken with map-side partial aggregation, and the verified ones are broadcast
(at most ``HEAVY`` rows) so that rows of frequent groups are settled in the map task that reads them. All other digests
go through one ordinary shuffle; none of their groups can hold more than about 1/``HEAVY`` of the rows.

Defined results: a null text counts as empty; empty texts are equal to each other; of equal texts the longest original
stays, then the smallest id, null ids last, and of rows that repeat an id exactly one. An empty table gives an empty
result. Extra columns pass through untouched whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Most digests that are settled map-side: the bound on what is broadcast.
HEAVY = 1024
#: Counters of each sketch: a digest with over rows / COUNTERS rows cannot be missed.
COUNTERS = 8192
#: Partial sketches are merged in this many groups before the last merge, so that no task merges one from every partition.
MERGERS = 64


def normalised(text: Column) -> Column:
    """``text`` without the characters \\x20 and \\x09-\\x0D; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _order() -> list[Column]:
    return [F.col("n").desc(), F.col("id").asc_nulls_last(), F.col("uid").asc()]


def _rank() -> Column:
    """A struct whose minimum is the row that stays, under the same order."""
    return F.struct((-F.col("n")).alias("m"), F.col("id").isNull().alias("z"), F.col("id").alias("id"), F.col("uid").alias("uid"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, id, digest, n): one small row for each document, cut from its lineage so that texts are hashed once."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return cut(
        docs.select(
            F.monotonically_increasing_id().alias("uid"),
            docs[id_col].alias("id"),
            F.unhex(F.sha2(normalised(text), 256)).alias("digest"),
            F.length(text).cast("long").alias("n"),
        )
    )


def frequent(table: DataFrame) -> DataFrame:
    """At most HEAVY rows (digest, size, top): the verified winners of the frequent digests of ``table``."""
    keyed = table.withColumn("key", F.xxhash64("digest"))
    sketches = keyed.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("m")).agg(F.expr(f"approx_top_k_accumulate(key, {COUNTERS})").alias("s"))
    # Grouped by a constant: a merge without a group would also run in partitions that have no sketch, and fail there.
    items = sketches.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(s, {COUNTERS})").alias("s")).select(F.explode(F.expr(f"approx_top_k_estimate(s, {HEAVY})")).alias("i"))
    named = items.select(F.col("i.item").alias("key")).distinct()
    exact = keyed.join(F.broadcast(named), "key").groupBy("digest").agg(F.count("*").alias("size"), F.min(_rank()).alias("top"))
    rows = table.count()
    return exact.filter((F.col("size") > 1) & (F.col("size") * HEAVY >= rows))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, digest) for every row, dropped ones too."""
    table = digests(docs, id_col, text_col)
    heavy = cut(frequent(table))
    settled = table.join(F.broadcast(heavy), "digest").select(
        "id", F.col("top.id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("uid") == F.col("top.uid")).alias("kept"), "digest"
    )
    group = Window.partitionBy("digest")
    best = group.orderBy(*_order())
    rest = table.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").select(
        "id", F.first("id").over(best).alias("keep_id"), F.count("*").over(group).alias("group_size"), (F.row_number().over(best) == 1).alias("kept"), "digest"
    )
    return settled.unionByName(rest)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns.

    Losers of frequent groups go in the map task; what is left (no frequent group keeps more than its winner) is
    dealt by digest once, whole rows with it. Of rows with one id and length whose white space differs, the one whose
    original text has the least hash stays; of rows that repeat id and text, any one.
    """
    heavy = cut(frequent(digests(docs, id_col, text_col)).select("digest", "top"))
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"), F.unhex(F.sha2(normalised(text), 256)).alias("digest"), F.length(text).cast("long").alias("n"), F.xxhash64(text).alias("tie")
    )
    marked = rows.join(F.broadcast(heavy), "digest", "left")
    winner = (F.col("n") == -F.col("top.m")) & F.col("id").eqNullSafe(F.col("top.id"))
    alone = marked.filter(F.col("top").isNull()).select("row", "digest", "n", "id", "tie")
    # Rows that repeat a winner's id and length collapse map-side before they meet.
    first = marked.filter(F.col("top").isNotNull() & winner).groupBy("digest", "n", "id").agg(F.min_by("row", "tie").alias("row"), F.min("tie").alias("tie")).select("row", "digest", "n", "id", "tie")
    best = Window.partitionBy("digest").orderBy(F.col("n").desc(), F.col("id").asc_nulls_last(), "tie")
    return alone.unionByName(first).withColumn("rn", F.row_number().over(best)).filter("rn = 1").select("row.*")
