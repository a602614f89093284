"""The opN queries of this subpackage over the driver's tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, html_extract, langid, pii, quality, secret_scan, simhash, token_ids
from .common import new_folder
from .sampling import fold
from .spans import base_count, listing


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = exact_dedup.decisions(_table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER w = 1 AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id ASC NULLS LAST)
"""


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "op2-token-ids")
    manifest = token_ids.write_ids(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, folder=folder)
    return token_ids.read_ids(manifest, folder).withColumnRenamed("id", "doc_id")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bpe.digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return got.select(F.col("id").alias("doc_id"), "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


def _span_digests(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return found.select(F.col("id").alias("doc_id"), *[base_count(k).alias(f"n_{k}") for k in kinds], F.sha2(listing(base=True), 256).alias("base_sha256"), listing().alias("spans"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digests(secret_scan.scan(_table(spark, sf_dir, "documents")), secret_scan.BASE)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digests(pii.scan(_table(spark, sf_dir, "documents")), pii.KINDS)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    weight = html_extract.learn(pages)
    got = html_extract.main_text(pages, weight=weight, keep=["url"])
    return got.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    net = quality.learn(docs, _table(spark, sf_dir, "labels"))
    got = quality.score(docs, net).withColumnRenamed("id", "doc_id")
    return got.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    got = langid.predict(docs, langid.learn(docs)).withColumnRenamed("id", "doc_id")
    return got.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), F.col("lang").alias("lang_pred"), "score")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds."""
    got = decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return got.withColumnRenamed("id", "doc_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.groups(_table(spark, sf_dir, "documents"), words=4, bits=4)
    return got.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL}
