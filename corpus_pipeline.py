"""A corpus through five stages: quality classifier, exact dedup, SimHash near-dedup, benchmark decontamination, BPE.

Each stage works on all that its predecessor kept, and its decisions take effect in what it returns. A stage's result is
written as Parquet in the shared folder and read again by the next. The first four return documents with their own columns;
the last one returns for every document left its id, its number of tokens, and digests of its ids and of the text they decode to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.llm import bpe, decontaminate, exact_dedup, quality, simhash
from factorspark.llm.common import new_folder, remove


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    net = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, net)


def one_of_equals(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest original, then the smallest id."""
    return exact_dedup.keep_one(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): the smallest id."""
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens, encoded and decoded."""
    got = bpe.digest(docs, public_tokenizers.path("word_bpe_49k.json"))
    return got.select(F.col("id").alias("doc_id"), "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", one_of_equals),
    ("simhash near-dedup", one_of_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("bpe encoding and decoding", tokens),
]

#: No stage but exact dedup can be said in SQL; the whole is held against a brute-force version in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        path = new_folder(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:  # what the stage has read is not needed any more
            remove(spark, before)
        before = path
    return docs
