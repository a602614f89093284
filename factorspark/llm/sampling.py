"""Bounded, repeatable samples of rows for fitting models on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def first_by_hash(ids: DataFrame, id_col: str, n: int, *keep: str) -> DataFrame:
    """The ``n`` rows with the least hash of their id (ties by id): the same rows however the table is split."""
    return ids.select(id_col, *keep).orderBy(F.xxhash64(F.col(id_col)), F.col(id_col)).limit(n)
