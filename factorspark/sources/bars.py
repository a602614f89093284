"""Yearly bar and state files, and the small tables around them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DataError
from ..prep.intervals import next_open_day
from ..prep.panel import parse_date
from ..prep.views import duplicates, require_empty

BARS = ("open", "high", "low", "close", "vol", "amount", "adj_factor")
STATES = ("is_suspended", "up_limit", "down_limit")


def years_between(start: str, end: str) -> list[int]:
    return list(range(int(start[:4]), int(end[:4]) + 1))


#: Codes that a filter lists; more of them are joined.
LISTED = 500


def among(rows: DataFrame, column: str, codes: list) -> DataFrame:
    """The rows whose ``column`` is one of ``codes``: by a filter that reaches the files, or a semi-join where they are many."""
    if len(codes) <= LISTED:
        return rows.filter(F.col(column).isin(list(codes)))
    table = rows.sparkSession.createDataFrame([(c,) for c in codes], f"`{column}` {rows.schema[column].dataType.simpleString()}")
    return rows.join(table, column, "left_semi")


def read_years(spark: SparkSession, root: str, columns: tuple[str, ...], start: str, end: str, codes: list[str] | None = None) -> DataFrame:
    """(code, date, columns) of ``root``/year=YYYY between two dates: partitions and columns pruned, the date filter pushed down.

    A year without a partition is an error. Dates in the files may be dates, timestamps or yyyyMMdd strings; the literal
    takes the column's type so that the filter reaches the files.
    """
    df = spark.read.parquet(root)
    if "year" not in df.columns:
        raise DataError(f"{root} has no year partitions")
    wanted = years_between(start, end)
    there = {r["year"] for r in df.select("year").distinct().collect()}  # partition values only
    missing = [y for y in wanted if y not in there]
    if missing:
        raise DataError(f"{root} lacks the years {missing}")
    kind = df.schema["trade_date"].dataType
    literal = (lambda d: F.lit(d.replace("-", ""))) if isinstance(kind, T.StringType) else (lambda d: F.lit(d).cast(kind))
    rows = df.filter(F.col("year").isin(wanted) & (F.col("trade_date") >= literal(start)) & (F.col("trade_date") <= literal(end)))
    if codes is not None:
        rows = among(rows, "ts_code", codes)
    date = parse_date(F.col("trade_date")) if isinstance(kind, T.StringType) else F.to_date("trade_date")
    return rows.select(F.col("ts_code").alias("code"), date.alias("date"), *columns)


def bars(spark: SparkSession, root: str, start: str, end: str, codes: list[str] | None = None) -> DataFrame:
    return read_years(spark, root, BARS, start, end, codes)


def states(spark: SparkSession, root: str, start: str, end: str, codes: list[str] | None = None) -> DataFrame:
    return read_years(spark, root, STATES, start, end, codes)


def sidecar(spark: SparkSession, root: str, source: str, fields: list[str], start: str, end: str) -> DataFrame:
    """Normalised sidecar columns of ``root``/``source``/year=YYYY."""
    return read_years(spark, f"{root}/{source}", tuple(fields), start, end)


def master(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("ts_code").alias("code"), "exchange", "market", parse_date(F.col("list_date")).alias("list_date"), parse_date(F.col("delist_date")).alias("delist_date"))


def special_treatment(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("ts_code").alias("code"), parse_date(F.col("start_date")).alias("start"), parse_date(F.col("end_date")).alias("end"))


def calendar(spark: SparkSession, path: str) -> DataFrame:
    schema = "exchange string, cal_date string, is_open int"
    return spark.read.schema(schema).csv(path, header=True).select("exchange", parse_date(F.col("cal_date")).alias("cal_date"), "is_open")


def index_membership(spark: SparkSession, path: str, indexes: list[str] | None = None) -> DataFrame:
    """(index_code, effective_date, con_code), dates normalised, indexes filtered in the files."""
    df = spark.read.parquet(path)
    if indexes is not None:
        df = df.filter(F.col("index_code").isin(indexes))
    return df.select("index_code", parse_date(F.col("effective_date")).alias("effective_date"), "con_code")


def normalised_weights(raw: DataFrame, days: DataFrame, source_name: str) -> DataFrame:
    """Raw index weights (index_code, con_code, trade_date, weight) as membership snapshots in force from the next open day."""
    rows = raw.select("index_code", parse_date(F.col("trade_date")).alias("snapshot_date"), "con_code", F.col("weight").cast("double").alias("weight"))
    require_empty(duplicates(rows, "index_code", "snapshot_date", "con_code"), "index weights repeat a member")
    return next_open_day(rows, days).withColumn("source", F.lit(source_name)).select("index_code", "snapshot_date", "effective_date", "con_code", "weight", "source")


def readiness(spark: SparkSession, root: str, start: str, end: str) -> dict:
    """What is there, year by year, and what stands in the way of [start, end]."""
    blockers, years = [], []
    folder = Path(root)
    if not folder.is_dir():
        return {"ready": False, "blockers": [f"{root} does not exist"], "years": []}
    df = spark.read.parquet(root)
    lacking = [c for c in ("ts_code", "trade_date", *BARS) if c not in df.columns]
    if lacking:
        blockers.append(f"columns {lacking} are missing")
    else:
        date = parse_date(F.col("trade_date")) if isinstance(df.schema["trade_date"].dataType, T.StringType) else F.to_date("trade_date")
        for r in df.groupBy("year").agg(F.min(date).alias("lo"), F.max(date).alias("hi"), F.count("*").alias("n"), F.count_distinct("ts_code").alias("codes")).orderBy("year").collect():  # a row a year
            years.append({"year": r["year"], "start": str(r["lo"]), "end": str(r["hi"]), "rows": r["n"], "codes": r["codes"]})
        blockers += [f"year {y} is missing" for y in years_between(start, end) if y not in {x["year"] for x in years}]
    return {"ready": not blockers, "blockers": blockers, "years": years}
