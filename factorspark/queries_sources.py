"""Registered queries of the readers: the driver's rows are written in a source's own layout and read back through it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables as t
from .queries import PANEL_SQL, register
from .sources import bars, plugins

START, END = "1996-02-01", "1998-05-01"
CODES = [str(k) for k in range(41)]
WINDOW = f"date BETWEEN DATE '{START}' AND DATE '{END}' AND code < {len(CODES)}"


def _place(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all machines share; in a local session, in a folder of this machine."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not (spark.sparkContext.master or "").startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(shared or tempfile.gettempdir()).removeprefix('file://').rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _yearly(spark: SparkSession, sf_dir: str, as_text: bool = False) -> str:
    """Bars and states by year; dates as dates, or as yyyyMMdd text."""
    root = _place(spark, "bars")
    date = F.date_format("date", "yyyyMMdd") if as_text else F.col("date")
    rows = t.cells(spark, sf_dir).select(
        F.col("code").cast("string").alias("ts_code"), date.alias("trade_date"), "open", "high", "low", "close", F.col("volume").alias("vol"), "amount", F.lit(1.0).alias("adj_factor"),
        (F.col("volume") < 20).alias("is_suspended"), (F.col("open") * 1.1).alias("up_limit"), (F.col("open") * 0.9).alias("down_limit"), F.year("date").alias("year"),
    )
    rows.repartition("year").write.partitionBy("year").parquet(root)
    return root


@register("source_year_scan", f"WITH {PANEL_SQL} SELECT CAST(code AS VARCHAR) AS code, date, close, volume AS vol FROM cells WHERE {WINDOW}")
def year_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of some securities between two dates, from yearly partitions."""
    return bars.bars(spark, _yearly(spark, sf_dir), START, END, CODES).select("code", "date", "close", "vol")


@register("source_text_dates", f"WITH {PANEL_SQL} SELECT CAST(code AS VARCHAR) AS code, date, volume < 20 AS is_suspended, round(open * 1.1::DOUBLE, 6) AS up_limit FROM cells WHERE {WINDOW}")
def text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States from yearly partitions whose dates are text."""
    return bars.states(spark, _yearly(spark, sf_dir, as_text=True), START, END, CODES).select("code", "date", "is_suspended", F.round("up_limit", 6).alias("up_limit"))


@register("source_calendar_csv", """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) SELECT 'SSE' AS exchange, d AS cal_date, CAST(isodow(d) <= 5 AS INTEGER) AS is_open FROM d
UNION ALL SELECT 'SZSE', d, CAST(isodow(d) <= 5 AND day(d) % 7 <> 0 AS INTEGER) FROM d""")
def calendar_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "calendar")
    t.trade_calendar(spark, sf_dir).select("exchange", F.date_format("cal_date", "yyyyMMdd").alias("cal_date"), "is_open").write.csv(path, header=True)
    return bars.calendar(spark, path)


@register("source_readiness", f"""WITH {PANEL_SQL} SELECT CAST(year(date) AS INTEGER) AS year, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date, count(*) AS n, count(DISTINCT code) AS codes FROM cells GROUP BY 1""")
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each year holds."""
    found = bars.readiness(spark, _yearly(spark, sf_dir), START, END)["years"]  # a row a year
    return spark.createDataFrame([(y["year"], y["start"], y["end"], y["rows"], y["codes"]) for y in found], "year int, first_date string, last_date string, n bigint, codes bigint")


def _manifest(spark: SparkSession, sf_dir: str, **more) -> plugins.Manifest:
    fields = (plugins.DeclaredField("close", "float64", unit="price", basis="hfq_pit"), plugins.DeclaredField("vol", "float64", unit="shares"))
    return plugins.Manifest("supplier_bars", "1", ("ts_code", "trade_date"), (_yearly(spark, sf_dir),), fields, **more)


@register("source_plugin_scan", f"WITH {PANEL_SQL} SELECT CAST(code AS VARCHAR) AS code, date, close FROM cells WHERE {WINDOW}")
def plugin_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declared field of an extension dataset."""
    return plugins.scan(spark, _manifest(spark, sf_dir), ["close"], START, END, CODES)


@register("source_plugin_validate", f"""WITH {PANEL_SQL} SELECT CASE WHEN min(date) <= DATE '{START}' AND max(date) >= DATE '{END}' AND count(*) = count(DISTINCT (code, date)) THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS n, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date FROM cells""")
def plugin_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks of an extension dataset against its manifest."""
    got = plugins.validate(spark, _manifest(spark, sf_dir, start=START, end=END))
    return spark.createDataFrame([(got["status"], got["rows"], got["start"], got["end"])], "status string, n bigint, first_date string, last_date string")
