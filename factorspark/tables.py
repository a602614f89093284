"""Panels and interval tables derived from the driver's tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .prep.panel import densify


#: Room for a price in cents below a trade's second.
PACK = 1 << 30


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars of each supplier: unit prices as open, high, low, close; quantity and value as volume and amount.

    Prices are whole cents, by operations that every engine does alike. A trade's second and price are packed in one long,
    so that first and last trade (ties: the lowest first, the highest last) are plain minima and maxima: a hash aggregate
    with map-side combine instead of a sort.
    """
    cents = F.floor(F.col("l_extendedprice") / F.when(F.col("l_quantity") != 0, F.col("l_quantity")) * 100).cast("bigint")
    trade = F.unix_seconds(F.col("l_shipdate").cast("timestamp")) * PACK + cents
    rows = lineitem(spark, sf_dir).select(F.col("l_suppkey").alias("code"), F.trunc("l_shipdate", "MM").alias("date"), trade.alias("trade"), cents.alias("cents"), "l_quantity", "l_extendedprice")
    bars = rows.groupBy("code", "date").agg(F.min("trade").alias("first"), F.max("trade").alias("last"), F.max("cents").alias("high"), F.min("cents").alias("low"), F.sum("l_quantity").alias("volume"), F.round(F.sum("l_extendedprice"), 2).alias("amount"))
    price = lambda c: F.col(c).bitwiseAND(F.lit(PACK - 1)) / 100.0
    return bars.select("code", "date", price("first").alias("open"), (F.col("high") / 100.0).alias("high"), (F.col("low") / 100.0).alias("low"), price("last").alias("close"), "volume", "amount")


def stock_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, date, pos, open, high, low, close, volume, amount, grp, in_universe)."""
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("code"), F.col("s_nationkey").cast("double").alias("grp"))
    dense = densify(cells(spark, sf_dir))
    return dense.join(suppliers, "code", "left").withColumn("in_universe", F.coalesce(F.col("volume") >= 60, F.lit(False)))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, date): days on which a supplier ships."""
    return lineitem(spark, sf_dir).select(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("date")).distinct()


def special_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, start, end): spans after some returned items; some are open."""
    rows = lineitem(spark, sf_dir).filter("l_returnflag = 'R' AND l_tax > 0.075D")
    start = F.to_date("l_shipdate")
    return rows.select(F.col("l_suppkey").alias("code"), start.alias("start"), F.when((F.col("l_linenumber") < 7) | (F.col("l_quantity") < 40), F.date_add(start, F.col("l_linenumber") * 10)).alias("end"))


def category_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineitem(spark, sf_dir).filter("l_returnflag = 'A' AND l_tax < 0.005D AND l_quantity <= 10")
    start = F.to_date("l_shipdate")
    return rows.select(F.col("l_suppkey").alias("code"), start.alias("start"), F.date_add(start, 60).alias("end"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("label"))


def trade_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(exchange, cal_date, is_open): order days; weekends are closed, and one exchange also closes on days of the month that 7 divides."""
    days = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.to_date("o_orderdate").alias("cal_date")).distinct()
    week = F.dayofweek("cal_date").between(2, 6)
    return days.select(F.lit("SSE").alias("exchange"), "cal_date", week.cast("int").alias("is_open")).unionByName(days.select(F.lit("SZSE").alias("exchange"), "cal_date", (week & (F.dayofmonth("cal_date") % 7 != 0)).cast("int").alias("is_open")))


def stock_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, exchange, list_date): suppliers, listed on their first shipping day."""
    first = lineitem(spark, sf_dir).groupBy(F.col("l_suppkey").alias("code")).agg(F.to_date(F.min("l_shipdate")).alias("list_date"))
    return first.select("code", F.when(F.col("code") % 2 == 0, "SSE").otherwise("SZSE").alias("exchange"), "list_date")


def snapshots(spark: SparkSession, sf_dir: str, size: int = 30) -> DataFrame:
    """(index_code, snapshot_date, con_code): the suppliers with most volume of each quarter, at its last day."""
    from pyspark.sql import Window

    quarter = F.date_sub(F.add_months(F.trunc("l_shipdate", "quarter"), 3), 1)
    volume = lineitem(spark, sf_dir).groupBy(F.col("l_suppkey").alias("con_code"), quarter.alias("snapshot_date")).agg(F.sum("l_quantity").alias("v"))
    top = volume.withColumn("r", F.row_number().over(Window.partitionBy("snapshot_date").orderBy(F.desc("v"), "con_code"))).filter(F.col("r") <= size)
    return top.select(F.lit("top").alias("index_code"), "snapshot_date", "con_code")


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, date, pos, open, close, eligible, score, buyable, sellable): reversal over three months."""
    from .engine import Engine

    e = Engine()
    plan = e.plan(e.compile("neg(ts_pct_change(close,3))"))
    out = plan.results(stock_panel(spark, sf_dir), "pos", "open", "close", F.col("in_universe").alias("eligible"), "high", "low", "volume")
    score = F.col(plan.expressions[0].factor_id).alias("score")
    return out.select("code", "date", "pos", "open", "close", "eligible", score, F.coalesce((F.col("open") > 0) & (F.col("code") % 11 != F.col("pos") % 11), F.lit(False)).alias("buyable"), F.coalesce((F.col("open") > 0) & (F.col("code") % 13 != F.col("pos") % 13), F.lit(False)).alias("sellable"))
