"""Which securities a signal selects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.windows import average_rank, day


def _oriented(direction: str) -> Column:
    if direction not in ("high", "low"):
        raise ValueError("direction must be high or low")
    return F.col("score").desc() if direction == "high" else F.col("score").asc()


def top(book: DataFrame, direction: str, fraction: float = 0.2, top_n: int | None = None) -> DataFrame:
    """(date, code, rank): the best ``ceil(n * fraction)`` (at least one) or ``top_n`` of each date; ties by code."""
    rows = book.filter(F.col("eligible") & F.col("score").isNotNull())
    n = F.count("*").over(day())
    size = F.lit(top_n) if top_n is not None else F.greatest(F.lit(1), F.ceil(n * F.lit(float(fraction))))
    return rows.withColumns({"rank": F.row_number().over(day().orderBy(_oriented(direction), "code")), "_k": size}).filter("rank <= _k").select("date", "code", "rank")


def quantile_band(book: DataFrame, index: int, count: int = 5) -> DataFrame:
    """(date, code) whose average-rank percentile falls in band ``index``; alone on a date, the middle band."""
    rows = book.filter(F.col("eligible") & F.col("score").isNotNull())
    n = F.count("*").over(day())
    band = F.when(n == 1, count // 2).otherwise(F.least(F.floor(average_rank(F.col("score"), day(), n) * count), F.lit(count - 1)))
    return rows.withColumn("band", band.cast("int")).filter(F.col("band") == index).select("date", "code")


def membership_overlap(selected: DataFrame, dates: DataFrame) -> DataFrame:
    """(date, turnover): one-way turnover between equal-weighted selections of neighbouring dates, 1.0 at the first."""
    sizes = selected.groupBy("date").agg(F.count("*").alias("n"))
    line = dates.join(sizes, "date").select("date", "n").withColumns({"before": F.lag("date").over(Window.orderBy("date")), "m": F.lag("n").over(Window.orderBy("date"))})
    common = selected.join(line.select("date", "before"), "date").join(selected.select(F.col("date").alias("before"), "code"), ["before", "code"]).groupBy("date").agg(F.count("*").alias("shared"))
    kept = F.coalesce("shared", F.lit(0)) * F.least(1 / F.col("n"), 1 / F.col("m"))
    return line.join(common, "date", "left").select("date", F.when(F.col("before").isNull(), 1.0).otherwise(1 - kept).alias("turnover"))
