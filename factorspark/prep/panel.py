"""Long panels: a dense grid of dates and securities with their observations; missing is null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """A double whose NaN and infinities are null."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


#: Dates of the longest calendar that is sent to the tasks; a longer one is an error.
LONGEST = 1 << 17


def dates_with_position(dates: DataFrame) -> DataFrame:
    """(date, pos): positions from 0 over distinct dates. Dates are a calendar: thousands of rows at any scale of data."""
    return dates.select("date").distinct().withColumn("pos", (F.row_number().over(Window.orderBy("date")) - 1).cast("int"))


def densify(cells: DataFrame, codes: DataFrame | None = None, dates: DataFrame | None = None) -> DataFrame:
    """Every security on every date, with its observation or nulls.

    The calendar is sent to the tasks that hold the securities, so the grid is made in place; then one shuffle by (code, date)
    lays the observations on it.
    """
    codes = (codes if codes is not None else cells).select("code").distinct()
    calendar = dates_with_position(dates if dates is not None else cells)
    over = F.raise_error(F.lit(f"a calendar of more than {LONGEST} dates")).cast("int")
    grid = codes.crossJoin(F.broadcast(calendar.withColumn("pos", F.when(F.col("pos") < LONGEST, F.col("pos")).otherwise(over))))
    return grid.join(cells, ["code", "date"], "left")


def panel(cells: DataFrame, fields: list[str], in_universe: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """A dense panel (code, date, pos, in_universe, fields) of cleaned doubles."""
    dense = densify(cells.select("code", "date", *keep, *[clean(F.col(c)).alias(c) for c in fields]))
    return dense.withColumn("in_universe", F.coalesce(in_universe if in_universe is not None else F.col(fields[0]).isNotNull(), F.lit(False)))


def parse_date(c: Column) -> Column:
    """Dates given as yyyyMMdd, yyyyMMdd.0, yyyy-MM-dd or as dates and timestamps."""
    text = F.regexp_replace(c.cast("string"), r"\.0$", "")
    return F.coalesce(F.try_to_date(text, "yyyyMMdd"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))
