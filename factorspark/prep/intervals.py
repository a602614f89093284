"""Point-in-time joins: intervals, categories, listing age, and index membership.

Every join has the security as its equality key with the range as a residual, so it hash-partitions like the panel does;
small sides (a calendar, a master table) are left to the optimizer's size checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _inside(date: Column, start: Column, end: Column) -> Column:
    """Inclusive ends; a missing end is open."""
    return (date >= start) & (end.isNull() | (date <= end))


def in_interval(obs: DataFrame, intervals: DataFrame, flag: str = "active") -> DataFrame:
    """``obs`` (code, date, ...) with whether any interval (code, start, end) of its security holds its date."""
    spans = intervals.select(F.col("code").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e")).distinct()
    keys = obs.select("code", "date").distinct()
    hit = keys.join(spans, (F.col("code") == F.col("_c")) & _inside(F.col("date"), F.col("_s"), F.col("_e")), "left_semi").withColumn(flag, F.lit(True))
    return obs.join(hit, ["code", "date"], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def category_code(label: Column) -> Column:
    """A label as a number: the first 12 hex digits of its SHA-256, 1 for 0. Below 2^48, so exact as a double."""
    number = F.conv(F.substring(F.sha2(F.trim(label), 256), 1, 12), 16, 10).cast("bigint")
    return F.when(number == 0, F.lit(1).cast("bigint")).otherwise(number).cast("double")


def category_at(obs: DataFrame, intervals: DataFrame, label: str = "label", output: str = "category") -> DataFrame:
    """The category of each (code, date): the one interval that holds it, null where none or several do; and the hits."""
    spans = intervals.select(F.col("code").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e"), category_code(F.col(label)).alias("_v")).dropDuplicates()
    keys = obs.select("code", "date").distinct()
    found = keys.join(spans, (F.col("code") == F.col("_c")) & _inside(F.col("date"), F.col("_s"), F.col("_e")), "left").groupBy("code", "date").agg(F.count("_v").alias("hits"), F.max("_v").alias("_v"))
    return obs.join(found.select("code", "date", F.when(F.col("hits") == 1, F.col("_v")).alias(output), "hits"), ["code", "date"], "left")


def category_audit(placed: DataFrame) -> DataFrame:
    """Per year: observations, and how many have no, one or several intervals."""
    return placed.groupBy(F.year("date").alias("year")).agg(
        F.count("*").alias("observations"), F.count_if(F.col("hits") == 0).alias("missing"), F.count_if(F.col("hits") == 1).alias("unique"), F.count_if(F.col("hits") > 1).alias("ambiguous")
    )


def open_days(calendar: DataFrame) -> DataFrame:
    """(exchange, date, nth): open days of each exchange, numbered from 1."""
    days = calendar.filter("is_open = 1").select("exchange", F.col("cal_date").alias("date")).distinct()
    return days.withColumn("nth", F.row_number().over(Window.partitionBy("exchange").orderBy("date")))


def listing_age(obs: DataFrame, master: DataFrame, calendar: DataFrame, name: str = "listing_trading_days") -> DataFrame:
    """Open days of a security's own exchange from its listing to the observation, both included.

    A running count of open days over days and observations of an exchange replaces two searches in the calendar.
    """
    days = open_days(calendar)
    own = master.select(F.col("code").alias("_code"), F.col("exchange").alias("_exchange"), F.col("list_date").alias("_listed"), F.date_sub("list_date", 1).alias("_before"))
    placed = obs.join(own, F.col("code") == F.col("_code"), "left")
    marks = placed.select(F.col("_exchange").alias("exchange"), "date").union(own.select("_exchange", "_before")).filter("exchange IS NOT NULL AND date IS NOT NULL").distinct()
    counted = (
        days.select("exchange", "date", F.lit(1).alias("open"))
        .unionByName(marks.select("exchange", "date", F.lit(0).alias("open")))
        .groupBy("exchange", "date")
        .agg(F.max("open").alias("open"))
        .withColumn("_upto", F.sum("open").over(Window.partitionBy("exchange").orderBy("date")))
    )
    at = lambda k: counted.select(F.col("exchange").alias(f"_x{k}"), F.col("date").alias(f"_d{k}"), F.col("_upto").alias(f"_n{k}"))
    both = placed.join(at(1), (F.col("_exchange") == F.col("_x1")) & (F.col("date") == F.col("_d1")), "left").join(at(0), (F.col("_exchange") == F.col("_x0")) & (F.col("_before") == F.col("_d0")), "left")
    return both.select(*[obs[c] for c in obs.columns], F.greatest(F.coalesce(F.col("_n1") - F.col("_n0"), F.lit(0)), F.lit(0)).cast("bigint").alias(name))


def next_open_day(snapshots: DataFrame, calendar: DataFrame) -> DataFrame:
    """Snapshots (snapshot_date, ...) with the first open day after theirs as effective_date."""
    days = calendar.filter("is_open = 1").select(F.col("cal_date").alias("day")).distinct()
    # The calendar and the snapshot dates are both short: one ordered pass over their union.
    line = days.select("day", F.lit(True).alias("is_day")).unionByName(snapshots.select(F.col("snapshot_date").alias("day"), F.lit(False).alias("is_day")).distinct())
    later = F.min(F.when(F.col("is_day"), F.col("day"))).over(Window.orderBy(F.unix_date("day")).rangeBetween(1, Window.unboundedFollowing))
    effective = line.withColumn("effective_date", later).filter("not is_day").select(F.col("day").alias("snapshot_date"), "effective_date")
    return snapshots.join(effective, "snapshot_date", "left")


def members_at(obs: DataFrame, snapshots: DataFrame, flag: str = "member") -> DataFrame:
    """Whether a security is in the snapshot in force on its date: from effective_date until the next one's."""
    dates = snapshots.select("index_code", "effective_date").distinct().withColumn("until", F.lead("effective_date").over(Window.partitionBy("index_code").orderBy("effective_date")))
    spans = snapshots.select("index_code", F.col("con_code").alias("code"), "effective_date").join(dates, ["index_code", "effective_date"]).select("code", F.col("effective_date").alias("start"), F.date_sub("until", 1).alias("end"))
    return in_interval(obs, spans, flag)


def check_snapshots(snapshots: DataFrame, expected: int, tolerance: int = 0) -> DataFrame:
    """Snapshots whose number of members is off, or that name a member twice."""
    sizes = snapshots.groupBy("index_code", "snapshot_date").agg(F.count("*").alias("rows"), F.count_distinct("con_code").alias("members"))
    return sizes.filter((F.abs(F.col("members") - expected) > tolerance) | (F.col("rows") != F.col("members")))
