"""Statistics of date series (key..., date, value), one result row a key. Missing values are left out unless said otherwise.

A series is short (one row a date), so ordering it inside its key's partition is cheap; many keys run in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Trading days a year of measurements, and lags of robust errors.
MEASURED_DAYS, LAGS = 242, 20
EPSILON = 2.220446049250313e-16


def _curve(df: DataFrame, keys: list[str], value: str, ret: Column) -> DataFrame:
    """Growth curve from 1, and its running peak, the start included."""
    line = Window.partitionBy(*keys).orderBy("date")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    nav = df.withColumn("_r", ret).withColumn("_nav", F.product(1 + F.col("_r")).over(upto))
    return nav.withColumn("_peak", F.greatest(F.lit(1.0), F.max("_nav").over(upto))).withColumn("_nth", F.row_number().over(line))


def _keyed(keys: list[str]) -> tuple[list[str], list[Column]]:
    return (keys, []) if keys else (["_all"], [F.lit(1).alias("_all")])


def periodic_metrics(df: DataFrame, keys: list[str], value: str = "ret", periods: float = 252.0, clamp: bool = False) -> DataFrame:
    """Return metrics with population deviations. Returns of -1 or less are an error, or clamped just above."""
    r = F.greatest(F.col(value), F.lit(-1.0 + 2.0**-53)) if clamp else F.when(F.col(value) <= -1, F.raise_error(F.lit("returns must be greater than -1")).cast("double")).otherwise(F.col(value))
    own, extra = _keyed(keys)
    rows = df.select("*", *extra).filter(F.col(value).isNotNull())
    low = F.when(F.col("_r") < 0, F.col("_r"))
    g = _curve(rows, own, value, r).groupBy(*own).agg(
        F.count("*").alias("period_count"), F.max_by("_nav", "_nth").alias("_end"), F.avg("_r").alias("_mean"), F.stddev_pop("_r").alias("_sd"), F.stddev_pop(low).alias("_down"),
        F.max((F.col("_peak") - F.col("_nav")) / F.col("_peak")).alias("max_drawdown"), F.avg((F.col("_r") > 0).cast("double")).alias("positive_period_rate"),
        F.max(F.col(value) <= -1).alias("bankrupt"),
    )
    sd = F.when(F.col("_sd") >= EPSILON, F.col("_sd")).otherwise(0.0)
    root = F.lit(periods**0.5)
    out = g.withColumns({"_sd": sd, "total_return": F.col("_end") - 1, "annual_return": F.pow("_end", F.lit(periods) / F.col("period_count")) - 1, "max_drawdown": F.greatest("max_drawdown", F.lit(0.0))})
    return out.select(
        *keys, "period_count", "total_return", "annual_return", (F.col("_sd") * root).alias("annual_volatility"), "max_drawdown",
        F.when(F.col("_sd") > 0, F.col("_mean") / F.when(F.col("_sd") > 0, F.col("_sd")) * root).otherwise(0.0).alias("sharpe"),
        F.when(F.col("_down") > 0, F.col("_mean") / F.when(F.col("_down") > 0, F.col("_down")) * root).otherwise(0.0).alias("sortino"),
        F.when(F.col("max_drawdown") > 0, F.col("annual_return") / F.when(F.col("max_drawdown") > 0, F.col("max_drawdown"))).otherwise(0.0).alias("calmar"), "positive_period_rate", *(["bankrupt"] if clamp else []),
    )


def newey_west(df: DataFrame, keys: list[str], value: str, name: str = "hac_t_stat", lags: int = LAGS) -> DataFrame:
    """t-statistic of the mean with Bartlett weights; null under three values or without positive variance."""
    own, extra = _keyed(keys)
    line = Window.partitionBy(*own).orderBy("date")
    whole = Window.partitionBy(*own)
    x = df.select("*", *extra).filter(F.col(value).isNotNull()).withColumn("_c", F.col(value) - F.avg(value).over(whole)).withColumn("_n", F.count("*").over(whole))
    span = F.least(F.lit(lags), F.col("_n") - 1)
    total = F.col("_c") * F.col("_c")
    for j in range(1, lags + 1):
        total = total + F.when(F.lit(j) <= span, 2 * (1 - F.lit(float(j)) / (span + 1)) * F.coalesce(F.lag("_c", j).over(line), F.lit(0.0)) * F.col("_c")).otherwise(0.0)
    g = x.withColumn("_t", total).groupBy(*own).agg(F.count("*").alias("_n"), F.avg(value).alias("_m"), (F.sum("_t") / F.count("*")).alias("_v"))
    return g.select(*keys, F.when((F.col("_n") >= 3) & (F.col("_v") > 0), F.col("_m") / F.sqrt(F.when(F.col("_v") > 0, F.col("_v")) / F.col("_n"))).alias(name))


def return_summary(df: DataFrame, keys: list[str], value: str = "ret") -> DataFrame:
    """Daily returns in the measuring convention: sample deviations, 242 days, drawdown of the curve from 1."""
    own, extra = _keyed(keys)
    rows = df.select("*", *extra).filter(F.col(value).isNotNull())
    g = _curve(rows, own, value, F.col(value)).groupBy(*own).agg(
        F.count("*").alias("observations"), F.avg("_r").alias("mean_daily_return"), F.stddev_samp("_r").alias("_sd"), F.min(F.col("_nav") / F.col("_peak") - 1).alias("_dd"),
        F.avg((F.col("_r") > 0).cast("double")).alias("positive_day_ratio"), (F.max_by("_nav", "_nth") - 1).alias("terminal_growth"),
    )
    root = F.lit(float(MEASURED_DAYS) ** 0.5)
    stats = g.select(
        *own, "observations", "mean_daily_return", (F.col("mean_daily_return") * MEASURED_DAYS).alias("annualized_mean_return"), (F.col("_sd") * root).alias("annualized_volatility"),
        (F.col("mean_daily_return") / F.when(F.col("_sd") > 0, F.col("_sd")) * root).alias("annualized_sharpe"), F.least("_dd", F.lit(0.0)).alias("maximum_drawdown"), "positive_day_ratio", "terminal_growth",
    )
    return stats.join(newey_west(rows, own, value), own, "left").drop("_all")


def rolling_summary(df: DataFrame, keys: list[str], value: str, window: int) -> DataFrame:
    """Annualised mean and Sharpe ratio over each complete window of rows."""
    own, extra = _keyed(keys)
    w = Window.partitionBy(*own).orderBy("date").rowsBetween(-(window - 1), 0)
    some = F.count(value).over(w) >= max(2, window)
    mean, sd = F.avg(value).over(w) * MEASURED_DAYS, F.stddev_samp(value).over(w)
    out = df.select("*", *extra).withColumns({"rolling_mean": F.when(some, mean), "rolling_sharpe": F.when(some, mean / F.when(sd > 0, sd * F.lit(float(MEASURED_DAYS) ** 0.5)))})
    return out.drop("_all")


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    rows = df.filter(F.col(value).isNotNull())
    return rows.groupBy(*keys).agg(
        F.count("*").alias("observations"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.percentile(value, F.lit(0.9)).alias("p90"), F.avg((F.col(value) == 0).cast("double")).alias("zero_ratio")
    )


def yearly_returns(df: DataFrame, keys: list[str], value: str = "ret") -> DataFrame:
    return df.groupBy(*keys, F.year("date").alias("year")).agg((F.product(1 + F.col(value)) - 1).alias("ret"))
