"""What a missing observation may be filled with, and rolling statistics on the fixed calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.windows import so_far, trailing


def carry(panel: DataFrame, prices: list[str], flows: list[str], suspended: str = "suspended") -> DataFrame:
    """Confirmed suspensions filled: prices are carried from the last observation unless an unexplained gap lies between,
    volumes and amounts become zero."""
    out = {}
    stopped = F.coalesce(F.col(suspended), F.lit(False))
    for c in prices:
        seen = F.last(F.when(F.col(c).isNotNull(), F.col("pos")), ignorenulls=True).over(so_far())
        barrier = F.last(F.when(F.col(c).isNull() & ~stopped, F.col("pos")), ignorenulls=True).over(so_far())
        fill = F.col(c).isNull() & stopped & (seen > F.coalesce(barrier, F.lit(-1)))
        out[c] = F.when(fill, F.last(c, ignorenulls=True).over(so_far())).otherwise(F.col(c))
    for c in flows:
        out[c] = F.when(F.col(c).isNull() & stopped, F.lit(0.0)).otherwise(F.col(c))
    return panel.withColumns(out)


def forward_fill(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Valuation prices: the last one seen, without conditions."""
    return panel.withColumns({c: F.last(c, ignorenulls=True).over(so_far()) for c in columns})


def observation_class(members: DataFrame, bars: DataFrame, states: DataFrame, name: str = "observation_state") -> DataFrame:
    """Member-days by whether they have a bar and what their market state says; an unknown state is no suspension."""
    keys = ["code", "date"]
    joined = members.join(bars.select(*keys, F.lit(True).alias("_bar")), keys, "left").join(states.select(*keys, F.col("is_suspended").alias("_stop")), keys, "left")
    bar, stop = F.col("_bar").isNotNull(), F.col("_stop")
    label = (
        F.when(bar & stop.isNull(), "observed_state_unknown").when(bar & ~stop, "observed_trading").when(bar, "confirmed_suspension_with_bar")
        .when(stop.isNull(), "unknown_state_missing_bar").when(stop, "confirmed_suspension_no_bar").otherwise("confirmed_non_suspension_missing_bar")
    )
    return joined.withColumn(name, label).drop("_bar", "_stop")


def calendar_mean(x: str, window: int, least: int) -> Column:
    """Mean over the last ``window`` grid rows where at least ``least`` have a value."""
    return F.when(F.count(x).over(trailing(window)) >= least, F.avg(x).over(trailing(window)))


def calendar_slope(x: str, window: int, least: int) -> Column:
    """Slope on grid positions over the observed rows of the last ``window``."""
    return F.when(F.count(x).over(trailing(window)) >= max(2, least), F.regr_slope(F.col(x), F.col("pos").cast("double")).over(trailing(window)))


def observed_mean(panel: DataFrame, x: str, window: int, name: str) -> DataFrame:
    """Mean over the last ``window`` observed rows, at observed rows only."""
    nth = F.count(x).over(so_far())
    own = Window.partitionBy("code", F.col(x).isNotNull()).orderBy("pos").rowsBetween(-(window - 1), 0)
    return panel.withColumn(name, F.when(F.col(x).isNotNull() & (nth >= window), F.avg(x).over(own)))
