"""Operators over the last rows of one security. A window counts grid rows and must be complete."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.model import PANEL, Kind, OperatorSpec, Phase
from .elementwise import _ratio
from .windows import EPS, at_least_one, full, path, trailing

#: Window lengths that expressions may ask for.
WINDOWS = (1, 2, 3, 5, 10, 20, 40, 60, 120, 252)
INT = frozenset({Kind.INT})


def _lag(x: Column, k: int) -> Column:
    return F.lag(x, k).over(path())


def _where_full(fn):
    return lambda ctx, x, k: F.when(full(k, x), fn(x).over(trailing(k)))


def _zscore(ctx, x: Column, k: int) -> Column:
    spread = F.stddev_samp(x).over(trailing(k))
    return F.when(full(k, x), F.when(spread == 0, 0.0).when(spread > EPS, (x - F.avg(x).over(trailing(k))) / spread))


def _scale(ctx, x: Column, k: int) -> Column:
    low = F.min(x).over(trailing(k))
    span = F.max(x).over(trailing(k)) - low
    return F.when(full(k, x) & (F.abs(span) > EPS), (x - low) / F.when(F.abs(span) > EPS, span))


def _uneven(x: Column, k: int) -> Column:
    """Whether the window's spread is above rounding."""
    return F.stddev_samp(x).over(trailing(k)) > at_least_one(F.max(F.abs(x)).over(trailing(k))) * EPS


def _skew(ctx, x: Column, k: int) -> Column:
    if k < 3:
        return F.lit(None).cast("double")
    return F.when(full(k, x) & _uneven(x, k), F.skewness(x).over(trailing(k)) * ((k * (k - 1)) ** 0.5 / (k - 2)))


def _kurt(ctx, x: Column, k: int) -> Column:
    if k < 4:
        return F.lit(None).cast("double")
    return F.when(full(k, x) & _uneven(x, k), (F.kurtosis(x).over(trailing(k)) * (k + 1) + 6) * ((k - 1) / ((k - 2) * (k - 3))))


def _slope(ctx, x: Column, k: int) -> Column:
    return F.when(full(k, x), F.regr_slope(x, F.col("pos").cast("double")).over(trailing(k)))


def _r2(ctx, x: Column, k: int) -> Column:
    r2 = F.regr_r2(x, F.col("pos").cast("double")).over(trailing(k))
    return F.when(full(k, x) & (F.var_samp(x).over(trailing(k)) > 0), F.least(F.greatest(r2, F.lit(0.0)), F.lit(1.0)))


def _decay(ctx, x: Column, k: int) -> Column:
    # The weight of a row is its position less the window's, so two window sums give the weighted one.
    pos = F.col("pos").cast("double")
    weighted = F.sum(x * pos).over(trailing(k)) - (pos - k) * F.sum(x).over(trailing(k))
    return F.when(full(k, x), weighted / (k * (k + 1) / 2))


def _values(ctx, x: Column, k: int) -> Column:
    """The window as an array in date order, or null where it is not complete."""
    return ctx.let(F.when(full(k, x), F.collect_list(x).over(trailing(k))))


def _twice_rank(ctx, x: Column, k: int) -> Column:
    """2 * (values below) + (other values equal): an integer from 0 to 2k - 2."""
    own, cur = _values(ctx, x, k), ctx.let(x)
    return F.aggregate(own, F.lit(-1), lambda acc, v: acc + F.when(v < cur, 2).when(v == cur, 1).otherwise(0))


def _rank(ctx, x: Column, k: int) -> Column:
    twice = _twice_rank(ctx, x, k)
    return twice / (2.0 * (k - 1)) if k > 1 else twice * 0.0


def _gaussianize(ctx, x: Column, k: int) -> Column:
    normal, low = NormalDist(), 0.5 / k
    table = F.array(*[F.lit(normal.inv_cdf(min(max(i / (2 * (k - 1)) if k > 1 else 0.0, low), 1 - low))) for i in range(2 * k - 1)])
    twice = _twice_rank(ctx, x, k)
    return F.when(twice.isNotNull(), F.element_at(table, F.coalesce(twice, F.lit(0)) + 1))


def _since_extreme(pick):
    def lower(ctx, x: Column, k: int) -> Column:
        own = _values(ctx, x, k)
        top = ctx.let(pick(x).over(trailing(k)))
        last = F.array_max(F.transform(own, lambda v, i: F.when(F.abs(v - top) <= EPS + EPS * F.abs(top), i + 1).otherwise(0)))
        return (k - last).cast("double")

    return lower


def _mean_abs_dev(ctx, x: Column, k: int) -> Column:
    own, mean = _values(ctx, x, k), ctx.let(F.avg(x).over(trailing(k)))
    return F.aggregate(own, F.lit(0.0), lambda acc, v: acc + F.abs(v - mean)) / k


def ema(x: np.ndarray, span: int) -> np.ndarray:
    """Exponential mean with alpha 2/(span+1), weights by absolute position across gaps, none before ``span`` values."""
    return pd.Series(x).ewm(span=span, adjust=False, min_periods=span).mean().to_numpy()


def spec(name: str, lower=None, aliases: tuple[str, ...] = (), rule: str = "rolling", category: str = "time_series", windows=WINDOWS, **more) -> OperatorSpec:
    return OperatorSpec(name, category, (PANEL, INT), Phase.CODE, lower, aliases=aliases, domain=((1, windows),), lookback=rule, **more)


ROLLING = (
    spec("ts_delay", lambda ctx, x, k: _lag(x, k), ("delay", "ref"), "delay"),
    spec("ts_delta", lambda ctx, x, k: x - _lag(x, k), ("delta",), "delay"),
    spec("ts_pct_change", lambda ctx, x, k: x / F.when(F.abs(_lag(x, k)) > EPS, _lag(x, k)) - 1, ("pct_change",), "delay", unit=_ratio, scale="drops"),
    spec("ts_sum", _where_full(F.sum)),
    spec("ts_mean", _where_full(F.avg), ("mean",)),
    spec("ts_std", _where_full(F.stddev_samp), ("std",)),
    spec("ts_min", _where_full(F.min)),
    spec("ts_max", _where_full(F.max)),
    spec("ts_rank", _rank, unit=_ratio, scale="drops"),
    spec("ts_argmin", _since_extreme(F.min), unit=lambda args: "observation_offset", scale="drops"),
    spec("ts_argmax", _since_extreme(F.max), unit=lambda args: "observation_offset", scale="drops"),
    spec("ts_zscore", _zscore, unit=_ratio, scale="drops"),
    spec("ts_ema", None, ("ema",), kernel=ema),
    spec("ts_decay_linear", _decay, ("decay_linear",)),
    spec("ts_scale", _scale, unit=_ratio, scale="drops"),
    spec("ts_skew", _skew, unit=_ratio, scale="drops"),
    spec("ts_kurt", _kurt, unit=_ratio, scale="drops"),
    spec("ts_slope", _slope, unit=lambda args: f"{args[0].unit}/observation"),
    spec("ts_r2", _r2, unit=_ratio, scale="drops"),
    spec("ts_product", _where_full(F.product), unit=lambda args: "ratio" if args[0].unit == "ratio" else f"product({args[0].unit})"),
)

ROBUST = (
    spec("ts_median", lambda ctx, x, k: F.when(full(k, x), F.percentile(x, F.lit(0.5)).over(trailing(k))), category="robust_distribution", windows=WINDOWS[1:]),
    spec("ts_mean_abs_dev", _mean_abs_dev, category="robust_distribution", windows=WINDOWS[1:]),
    spec("ts_gaussianize", _gaussianize, category="distribution_transform", windows=WINDOWS[1:], unit=_ratio, scale="drops"),
)
