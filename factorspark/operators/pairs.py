"""Operators over the last rows of two series of one security; a window is complete where both are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.model import PANEL, OperatorSpec, Phase
from .elementwise import _ratio
from .rolling import INT, WINDOWS
from .windows import EPS, at_least_one, full, trailing


def _cov(x: Column, y: Column, k: int) -> Column:
    return F.covar_samp(x, y).over(trailing(k))


def _corr(ctx, x: Column, y: Column, k: int) -> Column:
    # Not the built-in correlation: over a flat window it divides by zero, which is an error in ANSI mode.
    a, b = F.stddev_samp(x).over(trailing(k)), F.stddev_samp(y).over(trailing(k))
    some = full(k, x, y) & (a > EPS) & (b > EPS)
    return F.when(some, F.least(F.greatest(_cov(x, y, k) / F.when(some, a * b), F.lit(-1.0)), F.lit(1.0)))


def _beta(ctx, x: Column, y: Column, k: int) -> Column:
    var = F.var_samp(y).over(trailing(k))
    return F.when(full(k, x, y), _cov(x, y, k) / F.when(var > EPS, var))


def _residual(ctx, y: Column, x: Column, k: int) -> Column:
    w = trailing(k)
    var, floor = F.var_pop(x).over(w), at_least_one(F.max(F.abs(x)).over(w))
    slope = F.covar_pop(y, x).over(w) / F.when(var * k > floor * floor * 1e-24, var)
    return F.when(full(k, x, y), y - F.avg(y).over(w) - slope * (x - F.avg(x).over(w)))


def _spec(name: str, lower, aliases=(), windows=WINDOWS, **more) -> OperatorSpec:
    return OperatorSpec(name, "pairwise", (PANEL, PANEL, INT), Phase.CODE, lower, aliases=aliases, domain=((2, windows),), lookback="rolling", **more)


PAIRS = (
    _spec("ts_corr", _corr, ("correlation",), commutative=True, unit=_ratio, scale="drops"),
    _spec("ts_cov", lambda ctx, x, y, k: F.when(full(k, x, y), _cov(x, y, k)), ("covariance",), commutative=True, unit=lambda args: "*".join(sorted(a.unit for a in args[:2]))),
    _spec("ts_beta", _beta, ("beta",), unit=lambda args: "ratio" if args[0].unit == args[1].unit else f"{args[0].unit}/{args[1].unit}", scale="pair"),
)

REGRESSION = (_spec("ts_regression_residual", _residual, windows=WINDOWS[1:]),)
