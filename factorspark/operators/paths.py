"""Operators on the shape of a window's path, and on the last distinct level of a security."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .elementwise import _ratio
from .rolling import WINDOWS, _values, spec
from .windows import EPS, at_least_one, trailing


def _missing() -> Column:
    return F.lit(None).cast("double")


def _moves(own: Column, k: int) -> Column:
    """Differences of neighbouring values of the window, oldest first."""
    return F.zip_with(F.slice(own, 2, k - 1), F.slice(own, 1, k - 1), lambda b, a: b - a)


def _floor(ctx, x: Column, k: int) -> Column:
    return ctx.let(at_least_one(F.max(F.abs(x)).over(trailing(k))) * EPS)


def _efficiency(ctx, x: Column, k: int) -> Column:
    if k < 2:
        return _missing()
    own, floor = _values(ctx, x, k), _floor(ctx, x, k)
    path = F.aggregate(_moves(own, k), F.lit(0.0), lambda acc, d: acc + F.abs(d))
    return F.when(path > floor, F.abs(F.element_at(own, k) - F.element_at(own, 1)) / F.when(path > floor, path))


def _sign(d: Column, floor: Column) -> Column:
    return F.when(d > floor, 1).when(d < -floor, -1).otherwise(0)


def _turning(ctx, x: Column, k: int) -> Column:
    if k < 2:
        return _missing()
    own, floor = _values(ctx, x, k), _floor(ctx, x, k)
    signs = F.filter(F.transform(_moves(own, k), lambda d: _sign(d, floor)), lambda s: s != 0)
    start = F.struct(F.lit(0).alias("last"), F.lit(0).alias("turns"))
    turns = F.aggregate(signs, start, lambda acc, s: F.struct(s.alias("last"), (acc["turns"] + F.when(acc["last"] * s < 0, 1).otherwise(0)).alias("turns")), lambda acc: acc["turns"])
    return F.when(F.size(signs) >= 2, turns / F.when(F.size(signs) >= 2, F.size(signs) - 1))


def _run(ctx, x: Column, k: int) -> Column:
    if k < 2:
        return _missing()
    own, floor = _values(ctx, x, k), _floor(ctx, x, k)
    signs = F.transform(_moves(own, k), lambda d: _sign(d, floor))
    start = F.struct(F.lit(0).alias("sign"), F.lit(0).alias("n"))
    # The run that is open at the end: its length restarts whenever the sign changes.
    end = F.aggregate(signs, start, lambda acc, s: F.struct(s.alias("sign"), F.when(s == acc["sign"], acc["n"] + 1).otherwise(1).alias("n")))
    return F.when(end["sign"] != 0, end["sign"] * end["n"] / float(k - 1))


def _pair_signs(own: Column, k: int) -> Column:
    """Signs of moves that exceed the tolerance of their own two values."""
    def sign(b: Column, a: Column) -> Column:
        return _sign(b - a, F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) * 1e-8)

    return F.zip_with(F.slice(own, 2, k - 1), F.slice(own, 1, k - 1), sign)


def _longest(ctx, x: Column, k: int) -> Column:
    signs = _pair_signs(_values(ctx, x, k), k)
    start = F.struct(F.lit(0).alias("sign"), F.lit(0).alias("n"), F.lit(0).alias("best"), F.lit(0).alias("which"))

    def step(acc: Column, s: Column) -> Column:
        n = F.when(s == 0, 0).when(s == acc["sign"], acc["n"] + 1).otherwise(1)
        longer = n >= acc["best"]
        return F.struct(s.alias("sign"), n.alias("n"), F.when(longer, n).otherwise(acc["best"]).alias("best"), F.when(longer, s).otherwise(acc["which"]).alias("which"))

    end = F.aggregate(signs, start, step)
    return F.when(end["best"] > 0, end["which"] * end["best"] / float(k - 1))


def _changes(ctx, x: Column, k: int) -> Column:
    signs = _pair_signs(_values(ctx, x, k), k)
    return F.size(F.filter(signs, lambda s: s != 0)) / float(k - 1) + F.when(signs.isNull(), _missing()).otherwise(0.0)


PATHS = (
    spec("ts_path_efficiency", _efficiency, category="path"),
    spec("ts_turning_rate", _turning, category="path"),
    spec("ts_signed_run_length", _run, category="path"),
)

RUNS = (
    spec("ts_longest_signed_run", _longest, category="path", windows=WINDOWS[1:], unit=_ratio, scale="drops"),
    spec("ts_change_rate", _changes, category="path", windows=WINDOWS[1:], unit=_ratio, scale="drops"),
)


def levels(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(previous level, row on which it was last held) at each row that has a value; a level starts where a value
    leaves the start of its run by more than the tolerance."""
    prior, held = np.full(len(x), np.nan), np.full(len(x), -1)
    level = before = np.nan
    end = -1
    for i in np.flatnonzero(~np.isnan(x)).tolist():
        v = x[i]
        if level != level:
            level = v
        elif abs(v - level) > max(abs(v), abs(level), 1.0) * 1e-8:
            before, end, level = level, i - 1, v
        prior[i], held[i] = before, end
    return prior, held


def _since_change(fn):
    def kernel(x: np.ndarray, k: int) -> np.ndarray:
        prior, held = levels(x)
        row = np.arange(len(x))
        known = ~np.isnan(x) & ~np.isnan(prior) & (row >= k - 1) & (held >= row - k + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(known, fn(x, prior, row - held - 1), np.nan)

    return kernel


EVENTS = (
    spec("ts_last_change", category="event_state", windows=WINDOWS[1:], kernel=_since_change(lambda x, p, n: x - p)),
    spec("ts_last_pct_change", category="event_state", windows=WINDOWS[1:], kernel=_since_change(lambda x, p, n: np.where(np.abs(p) > EPS, x / p - 1, np.nan)), unit=_ratio),
    spec("ts_days_since_change", category="event_state", windows=WINDOWS[1:], kernel=_since_change(lambda x, p, n: n), unit=lambda args: "observation_offset"),
)
