"""Operators over the securities of one date, and within a category of one date. Their inputs are masked to the universe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.model import PANEL, Kind, OperatorSpec, Phase
from .elementwise import _ratio
from .windows import EPS, at_least_one, average_rank, day, within

CATEGORY = frozenset({Kind.CATEGORY})


def plain_rank(ctx, x: Column) -> Column:
    return average_rank(x, day(), F.count(x).over(day()))


def stable_rank(ctx, x: Column) -> Column:
    """Ranks values that agree to twelve digits of the date's largest as equal."""
    top = F.max(F.abs(x)).over(day())
    key = ctx.let(F.bround(x / F.when(top > 0, top).otherwise(1.0), 12))
    return average_rank(key, day(), F.count(key).over(day()))


def _zscore(ctx, x: Column) -> Column:
    spread = F.stddev_pop(x).over(day())
    flat = spread <= at_least_one(F.max(F.abs(x)).over(day())) * EPS
    return F.when(x.isNull(), None).when(flat, 0.0).otherwise((x - F.avg(x).over(day())) / F.when(spread > 0, spread))


def _demean(ctx, x: Column) -> Column:
    return x - F.avg(x).over(day())


def _winsorize(ctx, x: Column, q: Column) -> Column:
    low, high = F.percentile(x, q).over(day()), F.percentile(x, 1 - q).over(day())
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def _residual(ctx, y: Column, x: Column) -> Column:
    both = y.isNotNull() & x.isNotNull()
    y, x = F.when(both, y), F.when(both, x)
    n = F.count(x).over(day())
    var = F.var_pop(x).over(day())
    floor = at_least_one(F.max(F.abs(x)).over(day())) * EPS
    slope = F.covar_pop(y, x).over(day()) / F.when((n >= 3) & (var * n > n * floor * floor), var)
    return (y - F.avg(y).over(day())) - slope * (x - F.avg(x).over(day()))


def _grouped(x: Column, group: Column) -> Column:
    return F.when(group.isNotNull(), x)


def _group_demean(ctx, x: Column, g: Column) -> Column:
    x = _grouped(x, g)
    return x - F.avg(x).over(within(g))


def _group_zscore(ctx, x: Column, g: Column) -> Column:
    x = _grouped(x, g)
    mean, spread = F.avg(x).over(within(g)), F.stddev_pop(x).over(within(g))
    flat = spread <= F.greatest(F.lit(1.0), F.abs(mean), F.abs(x)) * EPS
    return F.when(x.isNull(), None).when(flat, 0.0).otherwise((x - mean) / F.when(spread > 0, spread))


def _group_rank(ctx, x: Column, g: Column) -> Column:
    x = _grouped(x, g)
    key = ctx.let(F.bround(x / at_least_one(F.max(F.abs(x)).over(within(g))), 12))
    return average_rank(key, within(g), F.count(key).over(within(g)))


def cross_section(rank) -> tuple[OperatorSpec, ...]:
    def spec(name: str, lower, aliases: tuple[str, ...] = (), inputs=(PANEL,), **more) -> OperatorSpec:
        return OperatorSpec(name, "cross_section", inputs, Phase.DATE, lower, aliases=aliases, masked=True, **more)

    return (
        spec("cs_rank", rank, ("rank",), unit=_ratio), spec("cs_zscore", _zscore, ("zscore",), unit=_ratio), spec("cs_demean", _demean, ("demean",)),
        spec("cs_winsorize", _winsorize, ("winsorize",), (PANEL, frozenset({Kind.REAL})), domain=((1, (0.01, 0.05)),)), spec("cs_residual", _residual, (), (PANEL, PANEL)),
    )


def _group(name: str, lower, **more) -> OperatorSpec:
    return OperatorSpec(name, "group_cross_section", (PANEL, CATEGORY), Phase.DATE, lower, masked=True, **more)


GROUPS = (_group("group_demean", _group_demean), _group("group_rank", _group_rank, unit=_ratio), _group("group_zscore", _group_zscore, unit=_ratio))
