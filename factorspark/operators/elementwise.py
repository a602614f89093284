"""Operators on the cells of one row: arithmetic, comparisons, choices, and the entry-exit state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.model import NUMBER, PANEL, SCALAR, Kind, OperatorSpec, Phase
from .windows import EPS, so_far

BOOL = frozenset({Kind.BOOL})


def _first_unit(args) -> str:
    return next((a.unit for a in args if a.is_panel), "scalar")


def _ratio(args) -> str:
    return "ratio"


def _product_unit(args) -> str:
    return "*".join(sorted(a.unit for a in args if a.is_panel))


def _quotient_unit(args) -> str:
    top, bottom = args
    if not bottom.is_panel:
        return top.unit
    if not top.is_panel:
        return f"1/{bottom.unit}"
    return "ratio" if top.unit == bottom.unit else f"{top.unit}/{bottom.unit}"


def _both(pick):
    return lambda ctx, a, b: F.when(a.isNotNull() & b.isNotNull(), pick(a, b))


def _trade_when(ctx, entry: Column, alpha: Column, leave: Column) -> Column:
    # A struct keeps an alpha that is itself missing apart from "no event today".
    event = F.when(F.coalesce(entry, F.lit(False)), F.struct(alpha.alias("v"))).when(F.coalesce(leave, F.lit(False)), F.struct(F.lit(None).cast("double").alias("v")))
    return F.last(event, ignorenulls=True).over(so_far()).getField("v")


def _binary(name: str, lower, **more) -> OperatorSpec:
    return OperatorSpec(name, "arithmetic", (NUMBER, NUMBER), Phase.ROW, lower, needs_panel=True, **more)


def _unary(name: str, lower, **more) -> OperatorSpec:
    return OperatorSpec(name, "arithmetic", (PANEL,), Phase.ROW, lower, **more)


ARITHMETIC = (
    _binary("add", lambda ctx, a, b: a + b, commutative=True, equal_units=True, unit=_first_unit),
    _binary("sub", lambda ctx, a, b: a - b, equal_units=True, unit=_first_unit),
    _binary("mul", lambda ctx, a, b: a * b, commutative=True, unit=_product_unit),
    _binary("div", lambda ctx, a, b: a / F.when(F.abs(b) > EPS, b), unit=_quotient_unit, scale="pair"),
    _unary("neg", lambda ctx, a: -a),
    _unary("abs", lambda ctx, a: F.abs(a), aliases=("absolute",)),
    _unary("signed_log", lambda ctx, a: F.signum(a) * F.log1p(F.abs(a))),
    _unary("signed_sqrt", lambda ctx, a: F.signum(a) * F.sqrt(F.abs(a))),
    _unary("sign", lambda ctx, a: F.signum(a), unit=_ratio, scale="drops"),
    OperatorSpec(
        "signed_power", "arithmetic", (PANEL, SCALAR), Phase.ROW, lambda ctx, a, p: F.signum(a) * F.pow(F.abs(a), p), domain=((1, (0.5, 1.5, 2, 3)),), unit=lambda args: f"nonlinear({args[0].unit},{args[1].node.value})"
    ),
    _binary("panel_min", _both(F.least), commutative=True, equal_units=True, unit=_first_unit),
    _binary("panel_max", _both(F.greatest), commutative=True, equal_units=True, unit=_first_unit),
)


def _comparison(name: str, lower) -> OperatorSpec:
    return OperatorSpec(name, "comparison", (NUMBER, NUMBER), Phase.ROW, lower, output=Kind.BOOL, needs_panel=True, equal_units=True, unit=lambda args: "boolean")


COMPARISONS = (
    _comparison("gt", lambda ctx, a, b: a > b), _comparison("ge", lambda ctx, a, b: a >= b), _comparison("lt", lambda ctx, a, b: a < b), _comparison("le", lambda ctx, a, b: a <= b),
)

CHOICES = (
    OperatorSpec(
        "where", "conditional", (BOOL, NUMBER, NUMBER), Phase.ROW, lambda ctx, c, a, b: F.when(c.isNull(), None).when(c, a).otherwise(b), equal_units=True, unit=lambda args: next((a.unit for a in args[1:] if a.is_panel), "ratio")
    ),
)

STATE = (
    OperatorSpec(
        "trade_when", "stateful", (BOOL, PANEL, BOOL), Phase.CODE, _trade_when, lookback="stateful", cost=2, unit=lambda args: args[1].unit, causal="forward_state_only_entry_priority", missing="missing_conditions_false_entry_alpha_preserved"
    ),
)
