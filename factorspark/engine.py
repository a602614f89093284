"""Expressions over panels, one or many at a time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from .errors import ExpressionError
from .operators.catalogs import catalog
from .plans.compiler import Compiled, Compiler
from .plans.lowering import Plan
from .plans.model import Basis, Catalog, FieldSpec, Kind

#: The core fields of a daily equity panel.
CORE_FIELDS = (
    *[FieldSpec(n, unit="price", basis=Basis.HFQ_PIT) for n in ("open", "high", "low", "close")],
    FieldSpec("volume", unit="shares"),
    FieldSpec("amount", unit="currency"),
)


#: Sidecar fields by their source, with units.
SIDECARS = {
    "daily_basic": {"turnover_free": "ratio", "volume_ratio": "ratio", "pb": "ratio", "circ_mv": "currency_10k"},
    "moneyflow": {n: "ratio" for n in ("small_flow_imbalance", "medium_flow_imbalance", "large_flow_imbalance", "extra_large_flow_imbalance", "total_flow_imbalance", "large_flow_share")},
}


def sidecar_fields() -> tuple[FieldSpec, ...]:
    return tuple(FieldSpec(n, unit=u) for fields in SIDECARS.values() for n, u in fields.items())


def field_catalog(version: str = "production_daily_fields_v1", extra: tuple[FieldSpec, ...] = ()) -> Catalog:
    return Catalog(version, (*CORE_FIELDS, *extra))


def category(name: str, column: str = "") -> FieldSpec:
    return FieldSpec(name, Kind.CATEGORY, "category", column=column)


@dataclass(frozen=True)
class Rejected:
    """An expression of a batch that could not be compiled."""

    expression: str
    code: str
    message: str


class Engine:
    """Compiles against a pair of catalogs and evaluates over long panels (code, date, pos, in_universe, fields)."""

    def __init__(self, operators: Catalog | None = None, fields: Catalog | None = None):
        self.operators, self.fields = operators or catalog(), fields or field_catalog()
        self.compiler = Compiler(self.operators, self.fields)

    def compile(self, expression: str) -> Compiled:
        return self.compiler.compile(expression)

    def compile_many(self, expressions: list[str]) -> tuple[list[Compiled], list[Rejected]]:
        """Those that compile, and the others as rows; two expressions of one canonical form are an error."""
        good, bad = [], []
        for text in expressions:
            try:
                good.append(self.compile(text))
            except ExpressionError as e:
                bad.append(Rejected(text, e.code, e.message))
        if len({c.canonical for c in good}) < len(good):
            raise ValueError("two expressions of the batch are the same")
        return good, bad

    def plan(self, *compiled: Compiled, mask: str = "in_universe") -> Plan:
        return Plan(self.operators, self.fields, compiled, mask)

    def evaluate(self, panel: DataFrame, *expressions: str, mask: str = "in_universe") -> DataFrame:
        """(code, date, <factor id>...) of the expressions, in one plan."""
        return self.plan(*map(self.compile, expressions), mask=mask).results(panel)
