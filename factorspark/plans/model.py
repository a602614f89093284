"""What expressions are made of: types, nodes, fields, operators."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum


class Kind(str, Enum):
    FLOAT = "panel_float"
    BOOL = "panel_bool"
    CATEGORY = "panel_category"
    INT = "scalar_int"
    REAL = "scalar_float"


NUMBER = frozenset({Kind.FLOAT, Kind.INT, Kind.REAL})
SCALAR = frozenset({Kind.INT, Kind.REAL})
PANEL = frozenset({Kind.FLOAT})


class Basis(str, Enum):
    RAW = "raw"
    HFQ_PIT = "hfq_pit"
    QFQ_SNAPSHOT = "qfq_snapshot"


class Phase(str, Enum):
    """What the rows of a result must be together with: nothing, their security, their date."""

    ROW = "row"
    CODE = "code"
    DATE = "date"


@dataclass(frozen=True)
class Field:
    name: str


@dataclass(frozen=True)
class Constant:
    value: int | float


@dataclass(frozen=True)
class Call:
    operator: str
    arguments: tuple[Node, ...]


Node = Field | Constant | Call


def canonical(node: Node) -> str:
    if isinstance(node, Field):
        return node.name
    if isinstance(node, Constant):
        return str(node.value)
    return f"{node.operator}({','.join(map(canonical, node.arguments))})"


_NAME = re.compile(r"[a-z][a-z0-9_]*")


@dataclass(frozen=True)
class FieldSpec:
    """A column an expression may name."""

    name: str
    kind: Kind = Kind.FLOAT
    unit: str = "ratio"
    basis: Basis | None = None
    column: str = ""
    available_at: str = "close"

    def __post_init__(self) -> None:
        if not _NAME.fullmatch(self.name):
            raise ValueError(f"field name {self.name!r} must be lower snake case")
        if self.unit == "price" and self.basis is None:
            raise ValueError("a price field must declare its basis")


@dataclass(frozen=True)
class OperatorSpec:
    """An operator: its contract, and how it is lowered to Spark."""

    name: str
    category: str
    inputs: tuple[frozenset[Kind], ...]
    phase: Phase
    lower: Callable | None = None  # (context, *columns or constants) -> Column
    kernel: Callable | None = None  # (*arrays of one security in date order, *constants) -> array
    output: Kind = Kind.FLOAT
    aliases: tuple[str, ...] = ()
    domain: tuple[tuple[int, tuple], ...] = ()
    lookback: str = "max_children"
    commutative: bool = False
    cost: int = 1
    needs_panel: bool = False
    unit: Callable = field(default=lambda args: args[0].unit)
    equal_units: bool = False
    scale: str = "keeps"  # keeps, drops, or pair (drops where both inputs share the unit)
    masked: bool = False  # inputs are seen through the universe mask
    version: str = "1"
    causal: str = "same_date_or_backward_only"
    missing: str = "exclude_from_statistics_and_preserve"

    def payload(self) -> dict[str, object]:
        """The contract as plain data."""
        return {
            "name": self.name, "aliases": list(self.aliases), "version": self.version, "category": self.category,
            "input_types": [sorted(k.value for k in allowed) for allowed in self.inputs], "output_type": self.output.value, "causal_contract": self.causal,
            "nan_policy": self.missing, "parameter_domain": [[i, list(v)] for i, v in self.domain], "lookback_rule": self.lookback,
            "commutative": self.commutative, "complexity_cost": self.cost, "example": self.example(),
        }

    def example(self) -> str:
        values = dict(self.domain)
        names = iter(["close", "open", "volume"])
        parts = []
        for i, allowed in enumerate(self.inputs):
            if i in values:
                parts.append(str(values[i][min(3, len(values[i]) - 1)]))
            elif allowed == frozenset({Kind.BOOL}):
                parts.append("gt(close,open)")
            elif allowed == frozenset({Kind.CATEGORY}):
                parts.append("industry")
            else:
                parts.append(next(names))
        return f"{self.name}({','.join(parts)})"


class Catalog:
    """A versioned set of operators or fields, found by name or alias."""

    def __init__(self, version: str, specs: tuple = ()):
        self.version = version
        self.specs: dict[str, object] = {}
        self._by_name: dict[str, object] = {}
        for spec in specs:
            self.add(spec)

    def add(self, spec: object) -> None:
        for name in (spec.name, *getattr(spec, "aliases", ())):
            if name in self._by_name:
                raise ValueError(f"{name} is registered twice")
            self._by_name[name] = spec
        self.specs[spec.name] = spec

    def get(self, name: str) -> object | None:
        return self._by_name.get(name)

    def __contains__(self, name: str) -> bool:
        return name in self._by_name
