"""Typed expressions to one staged DataFrame plan.

All expressions of a batch share their sub-expressions by canonical text. Calls are dealt to phases: what needs a security's
rows together (code) and what needs a date's rows together (date) alternate, each call in the earliest phase its inputs
allow, so the panel is shuffled once a phase however many operators it holds. Inside a phase, calls that build on each
other are consecutive projections over the same partitioning. Python runs only for kernels, once a level for all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ExpressionError
from .compiler import Compiled
from .model import Call, Catalog, Constant, Field, Kind, Node, Phase, canonical

#: Operators that can leave the range of doubles.
GROWING = {"add", "sub", "mul", "div", "signed_power", "ts_product", "ts_sum", "ts_delta", "ts_pct_change", "ts_cov", "ts_beta"}


class Context:
    """Gives lowering functions intermediate columns: a window cannot be used inside another or inside a lambda."""

    def __init__(self, prefix: str):
        self.prefix, self.held = prefix, []

    def let(self, column: Column) -> Column:
        name = f"{self.prefix}_{len(self.held)}"
        self.held.append((name, column))
        return F.col(name)


def _name(node: Node) -> str:
    return "e_" + hashlib.sha256(canonical(node).encode()).hexdigest()[:16]


class Plan:
    def __init__(self, operators: Catalog, fields: Catalog, expressions: Iterable[Compiled], mask: str = "in_universe"):
        self.operators, self.fields, self.mask = operators, fields, mask
        self.expressions = list(expressions)
        for e in self.expressions:
            if e.output_type is not Kind.FLOAT:
                raise ExpressionError("TYPE_MISMATCH", f"an expression must give {Kind.FLOAT.value}, not {e.output_type.value}", e.canonical)
        self.place: dict[str, tuple[int, int, Call]] = {}
        for e in self.expressions:
            self._visit(e.root)

    def _visit(self, node: Node) -> tuple[int, int]:
        """(phase, level) from which a node's value is there. Even phases hold securities together, odd ones dates."""
        if not isinstance(node, Call):
            return 0, 0
        name = _name(node)
        if name in self.place:
            return self.place[name][:2]
        below = [self._visit(a) for a in node.arguments]
        phase = max((p for p, _ in below), default=0)
        kind = self.operators.get(node.operator).phase
        if kind is not Phase.ROW and (phase % 2 == 1) != (kind is Phase.DATE):
            phase += 1
        level = 1 + max((lv for p, lv in below if p == phase), default=0)
        self.place[name] = phase, level, node
        return phase, level

    def _column(self, node: Node) -> Column | int | float:
        if isinstance(node, Constant):
            return node.value
        if isinstance(node, Field):
            spec = self.fields.get(node.name)
            return F.col(spec.column or spec.name)
        return F.col(_name(node))

    def _lowered(self, name: str, call: Call) -> tuple[list[tuple[str, Column]], Column]:
        spec, context = self.operators.get(call.operator), Context(name)
        args = []
        for i, a in enumerate(call.arguments):
            value = self._column(a)
            if isinstance(a, Constant):
                # Window lengths stay plain numbers; other constants meet panels as doubles.
                value = value if any(j == i and spec.lookback != "max_children" for j, _ in spec.domain) else F.lit(float(value))
            elif spec.masked:
                value = F.when(F.col(self.mask), value)
            args.append(value)
        got = spec.lower(context, *args)
        if spec.output is Kind.FLOAT:
            got = got.cast("double")
        if call.operator in GROWING:
            got = F.when(F.abs(got) == float("inf"), F.raise_error(F.lit(f"NONFINITE_OUTPUT: {call.operator}")).cast("double")).otherwise(got)
        return context.held, got

    def apply(self, panel: DataFrame) -> DataFrame:
        """``panel`` with a column for each call."""
        steps: dict[tuple[int, int], list[tuple[str, Call]]] = {}
        for name, (phase, level, call) in self.place.items():
            steps.setdefault((phase, level), []).append((name, call))
        for _, calls in sorted(steps.items()):
            kernels = [(n, c) for n, c in calls if self.operators.get(c.operator).kernel]
            plain = [(n, *self._lowered(n, c)) for n, c in calls if not self.operators.get(c.operator).kernel]
            held = [x for _, own, _ in plain for x in own]
            waiting = dict(held)
            while waiting:  # intermediates may build on earlier ones of the same call, one step at a time
                now = {}
                for _, own, _ in plain:
                    nxt = next(((k, c) for k, c in own if k in waiting), None)
                    if nxt:
                        now[nxt[0]] = nxt[1]
                panel = panel.withColumns(now)
                for k in now:
                    del waiting[k]
            if plain:
                panel = panel.withColumns({n: c for n, _, c in plain}).drop(*[k for k, _ in held])
            if kernels:
                panel = self._kernels(panel, kernels)
        return panel

    def _kernels(self, panel: DataFrame, calls: list[tuple[str, Call]]) -> DataFrame:
        jobs = []
        for name, call in calls:
            inputs = [a for a in call.arguments if not isinstance(a, Constant)]
            columns = [(self.fields.get(a.name).column or a.name) if isinstance(a, Field) else _name(a) for a in inputs]
            jobs.append((name, self.operators.get(call.operator).name, columns, [a.value for a in call.arguments if isinstance(a, Constant)]))
        found = {n: self.operators.get(c.operator).kernel for n, c in calls}
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in panel.schema] + [f"`{n}` double" for n, *_ in jobs])

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("pos")
            for name, _, columns, constants in jobs:
                got = found[name](*[table.column(c).to_numpy().astype(float) for c in columns], *constants)
                table = table.append_column(name, pa.array(np.asarray(got, float), pa.float64(), from_pandas=True))
            return table

        return panel.groupBy("code").applyInArrow(run, schema)

    def results(self, panel: DataFrame, *keep: str | Column) -> DataFrame:
        """(code, date, <factor id of each expression>), null outside the universe."""
        done = self.apply(panel)
        outputs = {e.factor_id: F.when(F.col(self.mask), self._column(e.root).cast("double")) for e in self.expressions}
        return done.select("code", "date", *keep, *[c.alias(k) for k, c in outputs.items()])
