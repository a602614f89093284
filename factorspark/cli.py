"""Commands with one JSON line on standard output; exit codes 0, 2 (input) and 70 (internal)."""

from __future__ import annotations

import argparse
import contextlib
import json
import sys
import uuid
from pathlib import Path

from . import artifacts, services
from .engine import Engine
from .errors import ExpressionError

VERSION = "0.1.0"
#: Fixed value: the format of a batch of expressions.
BATCH = "ashare-factor-expression-batch.v1"
#: The commands; with their options below they are the interface.
COMMANDS = ("capabilities", "schema", "doctor", "compile", "inspect-job", "audit-factor", "audit-causality", "measure-factor", "evaluate", "evaluate-batch")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="factorspark")
    sub = top.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        p = sub.add_parser(name)
        p.add_argument("--json", action="store_true")
        p.add_argument("--run-id")
        if name not in ("capabilities", "doctor"):
            p.add_argument("--job", required=name not in ("schema", "compile"))
        if name in ("compile", "audit-factor", "audit-causality", "measure-factor", "evaluate"):
            p.add_argument("expression")
        if name in ("audit-factor", "audit-causality", "measure-factor", "evaluate", "evaluate-batch"):
            p.add_argument("--work-root", required=True)
        if name in ("evaluate", "evaluate-batch"):
            p.add_argument("--through", choices=("screen", "rolling"), default="rolling")
        if name == "evaluate-batch":
            p.add_argument("--expressions-file", required=True)
        if name == "measure-factor":
            p.add_argument("--direction", choices=("high", "low"), required=True)
            p.add_argument("--horizons", default="1,2,3,5,10,20,60")
            p.add_argument("--rolling-windows", default="252,504")
    return top


def integers(text: str, what: str) -> tuple[int, ...]:
    try:
        out = tuple(int(x) for x in text.split(",") if x.strip())
    except ValueError as e:
        raise ValueError(f"{what} must be integers with commas") from e
    if not out:
        raise ValueError(f"{what} must not be empty")
    return out


def expressions(path: str) -> list[str]:
    raw = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(raw, dict) or raw.get("schema") != BATCH or not isinstance(raw.get("expressions"), list) or not raw["expressions"]:
        raise ValueError(f"{path} is no {BATCH} file")
    out = [str(x).strip() for x in raw["expressions"]]
    if not all(out) or len(set(out)) < len(out):
        raise ValueError("expressions must be distinct and not empty")
    return out


def _session():
    from .session import session
    from .shipping import ship

    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def perform(a: argparse.Namespace) -> tuple[str, dict, list[str], list[str], bool]:
    """(command, data, warnings, next actions, passed). The names of next actions are fixed values."""
    if a.command == "capabilities":
        return a.command, {"commands": list(COMMANDS), "engine_version": VERSION, "machine_protocol": artifacts.PROTOCOL, "scope": "factor_evaluation", "excluded_capabilities": ["factor_search", "multi_factor_portfolio", "live_trading"]}, [], ["schema", "doctor"], True
    if a.command == "doctor":
        e = Engine()
        return a.command, {"core": "ready", "operator_catalog_version": e.operators.version, "field_catalog_version": e.fields.version}, ["No data was looked at."], ["compile"], True
    engine = Engine() if a.job is None else services.prepared(_session(), a.job).engine if a.command in ("schema", "compile") else None
    if a.command == "schema":
        return a.command, services.describe(engine), [], ["compile"], True
    if a.command == "compile":
        data = engine.compile(a.expression).payload()
        return a.command, data, data.pop("warnings"), ["evaluate"], True
    spark = _session()
    if a.command == "inspect-job":
        p = services.prepared(spark, a.job)
        return a.command, p.identity() | {"engine_version": VERSION, "trading_dates": len(p.dates), "load_start": p.load_start}, [], ["compile", "audit-factor", "audit-causality", "evaluate"], True
    if a.command == "audit-causality":
        data = services.audit_causality(spark, a.job, a.expression, a.work_root)
        return a.command, data, ["Only the evaluation was checked, not when its data became known."], ["evaluate" if data["passed"] else "fix_expression_or_operator"], data["passed"]
    if a.command == "audit-factor":
        data = services.audit_factor(spark, a.job, a.expression, a.work_root)
        good = data["status"] == "factor_validity_verified"
        return a.command, data, [], ["inspect_artifact"], good
    if a.command == "measure-factor":
        data = services.measure_factor(spark, a.job, a.expression, a.direction, integers(a.horizons, "horizons"), integers(a.rolling_windows, "rolling-windows"), a.work_root)
        return a.command, data, [], ["render_candidate_profile"], True
    compact = lambda d: {k: v for k, v in d.items() if k != "rolling"} | ({"rolling_summary": d["rolling"]["summary"]} if "rolling" in d else {})
    if a.command == "evaluate":
        return f"evaluate.{a.through}", compact(services.evaluate(spark, a.job, a.expression, a.through, a.work_root)), [], ["inspect_artifact"], True
    data = services.evaluate_batch(spark, a.job, expressions(a.expressions_file), a.through, a.work_root)
    return f"evaluate-batch.{a.through}", data | {"candidates": [compact(c) for c in data["candidates"]]}, [], ["inspect_artifacts"], True


def main(argv: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    run = a.run_id or uuid.uuid4().hex
    failed = lambda code, message, *actions: artifacts.protocol_line(a.command, "error", run, {"error": {"code": code, "message": message}}, next_actions=actions)
    code = artifacts.INPUT_ERROR
    try:
        with contextlib.redirect_stdout(sys.stderr):
            command, data, warnings, actions, passed = perform(a)
        code = artifacts.OK if passed else artifacts.INTERNAL_ERROR
        line = artifacts.protocol_line(command, "ok" if passed else "error", run, data, warnings, actions)
    except ExpressionError as e:
        line = failed(e.code, e.message, "fix_expression", "schema")
    except (TypeError, ValueError, OSError) as e:
        line = failed("INVALID_INPUT", str(e), "schema")
    except Exception as e:  # the protocol promises one line whatever happens
        line, code = failed("INTERNAL_ERROR", str(e)[:2000], "doctor"), artifacts.INTERNAL_ERROR
    sys.stdout.write(line)
    return code


if __name__ == "__main__":
    sys.exit(main())
