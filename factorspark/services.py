"""What the commands do: compile, inspect, audit, measure, evaluate, one factor or many."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from pathlib import Path
from time import perf_counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .artifacts import identity, reuse, store
from .engine import Engine
from .errors import DataError
from .evaluation import audits, measure, screen
from .functions import series
from .job import Prepared, load_job
from .plans.parser import fields_of

RETURN_CLOCK = "signal_t_to_open_t_plus_1_to_open_t_plus_2"


def prepared(spark: SparkSession, job: str | Path) -> Prepared:
    return Prepared(spark, load_job(job))


def describe(engine: Engine) -> dict:
    """The catalogs as plain data."""
    return {
        "operator_catalog": {"version": engine.operators.version, "operators": [s.payload() for s in engine.operators.specs.values()]},
        "field_catalog": {"version": engine.fields.version, "fields": [{"name": f.name, "type": f.kind.value, "unit": f.unit, "basis": f.basis.value if f.basis else None, "available_at": f.available_at} for f in engine.fields.specs.values()]},
    }


class Clock:
    """Seconds by stage."""

    def __init__(self):
        self.began, self.seconds = perf_counter(), {}

    def time(self, name: str, f):
        start = perf_counter()
        out = f()
        self.seconds[name] = perf_counter() - start
        return out

    def all(self) -> dict[str, float]:
        return self.seconds | {"total": perf_counter() - self.began}


def audit_causality(spark: SparkSession, job: str | Path, expression: str, work_root: str | Path) -> dict:
    p, clock = prepared(spark, job), Clock()
    cutoff = p.dates[(len(p.dates) - 1) // 2]
    compiled = p.engine.compile(expression)
    plan = p.engine.plan(compiled)
    window = F.col("date").between(F.lit(p.job.start).cast("date"), F.lit(cutoff).cast("date"))
    values = lambda df: plan.results(df).filter(window).select("code", "date", F.col(compiled.factor_id).alias("value"))
    got = clock.time("compare", lambda: audits.compare(values(p.panel()), values(p.panel(cutoff))).first())
    body = {
        "schema_version": "causality-certificate.v1", "status": "causality_violation_detected" if got["mismatches"] else "prefix_invariance_verified", "passed": not got["mismatches"], "job_id": p.job.job_id, "factor_id": compiled.factor_id,
        "canonical": compiled.canonical, "cutoff": cutoff, "compared_cells": got["compared"], "mismatch_cells": got["mismatches"], "first_mismatch": got["first_mismatch"] and str(got["first_mismatch"]), "tolerance": audits.TOLERANCE,
    }
    own = identity(body)
    path = Path(work_root) / "causality" / f"{own}.json"
    store(path, own, body)
    return body | {"certificate_identity": own, "certificate_path": str(path), "timings_seconds": clock.all()}


def audit_factor(spark: SparkSession, job: str | Path, expression: str, work_root: str | Path) -> dict:
    """Coverage and causality without reading a return."""
    p, clock = prepared(spark, job), Clock()
    compiled = p.engine.compile(expression)
    audits.reject_targets(compiled.fields)
    out = p.engine.plan(compiled).results(p.panel(), "in_universe", *compiled.fields).withColumnRenamed(compiled.factor_id, "score")
    inside = out.filter(F.col("date").between(F.lit(p.job.start).cast("date"), F.lit(p.job.end).cast("date"))).persist()
    try:
        rows = [r.asDict() for r in audits.coverage_by_year(inside, list(compiled.fields)).orderBy("year").collect()]  # a row a year
        breadth = audits.breadth(inside).first().asDict()
    finally:
        inside.unpersist()
    causality = audit_causality(spark, job, expression, work_root)
    total = next((r for r in rows if r["year"] == 0), None)
    good = total is not None and total["universe_cells"] > 0 and causality["passed"]
    body = {
        "schema_version": "factor-validity-audit.v1", "status": "factor_validity_verified" if good else "factor_validity_failed", "return_data_read": False, "expression": compiled.payload(), "job_id": p.job.job_id, "universe_view": p.job.view,
        "coverage": {**(total or {}), "by_year": [r for r in rows if r["year"]]}, "measurement_book_preconditions": breadth, "causality": {k: causality[k] for k in ("passed", "cutoff", "compared_cells", "mismatch_cells", "certificate_identity")},
    }
    own = identity(body)
    path = Path(work_root) / "factor_validity" / f"{own}.json"
    store(path, own, body)
    return body | {"audit_identity": own, "artifact_path": str(path), "timings_seconds": clock.all()}


def _summary(df: DataFrame, value: str) -> dict:
    return series.return_summary(df, [], value).first().asDict()


def measure_factor(spark: SparkSession, job: str | Path, expression: str, direction: str, horizons: tuple[int, ...] = (1, 2, 3, 5, 10, 20, 60), windows: tuple[int, ...] = (252, 504), work_root: str | Path = ".") -> dict:
    """The daily measurement of one factor: a trace, a membership table and a summary, reused by content."""
    if not horizons or sorted(set(horizons)) != list(horizons) or min(horizons) <= 0:
        raise ValueError("horizons must be positive, rising and distinct")
    p, clock = prepared(spark, job), Clock()
    compiled = p.engine.compile(expression)
    own = identity([p.identity()["job_identity"], compiled.canonical, direction, horizons, windows])
    folder = Path(work_root) / "measurement" / own
    found = reuse(folder / "summary.json", own)
    if found is not None:
        return found | {"reused": True, "timings_seconds": clock.all()}
    if max(horizons) + 1 >= len(p.dates):
        raise ValueError("the window is shorter than the longest horizon")
    book, _ = p.scored(expression)
    book = book.withColumnRenamed(compiled.factor_id, "score").persist()
    try:
        trace = measure.trace(book, direction).persist()
        trace.coalesce(1).write.mode("overwrite").parquet(str(folder / "trace.parquet"))
        measure.membership(book, direction).coalesce(1).write.mode("overwrite").parquet(str(folder / "membership.parquet"))
        dated = trace.withColumnRenamed("signal_date", "date")
        by_horizon = measure.horizon_curve(book, direction, list(horizons)).persist()
        curve = [r.asDict() for r in by_horizon.orderBy("horizon").collect()]  # a row a horizon
        ic = dated.filter("rank_ic IS NOT NULL")
        quintiles = list(dated.agg(*[F.avg(f"q{i}_return") for i in range(1, 6)]).first())
        body = {
            "schema_version": "factor-daily-measurement.v1", "factor_id": compiled.factor_id, "canonical": compiled.canonical, "direction": direction, "return_clock": RETURN_CLOCK, "trading_days_per_year": series.MEASURED_DAYS,
            **{name: _summary(dated, column) for name, column in (("factor_return", "factor_return"), ("fixed_top20", "top20_return"), ("fixed_bottom20", "bottom20_return"), ("fixed_top_bottom", "top_bottom_return"), ("intraday", "intraday_return"), ("overnight", "overnight_return"))},
            "rank_ic": ic.agg(F.count("*").alias("observations"), F.avg("rank_ic").alias("mean"), F.stddev_samp("rank_ic").alias("standard_deviation"), F.avg((F.col("rank_ic") > 0).cast("double")).alias("positive_ratio")).first().asDict() | series.newey_west(ic, [], "rank_ic").first().asDict(),
            "target_weight_turnover": series.distribution(dated, [], "target_weight_turnover").first().asDict(), "top20_membership_turnover": series.distribution(dated, [], "top20_membership_turnover").first().asDict(),
            "coverage": dated.agg(F.avg("coverage").alias("mean"), F.min("coverage").alias("minimum"), F.count("*").alias("calendar_days"), F.count("factor_return").alias("finite_calendar_return_days"), F.count_if(F.col("gross_exposure") > 0).alias("active_book_days")).first().asDict(),
            "quintile_mean_daily_returns": quintiles, "quintile_monotonicity": measure.monotonicity(quintiles), **measure.extreme_share(dated).first().asDict(), "active_day_factor_return": _summary(dated.filter("gross_exposure > 0"), "factor_return"), "horizon_curve": curve, "horizon_diagnostics": measure.horizon_diagnostics(by_horizon).first().asDict(),
            "rolling": {str(w): series.rolling_summary(dated, [], "factor_return", w).agg(F.count("rolling_sharpe").alias("observations"), F.min("rolling_sharpe").alias("minimum"), F.percentile("rolling_sharpe", F.lit(0.5)).alias("median"), F.max("rolling_sharpe").alias("maximum")).first().asDict() for w in windows},
            "yearly": [r.asDict() for r in series.return_summary(dated.withColumn("year", F.year("date")), ["year"], "factor_return").orderBy("year").collect()],
        }
        by_horizon.unpersist()
        trace.unpersist()
    finally:
        book.unpersist()
    return store(folder / "summary.json", own, body) | {"reused": False, "timings_seconds": clock.all()}


def _evaluate(p: Prepared, panel: DataFrame, compiled, through: str, work: Path, job_identity: str, observe: Callable[[str, dict], None] | None = None) -> dict:
    """Screen, and rolling folds with their gate; each stage stored by identity and reused."""
    book = panel.withColumnRenamed(compiled.factor_id, "score")
    out: dict = {"factor_id": compiled.factor_id, "canonical": compiled.canonical, "reused": []}
    upstream = job_identity
    stages = {"screen": lambda: screen.screen(book, p.job.policy)}
    if through == "rolling":
        stages["rolling"] = lambda: {"folds": (folds := screen.rolling(book, list(p.job.folds), p.job.policy)), "summary": screen.audit(book.sparkSession, folds, p.job.gate)}
    for name, f in stages.items():
        own = identity([upstream, compiled.canonical, name])
        path = work / name / f"{own}.json"
        found = reuse(path, own)
        if found is not None:
            out["reused"].append(name)
        out[name] = found or store(path, own, f())
        out[f"{name}_artifact"], upstream = str(path), own
        if observe is not None:
            observe(name, out[name])
    return out


def evaluate_candidate(spark: SparkSession, job: str | Path, candidate: dict, through: str = "rolling", work_root: str | Path = ".") -> dict:
    """``evaluate`` of a recorded candidate (expression, canonical, factor_id), which must still mean what it meant when it was recorded."""
    now = prepared(spark, job).engine.compile(candidate["expression"])
    drift = {k: (candidate[k], v) for k, v in (("canonical", now.canonical), ("factor_id", now.factor_id)) if candidate.get(k) not in (None, v)}
    if drift:
        raise DataError("; ".join(f"{k} was {old}, is {new}" for k, (old, new) in drift.items()))
    return evaluate(spark, job, candidate["expression"], through, work_root)


def evaluate(spark: SparkSession, job: str | Path, expression: str, through: str = "rolling", work_root: str | Path = ".", observe: Callable[[str, dict], None] | None = None) -> dict:
    """``observe`` is called with each stage's name and result as soon as it is there."""
    p, clock = prepared(spark, job), Clock()
    own = clock.time("prepare", lambda: p.identity()["job_identity"])
    book, compiled = p.scored(expression)
    book = book.persist()
    try:
        clock.time("factor", book.count)
        return clock.time("research", lambda: _evaluate(p, book, compiled[0], through, Path(work_root), own, observe)) | {"timings_seconds": clock.all()}
    finally:
        book.unpersist()


def evaluate_batch(spark: SparkSession, job: str | Path, expressions: list[str], through: str = "rolling", work_root: str | Path = ".") -> dict:
    """Many factors over one pass of the data; a candidate that fails its gates is a row, not an error."""
    p, clock = prepared(spark, job), Clock()
    good, bad = p.engine.compile_many(expressions)
    own = clock.time("prepare", lambda: p.identity()["job_identity"])
    rows: list[dict] = [{"expression": r.expression, "candidate_status": "rejected_expression", "code": r.code, "message": r.message} for r in bad]
    if good:
        book, _ = p.scored(*[c.canonical for c in good])
        book = book.persist()
        try:
            clock.time("factor", book.count)
            for c in good:
                others = [x.factor_id for x in good if x is not c]
                try:
                    rows.append(_evaluate(p, book.drop(*others), c, through, Path(work_root), own) | {"candidate_status": "evaluated"})
                except ValueError as e:
                    rows.append({"factor_id": c.factor_id, "canonical": c.canonical, "candidate_status": "screen_failed", "message": str(e)})
        finally:
            book.unpersist()
    return {"candidates": rows, "fields": sorted({f for c in good for f in fields_of(c.root)}), "batch_identity": hashlib.sha256("\n".join(sorted(expressions)).encode()).hexdigest(), "timings_seconds": clock.all()}
