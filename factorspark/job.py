"""Jobs: a YAML file that names the data, the universe, the evaluation window and the research design."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .artifacts import identity
from .engine import CORE_FIELDS, SIDECARS, Engine, sidecar_fields
from .errors import DataError
from .evaluation.screen import Fold, Gate, Policy
from .operators.catalogs import FOR_JOBS, PRODUCTION, catalog
from .plans.model import Catalog
from .prep.intervals import members_at
from .prep.panel import clean, densify
from .prep.suspension import carry, forward_fill
from .prep.views import research_frame, tradable
from .sources import bars as source
from .sources.plugins import Manifest, fingerprint, load_manifest, merge_sources, scan, validate

#: Views of the universe, and the index behind each membership view.
INDEXES = {"sse50": "000016.SH", "csi300": "000300.SH", "csi500": "000905.SH", "csi1000": "000852.SH"}
VIEWS = ("signal_eligible", "mainboard", "liquid_20m", *INDEXES)
SCHEMA = "production-job.v1"


def _window(raw: object, what: str) -> tuple[str, str]:
    start, end = (str(x) for x in raw)
    if start > end:
        raise DataError(f"{what} ends before it starts")
    return start, end


@dataclass(frozen=True)
class Job:
    path: Path
    job_id: str
    dataset_version: str
    data: dict
    plugins: tuple[tuple[Manifest, tuple[str, ...]], ...]
    view: str
    start: str
    end: str
    max_lookback: int
    symbol_cap: int | None
    policy: Policy
    folds: tuple[Fold, ...]
    gate: Gate
    operators: str

    def file(self, key: str) -> str:
        return self.data[key]


def load_job(path: str | Path) -> Job:
    import yaml

    path = Path(path)
    raw = yaml.safe_load(path.read_text(encoding="utf-8"))
    if not isinstance(raw, dict) or raw.get("schema_version") != SCHEMA:
        raise DataError(f"{path} is no {SCHEMA} job")
    for key in ("job_id", "dataset_version", "data", "universe", "evaluation", "research"):
        if key not in raw:
            raise DataError(f"the job lacks {key}")
    root = path.parent
    at = lambda p: p if "://" in p or Path(p).is_absolute() else str(root / p)
    data = {k: at(str(v)) for k, v in raw["data"].items() if v is not None}
    for key in ("bars_dir", "market_states_dir", "stock_master", "st_intervals", "trade_calendar"):
        if key not in data:
            raise DataError(f"data lacks {key}")
    view = raw["universe"]["view"]
    if view not in VIEWS:
        raise DataError(f"unknown universe view {view}")
    if view in INDEXES and "index_membership" not in data:
        raise DataError(f"the view {view} needs data.index_membership")
    code = raw["universe"].get("index_code")
    if code is not None and code != INDEXES.get(view):
        raise DataError(f"the view {view} is not of the index {code}")
    ev, research = raw["evaluation"], raw["research"]
    start, end = _window((ev["start"], ev["end"]), "the evaluation")
    s = research["screen"]
    policy = Policy(
        _window(s["discovery"], "discovery"), _window(s["validation"], "validation"), tuple(s.get("horizons", (5, 20, 60))), float(s.get("minimum_coverage", 0.7)), int(s.get("minimum_periods", 504)), float(s.get("top_fraction", 0.2)),
        (float(s.get("real_buy_cost", 0.0003)), float(s.get("real_sell_cost", 0.0012))), (float(s.get("stress_buy_cost", 0.0005)), float(s.get("stress_sell_cost", 0.002))), s.get("mode", "staggered_horizon"), s.get("fixed_direction"),
        tuple(s.get("decay_horizons", (1, 5, 20, 60))),
    )
    for lo, hi in (policy.discovery, policy.validation):
        if not start <= lo <= hi <= end:
            raise DataError("screen windows must lie in the evaluation window")
    r = research.get("rolling", {})
    folds = tuple(Fold(w["label"], _window(w["train"], w["label"]), _window(w["test"], w["label"])) for w in r.get("windows", ()))
    if len({f.label for f in folds}) < len(folds):
        raise DataError("fold labels repeat")
    g = r.get("gate", {})
    gate = Gate(int(g.get("required_folds", 5)), int(g.get("minimum_positive_folds", 3)), float(g.get("minimum_median_test_excess_sharpe", 0.0)), int(g.get("minimum_direction_mode_count", 3)), int(g.get("minimum_horizon_mode_count", 3)))
    operators = raw.get("operator_catalog", PRODUCTION)
    if operators not in FOR_JOBS:
        raise DataError(f"{operators} is no production catalog")
    plugins = tuple((load_manifest(at(p["manifest"])), tuple(p["fields"])) for p in raw.get("plugins") or ())
    for m, fields in plugins:
        usable = {f.name for f in m.fields if f.usable()}
        if set(fields) - usable:
            raise DataError(f"{m.dataset}: {sorted(set(fields) - usable)} cannot be read at the signal clock")
    cap = ev.get("symbol_cap")
    return Job(path, raw["job_id"], raw["dataset_version"], data, plugins, view, start, end, int(ev.get("max_lookback", 252)), int(cap) if cap else None, policy, folds, gate, operators)


class Prepared:
    """A job bound to a session: its catalogs, its calendar and its panel."""

    def __init__(self, spark: SparkSession, job: Job):
        self.spark, self.job = spark, job
        days = source.calendar(spark, job.file("trade_calendar")).filter("is_open = 1").select(F.col("cal_date").cast("string").alias("d")).distinct().orderBy("d")
        self.days = [r["d"] for r in days.collect()]  # a calendar
        inside = [d for d in self.days if job.start <= d <= job.end]
        if len(inside) < 2:
            raise DataError("the evaluation window has fewer than two trading days")
        self.dates = inside
        at = self.days.index(inside[0])
        self.load_start = self.days[max(0, at - job.max_lookback)]
        extra = tuple(s for m, fields in job.plugins for s in m.specs() if s.name in fields)
        self.sidecars = "dense_sidecars_dir" in job.data
        extra = (*extra, *(sidecar_fields() if self.sidecars else ()))
        version = f"production_daily_fields_{job.dataset_version}_{job.view}"
        suffix = f"_plugins_{identity([(s.name, s.unit, s.available_at) for s in extra])[:16]}" if extra else ""
        self.fields = Catalog(version + suffix, (*CORE_FIELDS, *extra))
        self.engine = Engine(catalog(job.operators), self.fields)

    def identity(self) -> dict:
        """Hashes of the data and of the job, independent of where the files lie."""
        assets = {k: fingerprint(self.spark, [v]) for k, v in sorted(self.job.data.items())}
        plugins = [{"dataset": m.dataset, "version": m.version, "fields": list(f), "content": fingerprint(self.spark, list(m.paths)), "report": validate(self.spark, m)} for m, f in self.job.plugins]
        design = {"job_id": self.job.job_id, "dataset_version": self.job.dataset_version, "view": self.job.view, "start": self.job.start, "end": self.job.end, "policy": vars(self.job.policy), "folds": [vars(f) for f in self.job.folds], "gate": vars(self.job.gate), "operators": self.job.operators}
        return {"job_id": self.job.job_id, "asset_identities": assets, "plugins": plugins, "job_identity": identity([design, assets, plugins])}

    def symbols(self) -> list[str] | None:
        """The job's codes where it has a cap (the cap is part of the job): of the index's latest snapshot, or of the master."""
        if self.job.symbol_cap is None:
            return None
        codes = source.master(self.spark, self.job.file("stock_master")).select("code")
        if self.job.view in INDEXES:
            members = self._members().filter(F.col("effective_date") <= F.lit(self.job.end).cast("date"))
            latest = members.agg(F.max("effective_date")).first()[0]
            if latest is None:
                raise DataError("the index has no snapshot in force")
            codes = codes.join(members.filter(F.col("effective_date") == F.lit(latest)).select(F.col("con_code").alias("code")).distinct(), "code", "left_semi")
        return [r["code"] for r in codes.orderBy("code").limit(self.job.symbol_cap).collect()]

    def _members(self) -> DataFrame:
        return source.index_membership(self.spark, self.job.file("index_membership"), [INDEXES[self.job.view]])

    def panel(self, end: str | None = None) -> DataFrame:
        """Dense panel from the lookback before the window on: factor inputs with suspensions carried, universe, execution."""
        job, spark, end = self.job, self.spark, end or self.job.end
        codes = self.symbols()
        frame = research_frame(
            source.bars(spark, job.file("bars_dir"), self.load_start, end, codes), source.states(spark, job.file("market_states_dir"), self.load_start, end, codes), source.master(spark, job.file("stock_master")),
            source.special_treatment(spark, job.file("st_intervals")), source.calendar(spark, job.file("trade_calendar")),
        )
        if job.view in INDEXES:
            frame = members_at(frame, self._members(), "_member").withColumn(job.view, F.col("_member") & F.col("signal_eligible"))
        extra = []
        if job.plugins:
            merged = merge_sources([scan(spark, m, list(f), self.load_start, end) for m, f in job.plugins])
            frame = frame.join(merged, ["code", "date"], "left")
            extra = [f for _, fields in job.plugins for f in fields]
        if self.sidecars:
            for name, fields in SIDECARS.items():
                frame = frame.join(source.sidecar(spark, job.file("dense_sidecars_dir"), name, list(fields), self.load_start, end), ["code", "date"], "left")
                extra += list(fields)
        core = {"open": "hfq_open", "high": "hfq_high", "low": "hfq_low", "close": "hfq_close", "volume": "volume_shares", "amount": "amount_cny"}
        cells = frame.select(
            "code", "date", *[clean(F.col(c)).alias(n) for n, c in core.items()], *[clean(F.col(c)).alias(c) for c in extra], F.col("is_suspended").alias("suspended"), F.col(job.view).alias("_view"), "signal_eligible",
            clean(F.col("raw_open")).alias("raw_open"), "up_limit", "down_limit",
        )
        dense = densify(cells).withColumn("in_universe", F.coalesce("_view", F.lit(False)))
        buy, sell = tradable(F.col("raw_open"), F.col("suspended"), F.col("up_limit"), F.col("down_limit"))
        dense = dense.withColumns({"buyable": buy, "sellable": sell, "value_open": F.col("open"), "value_close": F.col("close")})
        filled = carry(dense, ["open", "high", "low", "close"], ["volume", "amount"])
        return forward_fill(filled, ["value_open", "value_close"])

    def scored(self, *expressions: str) -> tuple[DataFrame, list]:
        """The panel of the window with a column a factor (by factor id), for measurement and portfolios."""
        compiled = [self.engine.compile(e) for e in expressions]
        for c in compiled:
            if c.lookback > self.job.max_lookback:
                raise DataError(f"{c.canonical} looks back {c.lookback} days, the job allows {self.job.max_lookback}")
        out = self.engine.plan(*compiled).results(self.panel(), "pos", F.col("in_universe").alias("eligible"), F.col("value_open").alias("open"), F.col("value_close").alias("close"), "buyable", "sellable")
        return out.filter(F.col("date").between(F.lit(self.job.start).cast("date"), F.lit(self.job.end).cast("date"))), compiled
