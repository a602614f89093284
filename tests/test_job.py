"""The demo data set end to end: jobs, audits, measurement, evaluation, the command line, plugins, readiness."""

import io
import json
from contextlib import redirect_stdout

import numpy as np
import pandas as pd
import pytest
import yaml

from factorspark import cli, services
from factorspark.engine import SIDECARS, Engine, field_catalog
from factorspark.errors import DataError
from factorspark.job import Prepared, load_job
from factorspark.sources import bars, datasets, plugins

SYMBOLS = [f"00000{i}.SZ" for i in range(1, 5)] + [f"60000{i}.SH" for i in range(1, 5)]


# The events of the demo data set.
SUSPENDED, UP, DOWN, LATE, SPLIT = ("000002.SZ", "2021-02-15"), ("000003.SZ", "2021-04-01"), ("600002.SH", "2021-05-17"), ("600004.SH", "20210115"), ("600003.SH", "2021-04-15")


def walk(seed: int, dates: pd.DatetimeIndex) -> pd.DataFrame:
    """Prices of one security: a random walk with half a percent a day, opened a little off the close before."""
    rnd = np.random.default_rng([2718, seed])
    close = 20 * np.exp(np.cumsum(rnd.normal(0, 0.005, len(dates))))
    first = np.r_[20.0, close[:-1]] * np.exp(rnd.normal(0, 0.001, len(dates)))
    spread = np.exp(np.abs(rnd.normal(0, 0.002, len(dates))))
    traded = rnd.integers(50_000, 200_000, len(dates)).astype(float)
    return pd.DataFrame({"trade_date": dates, "open": first, "high": np.maximum(first, close) * spread, "low": np.minimum(first, close) / spread, "close": close, "vol": traded, "amount": traded * close, "adj_factor": 1.0})


@pytest.fixture(scope="module")
def demo(tmp_path_factory):
    """Eight securities over 390 business days with a suspension, limits, a late listing, special treatment and a split."""
    root = tmp_path_factory.mktemp("demo")
    dates = pd.bdate_range("2020-01-02", "2021-06-30")
    b = pd.concat([walk(k, dates).assign(ts_code=code) for k, code in enumerate(SYMBOLS)], ignore_index=True)
    on = lambda event: (b["ts_code"] == event[0]) & (b["trade_date"] == event[1])
    b.loc[(b["ts_code"] == SPLIT[0]) & (b["trade_date"] >= SPLIT[1]), "adj_factor"] = 2.0
    s = b[["ts_code", "trade_date", "open"]].copy()
    s["is_suspended"] = on(SUSPENDED)
    s["up_limit"] = np.where(on(UP), s["open"], s["open"] * 1.1)
    s["down_limit"] = np.where(on(DOWN), s["open"], s["open"] * 0.9)
    for name, df in (("bars", b), ("states", s)):
        for year, part in df.groupby(df["trade_date"].dt.year):
            (root / name / f"year={year}").mkdir(parents=True)
            part.to_parquet(root / name / f"year={year}" / "part.parquet", index=False, coerce_timestamps="us")
    pd.DataFrame({"ts_code": SYMBOLS, "exchange": ["SZSE"] * 4 + ["SSE"] * 4, "market": ["主板"] * 8, "list_date": ["20100101"] * 7 + [LATE[1]], "delist_date": pd.Series([None] * 8, dtype="string")}).to_parquet(root / "master.parquet")
    pd.DataFrame({"ts_code": ["600004.SH"], "start_date": ["20210301"], "end_date": ["20210310"]}).to_parquet(root / "st.parquet")
    pd.DataFrame([(e, d.strftime("%Y%m%d"), 1) for e in ("SSE", "SZSE") for d in dates], columns=["exchange", "cal_date", "is_open"]).to_csv(root / "calendar.csv", index=False)
    job = {
        "schema_version": "production-job.v1", "job_id": "demo", "dataset_version": "v1", "plugins": [], "universe": {"view": "signal_eligible"}, "evaluation": {"start": "2021-01-04", "end": "2021-06-30", "max_lookback": 20, "symbol_cap": 8},
        "data": {"bars_dir": "bars", "market_states_dir": "states", "stock_master": "master.parquet", "st_intervals": "st.parquet", "trade_calendar": "calendar.csv"},
        "research": {"screen": {"discovery": ["2021-01-04", "2021-03-31"], "validation": ["2021-04-01", "2021-06-30"], "horizons": [1, 5], "minimum_coverage": 0.7, "minimum_periods": 20, "top_fraction": 0.25},
                     "rolling": {"windows": [{"label": "early", "train": ["2021-01-04", "2021-02-26"], "test": ["2021-03-01", "2021-04-30"]}, {"label": "late", "train": ["2021-03-01", "2021-04-30"], "test": ["2021-05-03", "2021-06-30"]}],
                                 "gate": {"required_folds": 2, "minimum_positive_folds": 1, "minimum_direction_mode_count": 1, "minimum_horizon_mode_count": 1}}},
    }
    (root / "job.yaml").write_text(yaml.safe_dump(job))
    return root


def test_validity_audit(spark, demo, tmp_path):
    got = services.audit_factor(spark, demo / "job.yaml", "neg(ts_std(ts_pct_change(close,1),10))", tmp_path)
    assert got["status"] == "factor_validity_verified" and got["return_data_read"] is False
    assert got["coverage"]["universe_cells"] == 7 * 128 - 1  # all dates of all but the late listing, less the suspension
    assert got["coverage"]["factor_coverage"] == 1.0
    assert got["causality"]["mismatch_cells"] == 0


def test_panel_rules(spark, demo):
    p = Prepared(spark, load_job(demo / "job.yaml"))
    panel = p.panel().cache()
    cell = lambda code, day: panel.filter(f"code = '{code}' AND date = DATE '{day}'").first()
    stopped = cell("000002.SZ", "2021-02-15")
    assert not stopped["in_universe"] and not stopped["buyable"] and not stopped["sellable"]
    assert not cell("000003.SZ", "2021-04-01")["buyable"] and cell("000003.SZ", "2021-04-01")["sellable"]
    assert cell("600002.SH", "2021-05-17")["buyable"] and not cell("600002.SH", "2021-05-17")["sellable"]
    assert panel.filter("code = '600004.SH' AND in_universe").isEmpty()  # listed for under 120 days
    before, after = cell("600003.SH", "2021-04-14"), cell("600003.SH", "2021-04-15")
    assert abs(after["close"] / before["close"] - 2) < 0.05  # adjusted for the split
    with pytest.raises(DataError, match="looks back"):
        p.scored("ts_mean(close,252)")
    panel.unpersist()


def test_measurement_is_reused(spark, demo, tmp_path):
    args = (spark, demo / "job.yaml", "ts_pct_change(close,5)", "high", (1, 2, 5), (20,), tmp_path)
    first, again = services.measure_factor(*args), services.measure_factor(*args)
    assert not first["reused"] and again["reused"] and first["factor_return"] == again["factor_return"]
    assert first["coverage"]["calendar_days"] == 126 and [h["horizon"] for h in first["horizon_curve"]] == [1, 2, 5]
    assert first["rank_ic"]["observations"] > 100


def test_evaluation_single_and_batch(spark, demo, tmp_path):
    one = services.evaluate(spark, demo / "job.yaml", "ts_pct_change(close,5)", "rolling", tmp_path / "one")
    many = services.evaluate_batch(spark, demo / "job.yaml", ["ts_pct_change(close,5)", "neg(volume)", "nope(close)"], "rolling", tmp_path / "many")
    by = {c.get("canonical", c.get("expression")): c for c in many["candidates"]}
    assert by["nope(close)"]["code"] == "UNKNOWN_OPERATOR"
    strip = lambda d: json.loads(json.dumps({k: v for k, v in d.items() if k not in ("digest", "identity")}))
    assert strip(by["ts_pct_change(close,5)"]["screen"]) == strip(one["screen"])
    assert len(one["rolling"]["folds"]) == 2 and one["rolling"]["summary"]["status"] in ("rolling_survivor", "rejected_rolling")
    assert one["screen"]["validation"]["rank_ic"]["observation_count"] > 0
    heard = []
    again = services.evaluate(spark, demo / "job.yaml", "ts_pct_change(close,5)", "rolling", tmp_path / "one", observe=lambda stage, result: heard.append((stage, result["identity"])))
    assert again["reused"] == ["screen", "rolling"] and [s for s, _ in heard] == ["screen", "rolling"]
    recorded = {"expression": "ts_pct_change(close,5)", "canonical": one["canonical"], "factor_id": one["factor_id"]}
    assert services.evaluate_candidate(spark, demo / "job.yaml", recorded, "screen", tmp_path / "one")["screen"] == again["screen"]
    with pytest.raises(DataError, match="factor_id was f_0"):
        services.evaluate_candidate(spark, demo / "job.yaml", recorded | {"factor_id": "f_0"}, "screen", tmp_path / "one")


def test_one_read_of_the_bars(spark, demo, tmp_path, monkeypatch):
    """Screen, folds, gate and rank IC share one scan of the bars, and what it gave is kept while they run."""
    from factorspark import job as jobs

    scans, kept = [], []
    plain = jobs.source.bars
    monkeypatch.setattr(jobs.source, "bars", lambda *a, **k: scans.append(a[1]) or plain(*a, **k))
    heard = lambda stage, result: kept.append((stage, spark.sparkContext._jsc.getPersistentRDDs().size()))
    services.evaluate(spark, demo / "job.yaml", "neg(ts_pct_change(close,3))", "rolling", tmp_path, observe=heard)
    assert len(scans) == 1 and [s for s, _ in kept] == ["screen", "rolling"] and all(n >= 1 for _, n in kept)


def command(*argv):
    out = io.StringIO()
    with redirect_stdout(out):
        code = cli.main(list(argv))
    lines = out.getvalue().splitlines()
    assert len(lines) == 1
    return code, json.loads(lines[0])


def test_command_line(spark, demo, tmp_path):
    assert command("capabilities", "--json")[1]["data"]["commands"] == list(cli.COMMANDS)
    assert command("doctor")[0] == 0
    code, got = command("compile", "cs_rank(close)", "--run-id", "r1")
    assert code == 0 and got["run_id"] == "r1" and got["warnings"]
    code, got = command("compile", "close+open")
    assert code == 2 and got["data"]["error"]["code"] == "UNSAFE_SYNTAX"
    assert len(command("schema")[1]["data"]["operator_catalog"]["operators"]) == 45
    code, got = command("inspect-job", "--job", str(demo / "job.yaml"))
    assert code == 0 and got["data"]["trading_dates"] == 128
    code, got = command("audit-causality", "--job", str(demo / "job.yaml"), "ts_mean(close,5)", "--work-root", str(tmp_path))
    assert code == 0 and got["data"]["status"] == "prefix_invariance_verified"
    assert command("inspect-job", "--job", str(demo / "nope.yaml"))[0] == 2
    (tmp_path / "batch.json").write_text(json.dumps({"schema": cli.BATCH, "expressions": ["close", "close"]}))
    assert command("evaluate-batch", "--job", str(demo / "job.yaml"), "--expressions-file", str(tmp_path / "batch.json"), "--work-root", str(tmp_path))[0] == 2
    assert command("nope")[0] if False else cli.main(["nope"]) == 2


def test_identity_does_not_depend_on_the_place(spark, demo, tmp_path):
    import shutil

    shutil.copytree(demo, tmp_path / "copy")
    a, b = (Prepared(spark, load_job(r / "job.yaml")).identity() for r in (demo, tmp_path / "copy"))
    assert a["job_identity"] == b["job_identity"]


def test_jobs_are_checked(demo, tmp_path):
    raw = yaml.safe_load((demo / "job.yaml").read_text())
    for change in ({"schema_version": "x"}, {"universe": {"view": "x"}}, {"universe": {"view": "csi300"}}, {"operator_catalog": "astock_formula_ops_v3"}, {"evaluation": {"start": "2021-02-01", "end": "2021-01-01"}}):
        (tmp_path / "job.yaml").write_text(yaml.safe_dump(raw | change))
        with pytest.raises(DataError):
            load_job(tmp_path / "job.yaml")


def test_readiness_and_missing_years(spark, demo):
    assert bars.readiness(spark, str(demo / "bars"), "2020-01-02", "2021-06-30")["ready"]
    assert bars.readiness(spark, str(demo / "bars"), "2019-01-02", "2021-06-30")["blockers"] == ["year 2019 is missing"]
    with pytest.raises(DataError, match="2019"):
        bars.bars(spark, str(demo / "bars"), "2019-01-02", "2021-06-30")
    plan = bars.bars(spark, str(demo / "bars"), "2021-01-04", "2021-02-01").select("close")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan or "PartitionFilters: [year" in plan
    assert "GreaterThanOrEqual(trade_date" in plan and "adj_factor" not in plan.split("ReadSchema")[1]


def test_plugins(spark, tmp_path):
    rows = pd.DataFrame({"ts_code": ["a", "b"], "trade_date": pd.to_datetime(["2021-01-04", "2021-01-04"]), "x": [1.0, 2.0], "late": [1.0, 2.0]})
    rows.to_parquet(tmp_path / "x.parquet", coerce_timestamps="us")
    declared = [plugins.DeclaredField("x", "float64"), plugins.DeclaredField("late", "float64", day_offset=0, local_time="18:00:00")]
    m = plugins.Manifest("d", "1", ("ts_code", "trade_date"), (str(tmp_path / "x.parquet"),), tuple(declared), 2, "2021-01-04", "2021-01-04", plugins.fingerprint(spark, [str(tmp_path / "x.parquet")]))
    plugins.save_manifest(m, tmp_path / "m.yaml")
    again = plugins.load_manifest(tmp_path / "m.yaml")
    assert again == m and [s.name for s in m.specs()] == ["x"]
    assert plugins.validate(spark, m)["status"] == "PASS"
    assert plugins.scan(spark, m, ["x"], "2021-01-04", "2021-01-04", ["a"]).count() == 1
    first, again = (datasets.validate_once(spark, m, tmp_path / "receipts") for _ in range(2))
    assert not first["reused"] and again["reused"] and datasets.export(spark, m, tmp_path / "out.yaml")["status"] == "PASS" and plugins.load_manifest(tmp_path / "out.yaml").rows == 2
    d = datasets.DatasetManifest("d", "1", "s", "c", datasets.Status.QUARANTINE, 2, "2021-01-04T08:00:00+08:00", issues=("late",))
    datasets.write_manifest(tmp_path / "d.json", d)
    assert datasets.read_manifest(tmp_path / "d.json") == d and d.ingested_at == "2021-01-04T00:00:00+00:00"
    pd.concat([rows, rows]).to_parquet(tmp_path / "x.parquet", coerce_timestamps="us")
    assert not datasets.validate_once(spark, m, tmp_path / "receipts")["reused"]
    assert set(plugins.validate(spark, m)["reasons"]) == {"keys repeat", "4 rows, declared 2", "content differs from the declared hash"}
    with pytest.raises(DataError):
        plugins.merge_sources([plugins.scan(spark, m, ["x"]), plugins.scan(spark, m, ["x"])])


def test_stream_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from factorspark.prep.panel import panel
    from factorspark.streaming.append import evaluate_stream

    rows = [(c, pd.Timestamp("2021-01-01").date() + pd.Timedelta(days=i), float((i * 7 + k * 3) % 11)) for i in range(12) for k, c in enumerate("abc")]
    df = spark.createDataFrame(rows, "code string, date date, close double")
    old, new = df.filter("date < '2021-01-09'"), df.filter("date >= '2021-01-09'")
    new.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    e = Engine(fields=field_catalog())
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = evaluate_stream(stream, lambda: old, e, "cs_rank(ts_mean(close,3))", ["close"], lambda out, n: got.extend(map(tuple, out.collect())), str(tmp_path / "cp"))
    q.awaitTermination(60)
    c = e.compile("cs_rank(ts_mean(close,3))")
    want = e.plan(c).results(panel(df, ["close"])).filter(F.col("date") >= "2021-01-09").collect()
    assert sorted(got) == sorted(map(tuple, want))


def test_index_views_and_sidecars(spark, demo, tmp_path):
    import shutil

    shutil.copytree(demo, tmp_path / "d")
    root = tmp_path / "d"
    members = [("000300.SH", d, c) for d, codes in (("20200601", SYMBOLS[:3]), ("20210301", SYMBOLS[1:4])) for c in codes]
    pd.DataFrame(members, columns=["index_code", "effective_date", "con_code"]).to_parquet(root / "members.parquet")
    for name, fields in SIDECARS.items():
        for year in (2020, 2021):
            folder = root / "side" / name / f"year={year}"
            folder.mkdir(parents=True)
            pd.DataFrame({"ts_code": SYMBOLS, "trade_date": pd.Timestamp(f"{year}-03-01"), **{f: 0.5 for f in fields}}).to_parquet(folder / "part.parquet", coerce_timestamps="us")
    raw = yaml.safe_load((root / "job.yaml").read_text())
    raw["universe"] = {"view": "csi300", "index_code": "000300.SH"}
    raw["data"] |= {"index_membership": "members.parquet", "dense_sidecars_dir": "side"}
    raw["evaluation"].pop("symbol_cap")
    (root / "job.yaml").write_text(yaml.safe_dump(raw))
    p = Prepared(spark, load_job(root / "job.yaml"))
    panel = p.panel().cache()
    inside = {(str(r["date"]), r["code"]) for r in panel.filter("in_universe").select("date", "code").collect()}
    assert ("2021-02-26", SYMBOLS[0]) in inside and ("2021-03-01", SYMBOLS[0]) not in inside and ("2021-03-01", SYMBOLS[3]) in inside and ("2021-02-26", SYMBOLS[3]) not in inside
    assert panel.filter("pb IS NOT NULL").count() == len(SYMBOLS)
    assert p.engine.compile("cs_rank(pb)").fields == ("pb",)
    raw["evaluation"]["symbol_cap"] = 2
    (root / "job.yaml").write_text(yaml.safe_dump(raw))
    assert Prepared(spark, load_job(root / "job.yaml")).symbols() == SYMBOLS[1:3]
    panel.unpersist()
