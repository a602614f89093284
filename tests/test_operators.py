"""Every operator against pandas and NumPy on a small panel with holes; prefix invariance; staging."""

import datetime
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest

from factorspark.engine import Engine, category, field_catalog
from factorspark.evaluation.audits import prefix_invariance
from factorspark.operators.catalogs import catalog, everything
from factorspark.prep.panel import panel

DATES = [datetime.date(2020, 1, 1) + datetime.timedelta(days=i) for i in range(14)]
CODES = list("abcdef")


@pytest.fixture(scope="module")
def data():
    rnd = np.random.default_rng(8)
    wide = {}
    for name in ("close", "open", "volume"):
        x = rnd.integers(1, 9, (len(DATES), len(CODES))).astype(float) + (0.25 if name == "open" else 0)
        x[rnd.random(x.shape) < 0.08] = np.nan
        x[:, 0] = 5.0  # a flat series
        x[3:9, 1] = np.arange(6) + 2.0  # a run
        wide[name] = pd.DataFrame(x, DATES, CODES)
    wide["grp"] = pd.DataFrame([[1.0, 1, 1, 2, 2, np.nan]] * len(DATES), DATES, CODES)
    wide["u"] = pd.DataFrame(rnd.random((len(DATES), len(CODES))) < 0.85, DATES, CODES)
    return wide


@pytest.fixture(scope="module")
def frame(spark, data):
    rows = [(c, d, *[None if (v := data[n].loc[d, c]) != v else float(v) for n in ("close", "open", "volume", "grp")], bool(data["u"].loc[d, c])) for d in DATES for c in CODES]
    df = spark.createDataFrame(rows, "code string, date date, close double, open double, volume double, grp double, u boolean")
    from pyspark.sql import functions as F

    return panel(df, ["close", "open", "volume"], F.col("u"), keep=("grp", "u")).cache()


def masked(x, data):
    return x.where(data["u"])


def by_row(x, f):
    return pd.DataFrame([f(r) for r in x.to_numpy()], x.index, x.columns)


def ranks(r, key=lambda v: v):
    s = pd.Series(r)
    n = s.notna().sum()
    return (np.where(s.notna(), 0.5, np.nan) if n == 1 else ((pd.Series(key(s)).rank() - 1) / (n - 1)).to_numpy()) if n else r


def stable(floor):
    def f(r):
        top = np.nanmax(np.abs(r)) if np.isfinite(r).any() else 1.0
        top = max(top, 1.0) if floor else (top or 1.0)
        return ranks(r, lambda s: (s / top).round(12))

    return f


def grouped(x, g, f):
    out = np.full(x.shape, np.nan)
    for i in range(len(x)):
        for k in (1.0, 2.0):
            m = (g.to_numpy()[i] == k) & np.isfinite(x.to_numpy()[i])
            if m.any():
                out[i, m] = f(x.to_numpy()[i][m])
    return pd.DataFrame(out, x.index, x.columns)


def zscore(r):
    sd = np.nanstd(r) if np.isfinite(r).any() else np.nan
    flat = not sd > max(1.0, np.nanmax(np.abs(r)) if np.isfinite(r).any() else 0) * 1e-12
    return np.where(np.isnan(r), np.nan, 0.0 if flat else (r - np.nanmean(r)) / sd) if np.isfinite(r).any() else r


def winsor(r):
    ok = r[np.isfinite(r)]
    return np.clip(r, *np.quantile(ok, [0.05, 0.95])) if len(ok) else r


def residual(y, x):
    out = np.full(y.shape, np.nan)
    for i in range(len(y)):
        m = np.isfinite(y.to_numpy()[i]) & np.isfinite(x.to_numpy()[i])
        a, b = y.to_numpy()[i][m], x.to_numpy()[i][m]
        if m.sum() >= 3 and ((b - b.mean()) ** 2).sum() > 1e-18:
            beta = ((b - b.mean()) * (a - a.mean())).sum() / ((b - b.mean()) ** 2).sum()
            out[i, m] = a - a.mean() - beta * (b - b.mean())
    return pd.DataFrame(out, y.index, y.columns)


def rolling(x, k, f):
    def g(w):
        return np.nan if np.isnan(w).any() else f(w)

    return x.rolling(k, min_periods=1).apply(lambda w: np.nan if len(w) < k else g(w), raw=True)


def rank_in(w):
    k = len(w)
    return 0.0 if k == 1 else ((w < w[-1]).sum() + ((w == w[-1]).sum() - 1) / 2) / (k - 1)


def extreme(pick):
    def f(w):
        m = pick(w)
        return float(len(w) - 1 - np.flatnonzero(np.abs(w - m) <= 1e-12 + 1e-12 * abs(m))[-1])

    return f


def moves(w):
    t = max(1.0, np.abs(w).max()) * 1e-12
    return [0 if abs(d) <= t else int(math.copysign(1, d)) for d in np.diff(w)]


def turning(w):
    s = [m for m in moves(w) if m]
    return np.nan if len(s) < 2 else sum(a != b for a, b in zip(s, s[1:])) / (len(s) - 1)


def signed_run(w):
    s = moves(w)
    n = next((i for i, m in enumerate(reversed(s)) if m != s[-1]), len(s))
    return np.nan if not s[-1] else s[-1] * n / (len(w) - 1)


def pair_moves(w):
    return [0 if abs(b - a) <= max(abs(a), abs(b), 1) * 1e-8 else int(math.copysign(1, b - a)) for a, b in zip(w, w[1:])]


def longest(w):
    best, which, n, sign = 0, 0, 0, 0
    for m in pair_moves(w):
        n, sign = (0, 0) if m == 0 else (n + 1, m) if m == sign else (1, m)
        if n >= best:
            best, which = n, sign
    return np.nan if not best else which * best / (len(w) - 1)


def levels(x, k, f):
    out = np.full(x.shape, np.nan)
    for j in range(x.shape[1]):
        level = prior = end = None
        for i, v in enumerate(x.to_numpy()[:, j]):
            if np.isnan(v):
                continue
            if level is None:
                level = v
            elif abs(v - level) > max(abs(v), abs(level), 1) * 1e-8:
                prior, end, level = level, i - 1, v
            if end is not None and i >= k - 1 and end >= i - k + 1:
                out[i, j] = f(v, prior, i - end - 1)
    return pd.DataFrame(out, x.index, x.columns)


def pairs(x, y, k, f):
    out = np.full(x.shape, np.nan)
    for i in range(k - 1, len(x)):
        for j in range(x.shape[1]):
            a, b = x.to_numpy()[i - k + 1 : i + 1, j], y.to_numpy()[i - k + 1 : i + 1, j]
            if not (np.isnan(a).any() or np.isnan(b).any()):
                out[i, j] = f(a, b)
    return pd.DataFrame(out, x.index, x.columns)


def corr(a, b):
    s, t = a.std(ddof=1), b.std(ddof=1)
    return np.clip(np.cov(a, b)[0, 1] / (s * t), -1, 1) if s > 1e-12 and t > 1e-12 else np.nan


def last_residual(y, x):
    s = ((x - x.mean()) ** 2).sum()
    return np.nan if s <= max(1, np.abs(x).max()) ** 2 * 1e-24 else y[-1] - y.mean() - ((x - x.mean()) * (y - y.mean())).sum() / s * (x[-1] - x.mean())


def state(entry, alpha, leave):
    out = np.full(alpha.shape, np.nan)
    for j in range(alpha.shape[1]):
        v = np.nan
        for i in range(len(alpha)):
            v = alpha.iat[i, j] if entry.iat[i, j] else np.nan if leave.iat[i, j] else v
            out[i, j] = v
    return pd.DataFrame(out, alpha.index, alpha.columns)


def r2(w):
    return np.nan if w.var() == 0 else np.clip(np.corrcoef(np.arange(len(w)), w)[0, 1] ** 2, 0, 1)


def moment(name):
    return lambda w: np.nan if w.std(ddof=1) <= max(1, np.abs(w).max()) * 1e-12 else getattr(pd.Series(w), name)()


def where_bool(c, a, b, known):
    return a.where(c, b).where(known)


CASES = {
    "add(close,open)": lambda c, o, v, d: c + o, "sub(close,2)": lambda c, o, v, d: c - 2, "mul(close,volume)": lambda c, o, v, d: c * v, "div(close,sub(close,5))": lambda c, o, v, d: c / (c - 5).where((c - 5).abs() > 1e-12),
    "neg(close)": lambda c, o, v, d: -c, "abs(sub(close,open))": lambda c, o, v, d: (c - o).abs(), "signed_log(sub(close,open))": lambda c, o, v, d: np.sign(c - o) * np.log1p((c - o).abs()),
    "signed_sqrt(sub(close,open))": lambda c, o, v, d: np.sign(c - o) * np.sqrt((c - o).abs()), "sign(sub(close,open))": lambda c, o, v, d: np.sign(c - o), "signed_power(sub(close,open),3)": lambda c, o, v, d: np.sign(c - o) * (c - o).abs() ** 3,
    "panel_min(close,open)": lambda c, o, v, d: np.minimum(c, o), "panel_max(close,4)": lambda c, o, v, d: np.maximum(c, 4),
    "where(gt(close,open),close,-1)": lambda c, o, v, d: where_bool(c > o, c, c * 0 - 1, c.notna() & o.notna()), "where(le(close,4),1,volume)": lambda c, o, v, d: where_bool(c <= 4, c * 0 + 1, v, c.notna()),
    "where(ge(close,5),close,open)": lambda c, o, v, d: where_bool(c >= 5, c, o, c.notna()), "where(lt(close,5),close,open)": lambda c, o, v, d: c.where(c < 5, o).where(c.notna()),
    "trade_when(gt(close,6),open,lt(close,3))": lambda c, o, v, d: state(c > 6, o, c < 3),
    "cs_rank(close)": lambda c, o, v, d: by_row(masked(c, d), stable(False)), "cs_zscore(close)": lambda c, o, v, d: by_row(masked(c, d), zscore), "cs_demean(close)": lambda c, o, v, d: masked(c, d).sub(masked(c, d).mean(axis=1), axis=0),
    "cs_winsorize(close,0.05)": lambda c, o, v, d: by_row(masked(c, d), winsor), "cs_residual(close,volume)": lambda c, o, v, d: residual(masked(c, d), masked(v, d)),
    "group_demean(close,grp)": lambda c, o, v, d: grouped(masked(c, d), d["grp"], lambda x: x - x.mean()), "group_rank(close,grp)": lambda c, o, v, d: grouped(masked(c, d), d["grp"], stable(True)), "group_zscore(close,grp)": lambda c, o, v, d: grouped(masked(c, d), d["grp"], zscore),
    "ts_delay(close,2)": lambda c, o, v, d: c.shift(2), "ts_delta(close,2)": lambda c, o, v, d: c - c.shift(2), "ts_pct_change(close,3)": lambda c, o, v, d: c / c.shift(3) - 1,
    "ts_sum(close,3)": lambda c, o, v, d: rolling(c, 3, np.sum), "ts_mean(close,3)": lambda c, o, v, d: rolling(c, 3, np.mean), "ts_std(close,3)": lambda c, o, v, d: rolling(c, 3, lambda w: w.std(ddof=1)), "ts_std(close,1)": lambda c, o, v, d: c * np.nan,
    "ts_min(close,3)": lambda c, o, v, d: rolling(c, 3, np.min), "ts_max(close,3)": lambda c, o, v, d: rolling(c, 3, np.max), "ts_rank(close,5)": lambda c, o, v, d: rolling(c, 5, rank_in), "ts_rank(close,1)": lambda c, o, v, d: c * 0,
    "ts_argmin(close,5)": lambda c, o, v, d: rolling(c, 5, extreme(np.min)), "ts_argmax(close,5)": lambda c, o, v, d: rolling(c, 5, extreme(np.max)),
    "ts_zscore(close,5)": lambda c, o, v, d: rolling(c, 5, lambda w: 0.0 if w.std() == 0 else (w[-1] - w.mean()) / w.std(ddof=1)), "ts_ema(close,5)": lambda c, o, v, d: c.ewm(span=5, adjust=False, min_periods=5).mean(),
    "ts_decay_linear(close,5)": lambda c, o, v, d: rolling(c, 5, lambda w: (w * np.arange(1, 6)).sum() / 15), "ts_scale(close,5)": lambda c, o, v, d: rolling(c, 5, lambda w: np.nan if np.ptp(w) <= 1e-12 else (w[-1] - w.min()) / np.ptp(w)),
    "ts_skew(close,5)": lambda c, o, v, d: rolling(c, 5, moment("skew")), "ts_kurt(close,5)": lambda c, o, v, d: rolling(c, 5, moment("kurt")), "ts_slope(close,5)": lambda c, o, v, d: rolling(c, 5, lambda w: np.polyfit(np.arange(5), w, 1)[0]),
    "ts_r2(close,5)": lambda c, o, v, d: rolling(c, 5, r2), "ts_product(close,3)": lambda c, o, v, d: rolling(c, 3, np.prod),
    "ts_corr(close,volume,5)": lambda c, o, v, d: pairs(c, v, 5, corr), "ts_cov(close,volume,5)": lambda c, o, v, d: pairs(c, v, 5, lambda a, b: np.cov(a, b)[0, 1]), "ts_beta(close,volume,5)": lambda c, o, v, d: pairs(c, v, 5, lambda a, b: np.cov(a, b)[0, 1] / b.var(ddof=1) if b.var() > 1e-12 else np.nan),
    "ts_regression_residual(close,volume,5)": lambda c, o, v, d: pairs(c, v, 5, last_residual),
    "ts_last_change(close,5)": lambda c, o, v, d: levels(c, 5, lambda x, p, n: x - p), "ts_last_pct_change(close,5)": lambda c, o, v, d: levels(c, 5, lambda x, p, n: x / p - 1), "ts_days_since_change(close,5)": lambda c, o, v, d: levels(c, 5, lambda x, p, n: n),
    "ts_path_efficiency(close,5)": lambda c, o, v, d: rolling(c, 5, lambda w: np.nan if np.abs(np.diff(w)).sum() <= 1e-11 else abs(w[-1] - w[0]) / np.abs(np.diff(w)).sum()), "ts_turning_rate(close,5)": lambda c, o, v, d: rolling(c, 5, turning),
    "ts_signed_run_length(close,5)": lambda c, o, v, d: rolling(c, 5, signed_run), "ts_median(close,5)": lambda c, o, v, d: rolling(c, 5, np.median), "ts_mean_abs_dev(close,5)": lambda c, o, v, d: rolling(c, 5, lambda w: np.abs(w - w.mean()).mean()),
    "ts_gaussianize(close,5)": lambda c, o, v, d: rolling(c, 5, lambda w: NormalDist().inv_cdf(min(max(rank_in(w), 0.1), 0.9))), "ts_longest_signed_run(close,5)": lambda c, o, v, d: rolling(c, 5, longest), "ts_change_rate(close,5)": lambda c, o, v, d: rolling(c, 5, lambda w: sum(map(abs, pair_moves(w))) / 4),
    "ts_mean(cs_rank(ts_delta(close,1)),3)": lambda c, o, v, d: rolling(by_row(masked(c - c.shift(1), d), stable(False)), 3, np.mean),
}
ENGINE = Engine(everything(), field_catalog(extra=(category("grp"),)))


@pytest.fixture(scope="module")
def results(frame):
    """All cases in one plan: the stages of one expression must not disturb another's."""
    compiled = {t: ENGINE.compile(t) for t in CASES}
    return compiled, ENGINE.plan(*compiled.values()).results(frame).toPandas()


@pytest.mark.parametrize("text", list(CASES))
def test_operator(text, data, results):
    compiled, got = results
    want = masked(CASES[text](data["close"], data["open"], data["volume"], data), data)
    mine = got.pivot(index="date", columns="code", values=compiled[text].factor_id).reindex(index=DATES, columns=CODES)
    np.testing.assert_allclose(mine.to_numpy(float), want.to_numpy(float), rtol=1e-9, atol=1e-9)


def test_every_operator_has_a_case():
    assert {t.split("(")[0] for t in CASES} | {"gt", "ge", "lt", "le"} == set(everything().specs)


def test_plain_rank(frame, data):
    e = Engine(catalog("astock_formula_ops_v3"), field_catalog())
    c = e.compile("cs_rank(close)")
    got = e.plan(c).results(frame).toPandas().pivot(index="date", columns="code", values=c.factor_id).reindex(index=DATES, columns=CODES)
    np.testing.assert_allclose(got.to_numpy(float), masked(by_row(masked(data["close"], data), ranks), data).to_numpy(float), atol=1e-12)


def test_one_shuffle_a_phase(spark):
    from pyspark.sql import functions as F

    source = spark.range(1000).select((F.col("id") % 10).alias("code"), F.expr("date'2020-01-01' + cast(id / 10 as int)").alias("date"), (F.col("id") / 10).cast("int").alias("pos"), F.rand(1).alias("close"), F.rand(2).alias("volume"), F.lit(True).alias("in_universe"))

    def shuffles(*texts):
        plan = ENGINE.plan(*map(ENGINE.compile, texts)).apply(source)._jdf.queryExecution().executedPlan().toString()
        return plan.count("Exchange hashpartitioning")

    assert shuffles("ts_mean(close,5)", "ts_corr(close,volume,10)", "ts_zscore(ts_delta(close,1),5)", "ts_argmax(close,20)") == 1
    assert shuffles("cs_rank(close)", "cs_zscore(volume)", "cs_residual(close,cs_demean(close))") == 1
    assert shuffles("ts_mean(cs_rank(ts_delta(close,1)),3)") == 3  # by security, by date, by security


@pytest.mark.parametrize("text", ["cs_rank(ts_corr(close,volume,3))", "ts_ema(close,3)", "ts_last_change(close,5)", "trade_when(gt(close,6),open,lt(close,3))"])
def test_values_do_not_depend_on_the_future(frame, text):
    got = prefix_invariance(ENGINE, frame, text, "2020-01-08").first()
    assert got["mismatches"] == 0 and got["compared"] == 8 * len(CODES)


def test_a_lead_is_detected(frame):
    from pyspark.sql import functions as F

    from factorspark.operators.windows import path
    from factorspark.plans.model import PANEL, Catalog, OperatorSpec, Phase

    peek = OperatorSpec("peek", "time_series", (PANEL,), Phase.CODE, lambda ctx, x: F.lead(x, 1).over(path()))
    e = Engine(Catalog("test", (peek,)), field_catalog())
    got = prefix_invariance(e, frame, "peek(close)", "2020-01-08").first()
    assert got["mismatches"] > 0 and str(got["first_mismatch"]) == "2020-01-08"


def test_infinity_is_an_error(spark):
    df = spark.createDataFrame([("a", DATES[0], 1e308), ("a", DATES[1], 1e308)], "code string, date date, close double")
    with pytest.raises(Exception, match="NONFINITE_OUTPUT"):
        Engine().evaluate(panel(df, ["close"]), "signed_power(close,3)").collect()


def test_not_a_number_is_missing(spark):
    df = spark.createDataFrame([("a", DATES[0], float("nan")), ("b", DATES[0], float("inf")), ("c", DATES[0], 1.0)], "code string, date date, close double")
    assert {r["code"]: r["close"] for r in panel(df, ["close"]).collect()} == {"a": None, "b": None, "c": 1.0}
