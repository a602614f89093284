"""Registered queries of factor evaluation, with SQL twins where a query is no sequential simulation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tables as t
from .engine import Engine
from .evaluation import audits, cheap, measure, screen, targets
from .evaluation.portfolio import Scenario, excess, returns, run
from .functions import series
from .queries import D, L, PANEL_SQL, register
from .queries_portfolio import walk_sql

BOOK = f"""b0 AS (SELECT *, lag(close, 3) OVER {L} AS d FROM p),
b AS (SELECT code, date, pos, open, close, u AS eligible, CASE WHEN u THEN -(close / CASE WHEN abs(d) > 1e-12 THEN d END - 1) END AS score,
  coalesce(open > 0 AND code % 11 <> pos % 11, false) AS buyable, coalesce(open > 0 AND code % 13 <> pos % 13, false) AS sellable FROM b0)"""
HEAD = f"WITH {PANEL_SQL}, {BOOK}"


def rank_sql(x: str, part: str = "date") -> str:
    """Average one-based rank among the rows that have a value."""
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {part} ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0::DOUBLE END"


def ret_sql(a: str, b: str) -> str:
    return f"CASE WHEN {a} > 0 AND {b} > 0 THEN {b} / {a} - 1 END"


def _rounded(df: DataFrame, digits: int = 8, *exact: str) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if kinds[c] == "double" and c not in exact else F.col(c) for c in df.columns])


def _ieee_ratio(a: Column, b: Column) -> Column:
    """a / b for b of zero or more, as floating point has it where Spark has an error: by zero, NaN or an infinity of the sign of a."""
    return F.when(b > 0, a / F.when(b > 0, b)).when(a == 0, F.lit(float("nan"))).otherwise(F.signum(a) * F.lit(float("inf")))


def centred_sql(x: str, part: str = "date") -> str:
    """Twice the average rank less twice its mean, among the rows that have a value: a whole number."""
    return f"CASE WHEN {x} IS NOT NULL THEN 2 * rank() OVER (PARTITION BY {part} ORDER BY {x} NULLS LAST) + count(*) OVER (PARTITION BY {part}, {x}) - count({x}) OVER (PARTITION BY {part}) - 2 END"


def corr_sql(a: str, b: str) -> str:
    return f"CASE WHEN sum({a} * {a}) > 0 AND sum({b} * {b}) > 0 THEN sum({a} * {b})::DOUBLE / (sqrt(sum({a} * {a})::DOUBLE) * sqrt(sum({b} * {b})::DOUBLE)) END"


IC = f"""x AS (SELECT *, lead(open, 1) OVER {L} AS o1, lead(open, 6) OVER {L} AS o2, lead(date, 6) OVER {L} AS ex FROM b),
y AS (SELECT date, score, o2 / o1 - 1 AS r FROM x WHERE eligible AND score IS NOT NULL AND o1 > 0 AND o2 > 0),
z AS (SELECT date, {centred_sql('score')} AS a, {centred_sql('r')} AS c FROM y),
ic AS (SELECT * FROM (SELECT date, {corr_sql('a', 'c')} AS rank_ic, count(*) AS n FROM z GROUP BY date) WHERE rank_ic IS NOT NULL)"""


@register("eval_rank_ic", f"{HEAD}, {IC} SELECT date, round(rank_ic, 8) + 0.0 AS rank_ic, n FROM ic")
def rank_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(measure.rank_ic_by_date(t.book(spark, sf_dir), 5))


@register("eval_rank_ic_summary", f"{HEAD}, {IC} SELECT count(*) AS observation_count, round(avg(rank_ic), 8) AS rank_ic_mean, round(stddev_samp(rank_ic), 8) AS rank_ic_std, round(avg(rank_ic) / stddev_samp(rank_ic), 8) AS rank_ic_ir, round(avg(CASE WHEN rank_ic > 0 THEN 1.0::DOUBLE ELSE 0 END), 8) AS positive_rate, round(avg(n), 8) AS average_cross_section_count FROM ic")
def rank_ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(measure.rank_ic_summary(measure.rank_ic_by_date(t.book(spark, sf_dir), 5)))


SCORED = "s AS (SELECT * FROM b WHERE eligible AND score IS NOT NULL)"


@register("eval_topk_targets", f'{HEAD}, {SCORED}, r AS (SELECT date, code, row_number() OVER (PARTITION BY date ORDER BY score DESC, code) AS rank, count(*) OVER {D} AS n FROM s) SELECT date, code, rank FROM r WHERE rank <= greatest(1, ceil(n * 0.2::DOUBLE))')
def topk_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.top(t.book(spark, sf_dir), "high", 0.2).withColumn("rank", F.col("rank").cast("bigint"))


@register("eval_quantile_band", f"{HEAD}, {SCORED}, r AS (SELECT date, code, count(*) OVER {D} AS n, {rank_sql('score')} AS k FROM s) SELECT date, code FROM r WHERE CASE WHEN n = 1 THEN 2 ELSE least(floor((k - 1) / (n - 1) * 5), 4) END = 1")
def quantile_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.quantile_band(t.book(spark, sf_dir), 1, 5)


WEIGHTS = f"""wr AS (SELECT *, CASE WHEN eligible THEN score END AS s FROM b), wk AS (SELECT *, {rank_sql('s')} AS k FROM wr), wc AS (SELECT *, k - avg(k) OVER {D} AS c FROM wk),
wt AS (SELECT *, coalesce(c / CASE WHEN sum(abs(c)) OVER {D} > 1e-12 THEN sum(abs(c)) OVER {D} END, 0) AS w FROM wc)"""


@register("eval_rank_weights", f"{HEAD}, {WEIGHTS} SELECT code, date, round(w, 8) + 0.0 AS weight FROM wt")
def rank_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(measure.with_weights(t.book(spark, sf_dir), "high").select("code", "date", "weight"))


TRACE = f"""{WEIGHTS},
ta AS (SELECT *, lead(open, 1) OVER {L} AS o1, lead(open, 2) OVER {L} AS o2, lead(close, 1) OVER {L} AS c1, lead(date, 1) OVER {L} AS d1, lead(date, 2) OVER {L} AS d2, lag(w) OVER {L} AS w0, count(s) OVER {D} AS ns FROM wt),
tb AS (SELECT *, {ret_sql('o1', 'o2')} AS r, {ret_sql('o1', 'c1')} AS ri, {ret_sql('c1', 'o2')} AS ro, CASE WHEN s IS NOT NULL AND ns >= 5 THEN ntile(5) OVER (PARTITION BY date, s IS NOT NULL ORDER BY s, code) END AS q FROM ta),
tc AS (SELECT *, coalesce(q = 5, false) AS top FROM tb), td AS (SELECT *, coalesce(lag(top) OVER {L}, false) AS top0 FROM tc),
te AS (SELECT *, CASE WHEN s IS NOT NULL AND r IS NOT NULL THEN s END AS sx, CASE WHEN s IS NOT NULL AND r IS NOT NULL THEN r END AS rx FROM td WHERE d2 IS NOT NULL),
tf AS (SELECT *, {centred_sql('sx')} AS ra, {centred_sql('rx')} AS rb FROM te)"""


def held_sql(r: str) -> str:
    return f"CASE WHEN count(*) FILTER (abs(w) > 0) = 0 THEN 0 WHEN count(*) FILTER (abs(w) > 0 AND {r} IS NULL) > 0 THEN NULL ELSE sum(CASE WHEN abs(w) > 0 THEN w * {r} END) END"


_Q = ", ".join(f"round(avg(r) FILTER (q = {i}), 8) + 0.0 AS q{i}_return" for i in range(1, 6))
TRACE_SELECT = f"""SELECT date AS signal_date, min(d1) AS entry_date, min(d2) AS exit_date, count(*) FILTER (eligible) AS eligible_count, count(s) AS scored_count,
 round(count(s) / CASE WHEN count(*) FILTER (eligible) > 0 THEN count(*) FILTER (eligible)::DOUBLE END, 8) AS coverage, round(sum(abs(w)), 8) AS gross_exposure,
 round({corr_sql('ra', 'rb')}, 8) + 0.0 AS rank_ic, count(sx) AS rank_ic_count,
 round({held_sql('r')}, 8) + 0.0 AS factor_return, round({held_sql('ri')}, 8) + 0.0 AS intraday_return, round({held_sql('ro')}, 8) + 0.0 AS overnight_return,
 round(sum(abs(w - w0)) * 0.5, 8) AS target_weight_turnover,
 round(CASE WHEN min(pos) > 0 THEN CASE WHEN count(*) FILTER (top OR top0) > 0 THEN 1 - count(*) FILTER (top AND top0) / (count(*) FILTER (top OR top0))::DOUBLE ELSE 0 END END, 8) AS top20_membership_turnover,
 round(avg(r) FILTER (q = 5), 8) + 0.0 AS top20_return, round(avg(r) FILTER (q = 1), 8) + 0.0 AS bottom20_return, round(avg(r) FILTER (q = 5) - avg(r) FILTER (q = 1), 8) + 0.0 AS top_bottom_return, {_Q} FROM tf GROUP BY date"""


@register("eval_measurement_trace", f"{HEAD}, {TRACE} {TRACE_SELECT}")
def measurement_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank IC, factor, intraday and overnight returns, turnovers and quintiles of every signal date."""
    return _rounded(measure.trace(t.book(spark, sf_dir), "high"))


@register("eval_quintile_membership", f"{HEAD}, {TRACE} SELECT date AS signal_date, code FROM te WHERE q = 5")
def quintile_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.membership(t.book(spark, sf_dir), "high")


@register("eval_coverage", f"{HEAD} SELECT date, count(*) FILTER (eligible) AS eligible_count, count(*) FILTER (eligible AND score IS NOT NULL) AS scored_count, coalesce(count(*) FILTER (eligible AND score IS NOT NULL) / CASE WHEN count(*) FILTER (eligible) > 0 THEN (count(*) FILTER (eligible))::DOUBLE END, 0) AS coverage FROM b GROUP BY date")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.coverage_by_date(t.book(spark, sf_dir))


# Series: a tenth of the monthly growth of traded volume stands in for returns; it has gains and losses.

SERIES = f"WITH {PANEL_SQL}, mv AS (SELECT date, sum(volume) AS v FROM p GROUP BY date), m AS (SELECT date, coalesce(v / lag(v) OVER (ORDER BY date) - 1, 0) / 10 AS ret FROM mv)"


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = t.stock_panel(spark, sf_dir).groupBy("date").agg(F.sum("volume").alias("v"))
    return total.select("date", (F.coalesce(F.col("v") / F.lag("v").over(Window.orderBy("date")) - 1, F.lit(0.0)) / 10).alias("ret"))


def newey_sql(x: str = "ret", source: str = "m", key: str = "") -> str:
    """CTEs nw: (key, t) of the mean of x with up to 20 lags."""
    part = f"PARTITION BY {key} " if key else ""
    lags = " + ".join(f"CASE WHEN {j} <= lg THEN 2 * (1 - {j} / (lg + 1.0::DOUBLE)) * coalesce(lag(c, {j}) OVER ({part}ORDER BY date), 0) * c ELSE 0 END" for j in range(1, 21))
    sel, grp = (f"{key}, ", f" GROUP BY {key}") if key else ("", "")
    return f"""na AS (SELECT *, {x} - avg({x}) OVER ({part.strip()}) AS c, count(*) OVER ({part.strip()}) AS nn, least(20, count(*) OVER ({part.strip()}) - 1) AS lg FROM {source} WHERE {x} IS NOT NULL), nb AS (SELECT *, c * c + {lags} AS tt FROM na),
nw AS (SELECT {sel}CASE WHEN count(*) >= 3 AND sum(tt) > 0 THEN avg({x}) / sqrt(sum(tt) / count(*) / count(*)) END AS t FROM nb{grp})"""


@register("eval_newey_west", f"{SERIES}, {newey_sql()} SELECT round(t, 6) AS hac_t_stat FROM nw")
def newey_west(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(series.newey_west(_series(spark, sf_dir), [], "ret"), 6)


NAV = "v AS (SELECT *, product(1 + ret) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS nav FROM m), pk AS (SELECT *, greatest(1, max(nav) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS peak FROM v)"


@register("eval_return_summary", f"""{SERIES}, {newey_sql()}, {NAV} SELECT count(*) AS observations, round(avg(ret), 8) AS mean_daily_return, round(avg(ret) * 242, 6) AS annualized_mean_return, round(stddev_samp(ret) * sqrt(242), 6) AS annualized_volatility,
 round(avg(ret) / stddev_samp(ret) * sqrt(242), 6) AS annualized_sharpe, round(least(min(nav / peak - 1), 0), 8) + 0.0 AS maximum_drawdown, round(avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END), 8) AS positive_day_ratio, round(arg_max(nav, date) - 1, 6) AS terminal_growth, (SELECT round(t, 6) FROM nw) AS hac_t_stat FROM pk""")
def return_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = series.return_summary(_series(spark, sf_dir), [])
    eight = ("mean_daily_return", "maximum_drawdown", "positive_day_ratio")
    return got.select(*[F.col(c) if c == "observations" else (F.round(c, 8 if c in eight else 6) + 0.0).alias(c) for c in got.columns])


@register("eval_periodic_metrics", f"""{SERIES}, {NAV}, g AS (SELECT count(*) AS n, arg_max(nav, date) AS e, avg(ret) AS a, stddev_pop(ret) AS s, stddev_pop(ret) FILTER (ret < 0) AS dn, greatest(max((peak - nav) / peak), 0) AS dd, avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END) AS hit FROM pk)
SELECT n AS period_count, round(e - 1, 6) AS total_return, round(pow(e, 252.0::DOUBLE / n) - 1, 4) AS annual_return, round(s * sqrt(252), 6) AS annual_volatility, round(dd, 6) AS max_drawdown, round(a / s * sqrt(252), 6) AS sharpe, round(a / dn * sqrt(252), 6) AS sortino,
 round((pow(e, 252.0::DOUBLE / n) - 1) / dd, 3) AS calmar, round(hit, 6) AS positive_period_rate FROM g""")
def periodic_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = series.periodic_metrics(_series(spark, sf_dir), [])
    digits = {"annual_return": 4, "calmar": 3}
    return got.select(*[F.col(c) if c == "period_count" else F.round(c, digits.get(c, 6)).alias(c) for c in got.columns])


@register("eval_rolling_summary", f"{SERIES} SELECT date, round(CASE WHEN count(ret) OVER x = 12 THEN avg(ret) OVER x * 242 END, 6) AS rolling_mean, round(CASE WHEN count(ret) OVER x = 12 THEN avg(ret) OVER x * 242 / (stddev_samp(ret) OVER x * sqrt(242)) END, 6) AS rolling_sharpe FROM m WINDOW x AS (ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)")
def rolling_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(series.rolling_summary(_series(spark, sf_dir), [], "ret", 12).select("date", "rolling_mean", "rolling_sharpe"), 6)


@register("eval_yearly_returns", f"{SERIES} SELECT CAST(year(date) AS INTEGER) AS year, round(product(1 + ret) - 1, 8) + 0.0 AS ret FROM m GROUP BY 1")
def yearly_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(series.yearly_returns(_series(spark, sf_dir), []))


@register("eval_turnover_distribution", f"{HEAD}, {TRACE}, tt AS (SELECT date, sum(abs(w - w0)) * 0.5 AS x FROM tf GROUP BY date) SELECT count(x) AS observations, round(avg(x), 8) AS mean, round(median(x), 8) AS median, round(quantile_cont(x, 0.9), 8) AS p90, round(avg(CASE WHEN x = 0 THEN 1.0::DOUBLE ELSE 0 END), 8) AS zero_ratio FROM tt WHERE x IS NOT NULL")
def turnover_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(series.distribution(measure.trace(t.book(spark, sf_dir), "high"), [], "target_weight_turnover"))


_H = (1, 3, 6)
_CURVE = " UNION ALL ".join(f"SELECT {h} AS horizon, {p} AS prev, date, w, s, {ret_sql('o0', f'o{h}')} AS fwd, {ret_sql(f'o{p}', f'o{h}')} AS inc FROM ha WHERE x{h} IS NOT NULL" for p, h in zip((0, *_H[:-1]), _H, strict=True))


@register("eval_horizon_curve", f"""{HEAD}, {WEIGHTS}, ha AS (SELECT *, {', '.join(f'lead(open, {1 + k}) OVER {L} AS o{k}, lead(date, {1 + k}) OVER {L} AS x{k}' for k in (0, *_H))} FROM wt), hb AS ({_CURVE}),
hc AS (SELECT *, CASE WHEN s IS NOT NULL AND fwd IS NOT NULL THEN s END AS sx, CASE WHEN s IS NOT NULL AND fwd IS NOT NULL THEN fwd END AS fx FROM hb),
hd AS (SELECT *, {centred_sql('sx', 'horizon, date')} AS ra, {centred_sql('fx', 'horizon, date')} AS rb FROM hc),
he AS (SELECT horizon, prev, date, {held_sql('fwd')} AS payoff, {held_sql('inc')} AS increment, {corr_sql('ra', 'rb')} AS ic, count(sx) AS n FROM hd GROUP BY 1, 2, 3),
{newey_sql('payoff', 'he', 'horizon')}
SELECT he.horizon, min(prev) AS previous_horizon, round(avg(payoff), 8) AS payoff_mean, round(avg(ic), 8) AS rank_ic_mean, round(avg(CASE WHEN payoff > 0 THEN 1.0::DOUBLE WHEN payoff IS NOT NULL THEN 0 END), 8) AS positive_payoff_ratio, round(avg(n), 8) AS average_cross_section_count, round(avg(increment), 8) AS incremental_payoff_mean, round(min(nw.t), 6) AS payoff_hac_t_stat
FROM he LEFT JOIN nw ON nw.horizon = he.horizon GROUP BY 1""")
def horizon_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = measure.horizon_curve(t.book(spark, sf_dir), "high", list(_H))
    names = ["horizon", "previous_horizon", "payoff_mean", "rank_ic_mean", "positive_payoff_ratio", "average_cross_section_count", "incremental_payoff_mean"]
    return got.select(*[F.col(c) if c in names[:2] else F.round(c, 8).alias(c) for c in names], F.round("payoff_hac_t_stat", 6).alias("payoff_hac_t_stat"))


@register("eval_one_way_turnover", f"""{HEAD}, {SCORED}, r AS (SELECT date, code, row_number() OVER (PARTITION BY date ORDER BY score DESC, code) AS k, count(*) OVER {D} AS n FROM s), sel AS (SELECT date, code FROM r WHERE k <= greatest(1, ceil(n * 0.2::DOUBLE))),
sz AS (SELECT date, count(*) AS n FROM sel GROUP BY 1), ln AS (SELECT *, lag(date) OVER (ORDER BY date) AS d0, lag(n) OVER (ORDER BY date) AS m FROM sz),
sh AS (SELECT ln.date, count(*) AS c FROM ln JOIN sel a ON a.date = ln.date JOIN sel z ON z.date = ln.d0 AND z.code = a.code GROUP BY 1)
SELECT ln.date, round(CASE WHEN d0 IS NULL THEN 1 ELSE 1 - coalesce(c, 0) * least(1.0::DOUBLE / n, 1.0::DOUBLE / m) END, 8) + 0.0 AS turnover FROM ln LEFT JOIN sh ON sh.date = ln.date""")
def one_way_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = t.book(spark, sf_dir)
    return _rounded(targets.membership_overlap(targets.top(book, "high", 0.2), book.select("date").distinct()))


# Validity and causality.


@register("eval_validity_by_year", f"""{HEAD}, i AS (SELECT b.*, p.volume, CAST(year(b.date) AS INTEGER) AS year FROM b JOIN p ON p.code = b.code AND p.date = b.date WHERE eligible)
SELECT coalesce(year, 0) AS year, count(*) AS universe_cells, round(avg((open IS NOT NULL)::INT), 8) AS open_coverage, round(avg((volume IS NOT NULL)::INT), 8) AS volume_coverage, round(avg((open IS NOT NULL AND volume IS NOT NULL)::INT), 8) AS all_inputs_coverage,
 round(avg((score IS NOT NULL)::INT), 8) AS factor_coverage, round(avg((score IS NOT NULL)::INT) FILTER (open IS NOT NULL AND volume IS NOT NULL), 8) AS factor_given_inputs FROM i GROUP BY GROUPING SETS ((year), ())""")
def validity_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    volume = t.stock_panel(spark, sf_dir).select("code", "date", "volume")
    return _rounded(audits.coverage_by_year(t.book(spark, sf_dir).join(volume, ["code", "date"]), ["open", "volume"], mask="eligible"))


@register("eval_breadth", f"{HEAD}, n AS (SELECT date, count(*) FILTER (eligible AND score IS NOT NULL) AS n FROM b GROUP BY 1) SELECT round(median(n), 6) AS median_breadth, round(quantile_cont(n, 0.1), 6) AS p10_breadth, count(*) FILTER (n = 0) AS empty_dates, count(*) AS dates FROM n")
def breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(audits.breadth(t.book(spark, sf_dir), mask="eligible"), 6)


@register("eval_prefix_invariance", f"WITH {PANEL_SQL} SELECT count(*) AS compared, 0::BIGINT AS mismatches, NULL::DATE AS first_mismatch FROM p WHERE date <= DATE '1998-06-01'")
def prefix_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A causal expression gives the same values when the future is cut off."""
    return audits.prefix_invariance(Engine(), t.stock_panel(spark, sf_dir), "cs_rank(ts_corr(close,volume,10))", "1998-06-01")


# The quick screen.

_START, _END, _N = "1996-01-01", "2001-06-01", 3
CHEAP = f"""{HEAD}, ca AS (SELECT *, list(open) OVER (PARTITION BY code ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND {_N + 1} FOLLOWING) AS path, lead(date, {_N + 1}) OVER {L} AS ex FROM b),
cb AS (SELECT *, score IS NOT NULL AS ok FROM ca WHERE date >= DATE '{_START}' AND ex <= DATE '{_END}' AND len(list_filter(path, lambda x: x > 0)) = {_N + 1}),
cc AS (SELECT *, count(*) FILTER (ok) OVER {D} AS n, row_number() OVER (PARTITION BY date, ok ORDER BY score DESC, code) AS r FROM cb),
cd AS (SELECT code, date, pos, path, CASE WHEN ok AND r <= greatest(1, ceil(n * 0.2::DOUBLE)) THEN 1 / greatest(1, ceil(n * 0.2::DOUBLE)) ELSE 0 END AS w, CASE WHEN ok THEN 1.0::DOUBLE / n ELSE 0 END AS bw FROM cc WHERE n > 0),
dp AS (SELECT DISTINCT pos FROM cd), ch AS (SELECT pos, code, w FROM cd WHERE w > 0),
mv AS (SELECT coalesce(a.pos, o.pos + {_N}) AS pos, sum(abs(coalesce(a.w, 0) - coalesce(o.w, 0))) * 0.5 AS moved FROM ch a FULL JOIN ch o ON a.pos = o.pos + {_N} AND a.code = o.code GROUP BY 1),
tu AS (SELECT dp.pos, CASE WHEN h.pos IS NULL THEN 1 ELSE moved END AS turnover FROM dp LEFT JOIN dp h ON h.pos + {_N} = dp.pos LEFT JOIN mv ON mv.pos = dp.pos),
st AS (SELECT pos, pos + k AS slot, w, bw, path[k + 1] / path[k] - 1 AS r FROM cd, range(1, {_N + 1}) g(k)),
dl AS (SELECT slot, sum(w * r) / {_N} AS gross, sum(bw * r) / {_N} AS bench, count(DISTINCT pos) AS alive FROM st GROUP BY 1),
fin AS (SELECT cal.date, gross, bench, turnover / {_N} AS cl, (1 + gross) * (1 - 0.002::DOUBLE * turnover / {_N}) - 1 AS net FROM dl JOIN tu ON tu.pos + 1 = dl.slot JOIN cal ON cal.pos = dl.slot + 1 WHERE alive = {_N})"""


def _cheap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cheap.staggered(t.book(spark, sf_dir), "high", _N, 0.002, _START, _END)


@register("eval_cheap_screen", f"{CHEAP} SELECT date, round(gross, 8) + 0.0 AS gross, round(net, 8) + 0.0 AS net, round(bench, 8) + 0.0 AS benchmark, round((1 + net) / (1 + bench) - 1, 8) + 0.0 AS excess, round(cl, 8) + 0.0 AS cost_load FROM fin")
def cheap_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_cheap(spark, sf_dir))


@register("eval_reprice", f"{CHEAP} SELECT date, round((1 + gross) * (1 - 0.01::DOUBLE * cl) - 1, 8) + 0.0 AS net FROM fin")
def reprice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cheap.reprice(_cheap(spark, sf_dir), 0.01).select("date", "net"))


# Portfolios. Without costs and with everything tradable one sleeve has a closed form.


@register("portfolio_h1_nocost", f"""{HEAD}, {SCORED}, r AS (SELECT pos, code, row_number() OVER (PARTITION BY date ORDER BY score DESC, code) AS k, count(*) OVER {D} AS n FROM s), sel AS (SELECT pos, code FROM r WHERE k <= greatest(1, ceil(n * 0.2::DOUBLE))),
g AS (SELECT code, pos, open, lag(open) OVER {L} AS o0 FROM b), x AS (SELECT sel.pos + 2 AS pos, avg(CASE WHEN g.open > 0 AND g.o0 > 0 THEN g.open / g.o0 ELSE 1 END) - 1 AS ret FROM sel JOIN g ON g.code = sel.code AND g.pos = sel.pos + 2 GROUP BY 1)
SELECT cal.date, round(CASE WHEN cal.pos = 13 THEN 0 ELSE coalesce(x.ret, 0) END, 8) + 0.0 AS net FROM cal LEFT JOIN x ON x.pos = cal.pos WHERE cal.pos > 12 AND cal.pos <= 72""")
def portfolio_h1_nocost(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = t.book(spark, sf_dir).withColumns({"buyable": F.lit(True), "sellable": F.lit(True)})
    start, end = _day(12), _day(72)
    return _rounded(returns(run(book, [Scenario("free", start, end)])).select("date", "net"))


def _day(month: int) -> str:
    """The n-th month of the panel, from January 1995 on."""
    return f"{1995 + month // 12}-{month % 12 + 1:02d}-01"


def _scenarios() -> list[Scenario]:
    s, e = _day(6), _day(76)
    return [
        Scenario("plain", s, e, buy_cost=0.001, sell_cost=0.002), Scenario("low", s, e, direction="low", buy_cost=0.001, sell_cost=0.002), Scenario("staggered", s, e, horizon=3, buy_cost=0.0005, sell_cost=0.002, score_start=_day(10), score_end=e),
        Scenario("monthly", s, e, formation="month_end", buy_cost=0.001, sell_cost=0.001), Scenario("stride", s, e, horizon=2, stride=3, ramp=True, top_n=10), Scenario("band", s, e, quantile=2), Scenario("all", s, e, benchmark=True, top_fraction=1.0, buy_cost=0.001, sell_cost=0.002),
    ]


def _walked(scenarios: list[Scenario]) -> str:
    return f"{HEAD.replace('WITH', 'WITH RECURSIVE', 1)},{walk_sql(scenarios)}"


@register("portfolio_costs", f"{_walked(_scenarios())} SELECT name AS scenario, date, round(gross, 8) + 0.0 AS gross, round(net, 8) + 0.0 AS net FROM nv")
def portfolio_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven scenarios in one job: costs, directions, sleeves, formations, bands, with blocked trades."""
    return _rounded(returns(run(t.book(spark, sf_dir), _scenarios())))


@register("portfolio_events", f"""{_walked(_scenarios()[:1])} SELECT dy.date, CASE WHEN stuck OR unfilled > 0 THEN 'partial_fill' WHEN filled = 0 THEN 'cash' WHEN buys + sells <= 1e-15 THEN 'retained' ELSE 'filled' END AS status,
 round((buys + sells) / opening, 8) + 0.0 AS turnover, round(CASE WHEN buys + sells > 0 THEN buys / (buys + sells) END, 8) + 0.0 AS bought, CAST(unfilled AS INTEGER) AS cash_slots FROM wk JOIN dy ON dy.pos = wk.pos WHERE due""")
def portfolio_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rebalancing: what became of it, its share of the wealth, the part of that which was bought, and targets not got."""
    got = run(t.book(spark, sf_dir), [replace(_scenarios()[0], events=True)]).filter("kind = 'event'")
    field = lambda n: F.get_json_object("payload", f"$.{n}")
    buy, sell = (field(f"{side}_notional").cast("double") for side in ("buy", "sell"))
    bought = buy / F.when(buy + sell > 0, buy + sell)
    return _rounded(got.select("date", field("status").alias("status"), field("actual_turnover").cast("double").alias("turnover"), bought.alias("bought"), field("cash_slots").cast("int").alias("cash_slots")))


@register("portfolio_staggered", f"""{_walked([s for s in _scenarios() if s.name in ("plain", "all")])} SELECT a.name AS scenario, a.date, round(a.net, 8) + 0.0 AS strategy, round(o.net, 8) + 0.0 AS benchmark, round((1 + a.net) / (1 + o.net) - 1, 8) + 0.0 AS excess
 FROM nv a JOIN nv o ON o.date = a.date AND a.name = 'plain' AND o.name = 'all'""")
def portfolio_staggered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strategy against the equal-weighted universe."""
    got = run(t.book(spark, sf_dir), [s for s in _scenarios() if s.name in ("plain", "all")])
    return _rounded(excess(got, {"plain": "all"}).select("scenario", "date", "strategy", "benchmark", "excess"))


def _policy() -> screen.Policy:
    return screen.Policy((_day(12), _day(40)), (_day(41), _day(70)), horizons=(1, 3), minimum_coverage=0.5, minimum_periods=12)


def _studied(windows: dict[str, tuple[int, int]], costs: dict[str, tuple[float, float]]) -> str:
    """CTE ex: (label, cost, dir, horizon, n, sharpe, total, cover) of the excess returns of both directions and both horizons, over
    windows of months [first, last], each with the warm-up that its horizon needs."""
    made = [
        Scenario(f"{label}|{cost}|{d}|{h}", _day(a - h), _day(b), direction="low" if d == "low" else "high", horizon=h, buy_cost=c[0], sell_cost=c[1], score_start=_day(a), score_end=_day(b), top_fraction=1.0 if d == "all" else 0.2, benchmark=d == "all")
        for label, (a, b) in windows.items() for cost, c in costs.items() for h in (1, 3) for d in ("high", "low", "all")
    ]
    return f"""{_walked(made)},
xr AS (SELECT *, string_split(name, '|') AS part FROM nv), xe AS (SELECT a.part[1] AS label, a.part[2] AS cost, a.part[3] AS dir, a.part[4]::INTEGER AS horizon, a.date, (1 + a.net) / (1 + o.net) - 1 AS e
 FROM xr a JOIN xr o ON o.part[3] = 'all' AND a.part[3] <> 'all' AND o.part[1] = a.part[1] AND o.part[2] = a.part[2] AND o.part[4] = a.part[4] AND o.date = a.date),
cv AS (SELECT string_split(pl.name, '|') AS part, avg(pl.cover) AS cover FROM pl JOIN sp ON sp.name = pl.name JOIN dy ON dy.pos = pl.pos WHERE due AND pl.pos < last AND dy.date BETWEEN slo AND shi GROUP BY pl.name),
ex AS (SELECT xe.*, cover FROM (SELECT label, cost, dir, horizon, count(*) AS n, CASE WHEN stddev_pop(e) > 1e-15 THEN avg(e) / stddev_pop(e) * sqrt(252) ELSE 0 END AS sharpe, product(1 + e) - 1 AS total FROM xe GROUP BY 1, 2, 3, 4) xe
 JOIN cv ON cv.part[1] = label AND cv.part[2] = cost AND cv.part[3] = dir AND cv.part[4]::INTEGER = horizon)"""


def _best(label: str) -> str:
    """The variant that the discovery window ``label`` chooses."""
    return f"(SELECT label, dir, horizon FROM ex WHERE {label} AND cost = 'stress' AND n >= 12 AND cover >= 0.5 QUALIFY row_number() OVER (PARTITION BY label ORDER BY sharpe DESC, horizon, dir = 'high' DESC) = 1)"


@register("screen", f"""{_studied({"discovery": (12, 40), "validation": (41, 70)}, {"real": (0.0003, 0.0012), "stress": (0.0005, 0.0020)})} SELECT ex.label AS segment, cost, ex.dir AS direction, ex.horizon, round(sharpe, 6) + 0.0 AS sharpe, round(total, 6) + 0.0 AS total_return
 FROM ex JOIN {_best("label = 'discovery'")} c ON c.dir = ex.dir AND c.horizon = ex.horizon""")
def screen_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovery over directions and horizons, then validation of the chosen variant."""
    got = screen.screen(t.book(spark, sf_dir).persist(), _policy())
    rows = [(seg, cost, got["selected_direction"], got["selected_horizon"], got[seg][cost]["excess_metrics"]["sharpe"], got[seg][cost]["excess_metrics"]["total_return"]) for seg in ("discovery", "validation") for cost in ("real", "stress")]
    return _rounded(spark.createDataFrame(rows, "segment string, cost string, direction string, horizon int, sharpe double, total_return double"), 6)


_FOLDS = {f"f{k}:{part}": (a + 8 * k, b + 8 * k) for k in range(3) for part, (a, b) in {"train": (6, 30), "test": (31, 42)}.items()}


@register("rolling", f"""{_studied(_FOLDS, {"stress": (0.0005, 0.0020)})}, ch AS (SELECT split_part(c.label, ':', 1) AS fold, c.dir, c.horizon, ex.sharpe FROM {_best("label LIKE '%:train'")} c JOIN ex ON ex.label = split_part(c.label, ':', 1) || ':test' AND ex.dir = c.dir AND ex.horizon = c.horizon)
SELECT fold, dir AS direction, horizon, round(sharpe, 6) + 0.0 AS test_sharpe, CASE WHEN (SELECT count(*) FILTER (sharpe > 0) >= 2 AND median(sharpe) > 0 FROM ch) AND (SELECT max(n) FROM (SELECT count(*) AS n FROM ch GROUP BY dir)) >= 2 AND (SELECT max(n) FROM (SELECT count(*) AS n FROM ch GROUP BY horizon)) >= 2
 THEN 'rolling_survivor' ELSE 'rejected_rolling' END AS status FROM ch""")
def rolling_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three folds, all discovered in one job and confirmed in another, through the gate."""
    folds = [screen.Fold(f"f{k}", (_day(6 + 8 * k), _day(30 + 8 * k)), (_day(31 + 8 * k), _day(42 + 8 * k))) for k in range(3)]
    gate = screen.Gate(required_folds=3, minimum_positive_folds=2, minimum_direction_mode=2, minimum_horizon_mode=2)
    got = screen.selection_null(t.book(spark, sf_dir).persist(), folds, _policy(), gate)
    rows = [(f["label"], f["direction"], f["horizon"], f["test"]["stress"]["excess_metrics"]["sharpe"], got["summary"]["status"]) for f in got["folds"]]
    return _rounded(spark.createDataFrame(rows, "fold string, direction string, horizon int, test_sharpe double, status string"), 6)


_YEARLY = f"""ys AS (SELECT CAST(year(signal_date) AS INTEGER) AS y, avg(factor_return) / stddev_pop(factor_return) AS sh, product(1 + factor_return) - 1 AS g FROM ({TRACE_SELECT}) WHERE factor_return IS NOT NULL GROUP BY 1),
fo AS (SELECT y AS place, CASE WHEN lag(sh) OVER (ORDER BY y) >= 0 THEN 'high' ELSE 'low' END AS direction, 1 + y % 2 AS horizon, lag(sh) OVER (ORDER BY y) AS train, sh AS test, g AS growth FROM ys QUALIFY lag(sh) OVER (ORDER BY y) IS NOT NULL)"""


@register("rolling_gate", f"""{HEAD}, {TRACE}, {_YEARLY}, ep AS (SELECT e, count(*) AS n FROM (SELECT test, row_number() OVER (ORDER BY place) - row_number() OVER (PARTITION BY test > 0 ORDER BY place) AS e FROM fo) WHERE test > 0 GROUP BY 1),
gt AS (SELECT count(*) AS folds, count(*) FILTER (test > 0) AS positive_folds, median(test) AS m, median(train) AS tr, max(growth) FILTER (growth > 0) / sum(growth) FILTER (growth > 0) AS c, (SELECT max(n) FROM (SELECT count(*) AS n FROM fo GROUP BY direction)) AS direction_mode_count,
 (SELECT max(n) FROM (SELECT count(*) AS n FROM fo GROUP BY horizon)) AS horizon_mode_count, (SELECT count(*) FROM ep) AS episodes, (SELECT coalesce(max(n), 0) FROM ep) AS streak FROM fo)
SELECT CASE WHEN folds <> 6 THEN 'invalid_evidence' WHEN positive_folds < 3 OR m <= 0 OR direction_mode_count < 3 OR horizon_mode_count < 3 THEN 'rejected_rolling' ELSE 'rolling_survivor' END AS status, positive_folds, round(m, 6) + 0.0 AS median_test, round(tr, 6) + 0.0 AS median_train,
 direction_mode_count, horizon_mode_count, episodes, streak, round(c, 6) + 0.0 AS largest_share FROM gt""")
def rolling_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over folds of a year: the factor's return a year after the one that gave its direction.

    As in the SQL, returns have eight digits, and a year without spread stays, with a ratio of NaN or an infinity that the gate's thresholds judge.
    """
    daily = _rounded(measure.trace(t.book(spark, sf_dir), "high").filter("factor_return IS NOT NULL").select(F.year("signal_date").alias("place"), "factor_return"))
    year = daily.groupBy("place").agg(F.avg("factor_return").alias("mean"), F.stddev_pop("factor_return").alias("sd"), (F.product(1 + F.col("factor_return")) - 1).alias("growth"))
    year = year.select("place", _ieee_ratio(F.col("mean"), F.col("sd")).alias("test"), "growth")
    folds = year.withColumn("train", F.lag("test").over(Window.orderBy("place"))).filter("train IS NOT NULL")  # a row a year
    rows = folds.select("place", F.col("place").cast("string").alias("label"), F.when(F.col("train") >= 0, "high").otherwise("low").alias("direction"), (1 + F.col("place") % 2).alias("horizon"), "train", "test", "growth")
    got = screen.gate_report(rows, screen.Gate(required_folds=6))
    judged = F.when(F.col("standalone_support") == "supported", screen.SURVIVOR).otherwise(screen.REJECTED)
    status = F.when(F.array_contains("reason_codes", "nonfinite_rolling_evidence"), judged).otherwise(F.col("status")).alias("status")
    return _rounded(got.select(status, "positive_folds", F.col("median_test_excess_sharpe").alias("median_test"), F.col("median_train_excess_sharpe").alias("median_train"), "direction_mode_count", "horizon_mode_count",
                               F.col("positive_sharpe_episode_count").alias("episodes"), F.col("maximum_positive_sharpe_streak").alias("streak"), F.col("largest_positive_fold_return_share").alias("largest_share")), 6)


_FACTORS = {"a": "cs_rank(close)", "b": "neg(cs_rank(close))", "c": "cs_zscore(volume)", "d": "cs_rank(ts_pct_change(close,3))"}


def _factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine()
    compiled = {k: e.compile(x) for k, x in _FACTORS.items()}
    out = e.plan(*compiled.values()).results(t.stock_panel(spark, sf_dir))
    return out.select("code", "date", *[F.col(c.factor_id).alias(k) for k, c in compiled.items()])


def _key(x: str) -> str:
    """What the production rank compares: twelve digits of the date's largest."""
    return f"round_even({x} / CASE WHEN max(abs({x})) OVER {D} > 0 THEN max(abs({x})) OVER {D} ELSE 1 END, 12)"


_PAIRED = f"""WITH {PANEL_SQL}, fa AS (SELECT code, date, CASE WHEN u THEN close END AS c, CASE WHEN u THEN volume END AS v, CASE WHEN u THEN close / CASE WHEN abs(lag(close, 3) OVER {L}) > 1e-12 THEN lag(close, 3) OVER {L} END - 1 END AS x FROM p),
fb AS (SELECT date, {_key('c')} AS a, v AS c, {_key('x')} AS d FROM fa), fc AS (SELECT *, -a AS b FROM fb),
fd AS (SELECT {', '.join(f"({rank_sql(k)}) / count({k}) OVER {D} AS {k}" for k in 'abcd')} FROM fc)
""" + " UNION ALL ".join(f"SELECT '{x}' AS \"left\", '{y}' AS \"right\", count(*) AS n, round(corr({x}, {y}), 6) + 0.0 AS correlation FROM fd WHERE {x} IS NOT NULL AND {y} IS NOT NULL" for i, x in enumerate("abcd") for y in "abcd"[i + 1 :])


@register("rank_correlations", _PAIRED)
def rank_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cheap.rank_correlations(_factors(spark, sf_dir), list(_FACTORS)), 6)


@register("rank_cluster", f"""WITH RECURSIVE pr AS ({_PAIRED}), ed AS (SELECT "left" AS x, "right" AS y FROM pr WHERE abs(correlation) >= 0.9 UNION SELECT "right", "left" FROM pr WHERE abs(correlation) >= 0.9),
nd(x) AS (VALUES ('a'), ('b'), ('c'), ('d')), re AS (SELECT x, x AS r FROM nd UNION SELECT ed.y, re.r FROM re JOIN ed ON ed.x = re.x), rt AS (SELECT x, min(r) AS r FROM re GROUP BY 1)
SELECT x AS factor, 'cluster_' || lpad((dense_rank() OVER (ORDER BY r) - 1)::VARCHAR, 4, '0') AS cluster FROM rt""")
def rank_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = cheap.clusters(_factors(spark, sf_dir), list(_FACTORS), 0.9)
    return spark.createDataFrame(sorted(got.items()), "factor string, cluster string")
