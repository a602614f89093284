"""The registered queries of the library's own operators, each with SQL that says the same over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine, category, field_catalog
from .operators.catalogs import catalog, everything
from .tables import stock_panel

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The panel in SQL: dense grid, position, universe.
PANEL_SQL = """
cells AS (
  SELECT l_suppkey AS code, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
         arg_min(u, (l_shipdate, u)) AS open, max(u) AS high, min(u) AS low, arg_max(u, (l_shipdate, u)) AS close,
         sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS amount
  FROM (SELECT *, CAST(floor(l_extendedprice / l_quantity * 100) AS DOUBLE) / 100 AS u FROM lineitem) GROUP BY 1, 2),
cal AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS pos FROM (SELECT DISTINCT date FROM cells)),
p AS (
  SELECT c.code, cal.date, cal.pos, open, high, low, close, volume, amount, CAST(s_nationkey AS DOUBLE) AS grp, coalesce(volume >= 60, false) AS u
  FROM (SELECT DISTINCT code FROM cells) c CROSS JOIN cal LEFT JOIN cells x ON x.code = c.code AND x.date = cal.date LEFT JOIN supplier ON s_suppkey = c.code)
"""


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def engine() -> Engine:
    return Engine(everything(), field_catalog(extra=(category("grp"),)))


def values(spark: SparkSession, sf_dir: str, expression: str, e: Engine | None = None, digits: int = 6) -> DataFrame:
    e = e or engine()
    compiled = e.compile(expression)
    out = e.plan(compiled).results(stock_panel(spark, sf_dir))
    return out.select("code", "date", (F.round(compiled.factor_id, digits) + 0.0).alias("value"))


def expression(name: str, text: str, sql: str | None, ctes: str = "", source: str = "p", digits: int = 6, plain: bool = False) -> None:
    """A query over one expression. ``sql`` gives its value over ``source``; the mask is put on here."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return values(spark, sf_dir, text, Engine(catalog("astock_formula_ops_v3"), field_catalog()) if plain else None, digits)

    run.__doc__ = f"{text} over monthly supplier bars."
    QUERIES[f"expr_{name}"] = run
    if sql is not None:
        SQL[f"expr_{name}"] = f"WITH {PANEL_SQL}{', ' + ctes if ctes else ''} SELECT code, date, round(CASE WHEN u THEN {sql} END, {digits}) + 0.0 AS value FROM {source}"


def w(k: int, extra: str = "") -> str:
    return f"(PARTITION BY code ORDER BY pos ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


L = "(PARTITION BY code ORDER BY pos)"
D = "(PARTITION BY date)"
G = "(PARTITION BY date, grp)"


def whole(x: str, k: int, body: str) -> str:
    return f"CASE WHEN count({x}) OVER {w(k)} = {k} THEN {body} END"


# Arithmetic and conditions.

expression("add", "add(close,open)", "close + open")
expression("sub", "sub(high,low)", "high - low")
expression("mul", "mul(close,volume)", "close * volume", digits=4)
expression("div", "div(close,sub(high,low))", "close / CASE WHEN abs(high - low) > 1e-12 THEN high - low END")
expression("neg", "neg(close)", "-close")
expression("abs", "abs(sub(close,open))", "abs(close - open)")
expression("signed_log", "signed_log(sub(close,open))", "sign(close - open) * ln(1 + abs(close - open))")
expression("signed_sqrt", "signed_sqrt(sub(close,open))", "sign(close - open) * sqrt(abs(close - open))")
expression("sign", "sign(sub(close,open))", "CAST(sign(close - open) AS DOUBLE)")
expression("signed_power", "signed_power(sub(div(close,open),1),1.5)", "sign(close / open - 1) * pow(abs(close / open - 1), 1.5)")
expression("panel_min", "panel_min(close,ts_delay(close,3))", "CASE WHEN close IS NOT NULL AND d IS NOT NULL THEN least(close, d) END", f"q AS (SELECT *, lag(close, 3) OVER {L} AS d FROM p)", "q")
expression("panel_max", "panel_max(close,ts_delay(close,3))", "CASE WHEN close IS NOT NULL AND d IS NOT NULL THEN greatest(close, d) END", f"q AS (SELECT *, lag(close, 3) OVER {L} AS d FROM p)", "q")
for _name, _sign in (("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<=")):
    expression(_name, f"where({_name}(close,ts_delay(close,1)),1,-1)", f"CASE WHEN c THEN 1.0::DOUBLE WHEN NOT c THEN -1.0::DOUBLE END", f"q AS (SELECT *, close {_sign} lag(close, 1) OVER {L} AS c FROM p)", "q")
expression("where", "where(gt(volume,200),close,ts_delay(open,1))", "CASE WHEN volume IS NULL THEN NULL WHEN volume > 200 THEN close ELSE d END", f"q AS (SELECT *, lag(open, 1) OVER {L} AS d FROM p)", "q")
expression(
    "trade_when", "trade_when(gt(close,open),ts_delta(close,2),lt(close,mul(open,0.9)))", "s.v",
    f"q AS (SELECT *, close - lag(close, 2) OVER {L} AS a FROM p), r AS (SELECT *, last_value(CASE WHEN close > open THEN {{'v': a}} WHEN close < open * 0.9::DOUBLE THEN {{'v': NULL::DOUBLE}} END IGNORE NULLS) OVER (PARTITION BY code ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM q)", "r",
)

# Cross-section. Ranks: average rank among the masked values that are not null.


def ranked(key: str, part: str = "date") -> str:
    """CTEs r(key) and t(n, value)."""
    return f"""r AS (SELECT *, {key} AS k FROM q), t AS (SELECT *, count(k) OVER (PARTITION BY {part}) AS n,
      rank() OVER (PARTITION BY {part} ORDER BY k ASC NULLS LAST) AS rk, count(*) OVER (PARTITION BY {part}, k) AS ties FROM r)"""


RANK = "CASE WHEN k IS NULL THEN NULL WHEN n = 1 THEN 0.5::DOUBLE ELSE (rk + (ties - 1) / 2.0::DOUBLE - 1) / (n - 1) END"
STABLE = "round_even(x / CASE WHEN max(abs(x)) OVER (PARTITION BY date) > 0 THEN max(abs(x)) OVER (PARTITION BY date) ELSE 1 END, 12)"
expression("flagship", "cs_rank(ts_pct_change(close,5))", RANK, f"q0 AS (SELECT *, lag(close, 5) OVER {L} AS d FROM p), q AS (SELECT *, CASE WHEN u THEN close / CASE WHEN abs(d) > 1e-12 THEN d END - 1 END AS x FROM q0), {ranked(STABLE)}", "t")
expression("cs_rank", "cs_rank(volume)", RANK, f"q AS (SELECT *, CASE WHEN u THEN volume END AS x FROM p), {ranked(STABLE)}", "t")
expression("cs_rank_plain", "cs_rank(volume)", RANK, f"q AS (SELECT *, CASE WHEN u THEN volume END AS x FROM p), {ranked('x')}", "t", plain=True)
MASKED = "q AS (SELECT *, CASE WHEN u THEN close END AS x, CASE WHEN u THEN volume END AS y FROM p)"
expression("cs_zscore", "cs_zscore(close)", f"CASE WHEN x IS NULL THEN NULL WHEN sd <= greatest(1, mx) * 1e-12 THEN 0 ELSE (x - m) / sd END", f"{MASKED}, r AS (SELECT *, stddev_pop(x) OVER {D} AS sd, avg(x) OVER {D} AS m, max(abs(x)) OVER {D} AS mx FROM q)", "r")
# To nine digits: a mean of cents over up to a hundred securities that ends at all ends at the eighth, so that no value lies between two roundings.
expression("cs_demean", "cs_demean(close)", f"x - avg(x) OVER {D}", MASKED, "q", digits=9)
expression("cs_winsorize", "cs_winsorize(close,0.05)", "CASE WHEN x IS NOT NULL THEN least(greatest(x, lo), hi) END", f"{MASKED}, r AS (SELECT *, quantile_cont(x, 0.05) OVER {D} AS lo, quantile_cont(x, 0.95) OVER {D} AS hi FROM q)", "r")
expression(
    "cs_residual", "cs_residual(close,volume)", "CASE WHEN n >= 3 AND v * n > n * pow(greatest(1, mx) * 1e-12, 2) THEN (x - mx1) - cv / v * (y - my) END",
    f"{MASKED}, r AS (SELECT *, count(y) OVER {D} AS n, var_pop(y) OVER {D} AS v, covar_pop(x, y) OVER {D} AS cv, avg(x) OVER {D} AS mx1, avg(y) OVER {D} AS my, max(abs(y)) OVER {D} AS mx FROM (SELECT * REPLACE (CASE WHEN y IS NOT NULL THEN x END AS x, CASE WHEN x IS NOT NULL THEN y END AS y) FROM q))", "r",
)
expression("group_demean", "group_demean(close,grp)", f"x - avg(x) OVER {G}", MASKED, "q")
expression("group_zscore", "group_zscore(close,grp)", "CASE WHEN x IS NULL THEN NULL WHEN sd <= greatest(1, abs(m), abs(x)) * 1e-12 THEN 0 ELSE (x - m) / sd END", f"{MASKED}, r AS (SELECT *, stddev_pop(x) OVER {G} AS sd, avg(x) OVER {G} AS m FROM q)", "r")
expression("group_rank", "group_rank(close,grp)", RANK, f"{MASKED}, {ranked('round_even(x / greatest(max(abs(x)) OVER (PARTITION BY date, grp), 1), 12)', 'date, grp')}", "t")

# Windows of one series.


def lagged(k: int, x: str = "close") -> str:
    return f"q AS (SELECT *, lag({x}, {k}) OVER {L} AS d FROM p)"


expression("ts_delay", "ts_delay(close,3)", "d", lagged(3), "q")
expression("ts_delta", "ts_delta(close,3)", "close - d", lagged(3), "q")
expression("ts_pct_change", "ts_pct_change(close,5)", "close / CASE WHEN abs(d) > 1e-12 THEN d END - 1", lagged(5), "q")
for _name, _fn in (("sum", "sum"), ("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
    expression(f"ts_{_name}", f"ts_{_name}(close,10)", whole("close", 10, f"{_fn}(close) OVER {w(10)}"))
expression("ts_zscore", "ts_zscore(close,10)", f"CASE WHEN n = 10 THEN CASE WHEN s = 0 THEN 0 WHEN s > 1e-12 THEN (close - m) / s END END", f"q AS (SELECT *, count(close) OVER {w(10)} AS n, avg(close) OVER {w(10)} AS m, stddev_samp(close) OVER {w(10)} AS s FROM p)", "q")
expression("ts_scale", "ts_scale(close,10)", "CASE WHEN n = 10 AND hi - lo > 1e-12 THEN (close - lo) / (hi - lo) END", f"q AS (SELECT *, count(close) OVER {w(10)} AS n, min(close) OVER {w(10)} AS lo, max(close) OVER {w(10)} AS hi FROM p)", "q")
for _name, _fn in (("skew", "skewness"), ("kurt", "kurtosis")):
    expression(f"ts_{_name}", f"ts_{_name}(close,10)", f"CASE WHEN n = 10 AND s > greatest(1, mx) * 1e-12 THEN f END", f"q AS (SELECT *, count(close) OVER {w(10)} AS n, stddev_samp(close) OVER {w(10)} AS s, max(abs(close)) OVER {w(10)} AS mx, {_fn}(close) OVER {w(10)} AS f FROM p)", "q")
expression("ts_slope", "ts_slope(close,10)", whole("close", 10, f"regr_slope(close, pos) OVER {w(10)}"))
expression("ts_r2", "ts_r2(close,10)", f"CASE WHEN n = 10 AND v > 0 THEN least(1, greatest(0, f)) END", f"q AS (SELECT *, count(close) OVER {w(10)} AS n, var_samp(close) OVER {w(10)} AS v, regr_r2(close, pos) OVER {w(10)} AS f FROM p)", "q")
expression("ts_product", "ts_product(div(close,open),5)", whole("x", 5, f"product(x) OVER {w(5)}"), "q AS (SELECT *, close / CASE WHEN abs(open) > 1e-12 THEN open END AS x FROM p)", "q", digits=5)
#: Windows as lists.
LISTED = "q AS (SELECT *, count(close) OVER {w} AS n, list(close) OVER {w} AS v FROM p)"


def listed(k: int) -> str:
    return LISTED.format(w=w(k))


def over_list(name: str, text: str, k: int, sql: str, digits: int = 6) -> None:
    expression(name, text, f"CASE WHEN n = {k} THEN {sql} END", listed(k), "q", digits)


TWICE = "(2 * len(list_filter(v, lambda a: a < close)) + len(list_filter(v, lambda a: a = close)) - 1)"
over_list("ts_rank", "ts_rank(close,10)", 10, f"{TWICE} / 18.0::DOUBLE")
for _name, _fn in (("argmin", "list_min"), ("argmax", "list_max")):
    over_list(f"ts_{_name}", f"ts_{_name}(close,10)", 10, f"CAST(10 - list_max(list_transform(v, lambda a, i: CASE WHEN abs(a - {_fn}(v)) <= 1e-12 + 1e-12 * abs({_fn}(v)) THEN i ELSE 0 END)) AS DOUBLE)")
over_list("ts_decay_linear", "ts_decay_linear(close,10)", 10, "list_sum(list_transform(v, lambda a, i: a * i)) / 55")
over_list("ts_mean_abs_dev", "ts_mean_abs_dev(close,10)", 10, "list_sum(list_transform(v, lambda a: abs(a - list_avg(v)))) / 10")
over_list("ts_median", "ts_median(close,10)", 10, "list_median(v)")
MOVES = "list_transform(range(2, len(v) + 1), lambda i: v[i] - v[i - 1])"
THRESHOLD = "(greatest(1, list_max(list_transform(v, lambda a: abs(a)))) * 1e-12)"
over_list("ts_path_efficiency", "ts_path_efficiency(close,10)", 10, f"CASE WHEN list_sum(list_transform({MOVES}, lambda d: abs(d))) > {THRESHOLD} THEN abs(v[10] - v[1]) / list_sum(list_transform({MOVES}, lambda d: abs(d))) END")
_SIGNS = f"list_filter(list_transform({MOVES}, lambda d: CASE WHEN d > {THRESHOLD} THEN 1 WHEN d < -{THRESHOLD} THEN -1 ELSE 0 END), lambda s: s <> 0)"
over_list("ts_turning_rate", "ts_turning_rate(close,10)", 10, f"CASE WHEN len({_SIGNS}) >= 2 THEN list_sum(list_transform(range(2, len({_SIGNS}) + 1), lambda i: CASE WHEN {_SIGNS}[i] <> {_SIGNS}[i - 1] THEN 1 ELSE 0 END)) / CAST(len({_SIGNS}) - 1 AS DOUBLE) END")
_ALL = f"list_transform({MOVES}, lambda d: CASE WHEN d > {THRESHOLD} THEN 1 WHEN d < -{THRESHOLD} THEN -1 ELSE 0 END)"
over_list("ts_signed_run_length", "ts_signed_run_length(close,10)", 10, f"CASE WHEN s[9] <> 0 THEN s[9] * (9 - coalesce(list_max(list_transform(range(1, 10), lambda i: CASE WHEN s[i] <> s[9] THEN i END)), 0)) / 9.0::DOUBLE END".replace("s[", f"({_ALL})["))
_PAIRS = "list_transform(range(2, len(v) + 1), lambda i: CASE WHEN v[i] - v[i - 1] > greatest(abs(v[i]), abs(v[i - 1]), 1) * 1e-8 THEN 1 WHEN v[i] - v[i - 1] < -greatest(abs(v[i]), abs(v[i - 1]), 1) * 1e-8 THEN -1 ELSE 0 END)"
over_list("ts_change_rate", "ts_change_rate(volume,10)", 10, f"len(list_filter({_PAIRS}, lambda s: s <> 0)) / 9.0::DOUBLE")
SQL["expr_ts_change_rate"] = SQL["expr_ts_change_rate"].replace("list(close)", "list(volume)").replace("count(close)", "count(volume)")
expression("ts_longest_signed_run", "ts_longest_signed_run(close,10)", "CASE WHEN n = 10 THEN best[3] * best[1] / 9.0::DOUBLE END", f"{listed(10)}, r AS (SELECT *, {_PAIRS} AS s FROM q), t AS (SELECT *, list_max(list_filter(list_transform(range(1, 82), lambda i: CASE WHEN (i - 1) // 9 <= (i - 1) % 9 AND s[(i - 1) // 9 + 1] <> 0 AND len(list_filter(s[(i - 1) // 9 + 1:(i - 1) % 9 + 1], lambda z: z <> s[(i - 1) // 9 + 1])) = 0 THEN [(i - 1) % 9 - (i - 1) // 9 + 1, (i - 1) % 9, s[(i - 1) // 9 + 1]] END), lambda z: z IS NOT NULL)) AS best0 FROM r), t2 AS (SELECT *, [best0[1], best0[2], best0[3]] AS best FROM t)", "t2")


def _normal_table(k: int) -> str:
    from statistics import NormalDist

    return "[" + ", ".join(f"{NormalDist().inv_cdf(min(max(i / (2 * (k - 1)), 0.5 / k), 1 - 0.5 / k))!r}::DOUBLE" for i in range(2 * k - 1)) + "]"


over_list("ts_gaussianize", "ts_gaussianize(close,10)", 10, f"list_extract({_normal_table(10)}, {TWICE} + 1)")
expression(
    "ts_ema", "ts_ema(close,10)", "CASE WHEN n >= 10 THEN m END",
    """e AS (
  SELECT code, pos, close AS m, CASE WHEN close IS NULL THEN 0 ELSE 1 END AS n, 1.0::DOUBLE AS wt FROM p WHERE pos = 0
  UNION ALL
  SELECT p.code, p.pos,
         CASE WHEN e.m IS NULL THEN p.close WHEN p.close IS NULL THEN e.m ELSE (e.wt * a.k * e.m + a.j * p.close) / (e.wt * a.k + a.j) END,
         e.n + CASE WHEN p.close IS NULL THEN 0 ELSE 1 END,
         CASE WHEN e.m IS NULL OR p.close IS NOT NULL THEN 1.0::DOUBLE ELSE e.wt * a.k END
  FROM e JOIN p ON p.code = e.code AND p.pos = e.pos + 1, (SELECT 2.0::DOUBLE / 11 AS j, 1 - 2.0::DOUBLE / 11 AS k) a),
q AS (SELECT p.*, e.m, e.n FROM p JOIN e ON e.code = p.code AND e.pos = p.pos)""", "q",
)
SQL["expr_ts_ema"] = SQL["expr_ts_ema"].replace("WITH ", "WITH RECURSIVE ", 1)

# Windows of two series.

PAIR = f"q AS (SELECT *, count(CASE WHEN close IS NOT NULL AND volume IS NOT NULL THEN 1 END) OVER {w(10)} AS n, covar_samp(close, volume) OVER {w(10)} AS cv, stddev_samp(close) OVER {w(10)} AS s1, stddev_samp(volume) OVER {w(10)} AS s2, var_samp(volume) OVER {w(10)} AS v2 FROM p)"
expression("ts_corr", "ts_corr(close,volume,10)", "CASE WHEN n = 10 AND s1 > 1e-12 AND s2 > 1e-12 THEN least(1, greatest(-1, cv / (s1 * s2))) END", PAIR, "q")
expression("ts_cov", "ts_cov(close,volume,10)", "CASE WHEN n = 10 THEN cv END", PAIR, "q", digits=4)
expression("ts_beta", "ts_beta(close,volume,10)", "CASE WHEN n = 10 AND v2 > 1e-12 THEN cv / v2 END", PAIR, "q")
expression("ts_regression_residual", "ts_regression_residual(close,volume,10)", f"CASE WHEN n = 10 AND v2 * 9 > pow(greatest(1, mx), 2) * 1e-24 THEN close - m1 - cv / v2 * (volume - m2) END", f"{PAIR}, r AS (SELECT *, avg(close) OVER {w(10)} AS m1, avg(volume) OVER {w(10)} AS m2, max(abs(volume)) OVER {w(10)} AS mx FROM q)", "r")

# The last distinct level: where levels do not drift within the tolerance, islands of equal values say the same.

ISLANDS = f"""a AS (SELECT *, {{x}} AS x FROM p),
b AS (SELECT *, last_value(x IGNORE NULLS) OVER (PARTITION BY code ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM a),
c AS (SELECT *, CASE WHEN x IS NOT NULL AND before IS NOT NULL AND abs(x - before) > greatest(abs(x), abs(before), 1) * 1e-8 THEN {{{{'p': before, 'e': pos - 1}}}} END AS ch FROM b),
q AS (SELECT *, last_value(ch IGNORE NULLS) OVER (PARTITION BY code ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM c)"""
_KNOWN = "x IS NOT NULL AND s IS NOT NULL AND pos >= 9 AND s.e >= pos - 9"
for _name, _body in (("ts_last_change", "x - s.p"), ("ts_last_pct_change", "CASE WHEN abs(s.p) > 1e-12 THEN x / s.p - 1 END"), ("ts_days_since_change", "CAST(pos - s.e - 1 AS DOUBLE)")):
    _x = "sign(volume - 200) + 2"
    expression(_name, f"{_name}(add(sign(sub(volume,200)),2),10)", f"CASE WHEN {_KNOWN} THEN {_body} END", ISLANDS.format(x=f"CAST({_x} AS DOUBLE)"), "q")


# Many expressions in one plan.


@register("expr_batch_shared", f"WITH {PANEL_SQL}, q AS (SELECT *, lag(close, 5) OVER {L} AS d5, lag(close, 1) OVER {L} AS d1 FROM p) SELECT code, date, round(CASE WHEN u THEN close / CASE WHEN abs(d5) > 1e-12 THEN d5 END - 1 END, 6) + 0.0 AS a, round(CASE WHEN u THEN -(close / CASE WHEN abs(d5) > 1e-12 THEN d5 END - 1) END, 6) + 0.0 AS b, round(CASE WHEN u THEN close - d1 END, 6) + 0.0 AS c FROM q")
def expr_batch_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three expressions that share sub-expressions, one pass."""
    e = engine()
    compiled = [e.compile(t) for t in ("ts_pct_change(close,5)", "neg(ts_pct_change(close,5))", "ts_delta(close,1)")]
    out = e.plan(*compiled).results(stock_panel(spark, sf_dir))
    return out.select("code", "date", *[(F.round(c.factor_id, 6) + 0.0).alias(n) for c, n in zip(compiled, "abc", strict=True)])
