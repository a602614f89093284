"""SQL that walks portfolios: a recursive query over dates, with the holdings of each sleeve as a list over securities."""

from __future__ import annotations

from collections.abc import Iterable

from .evaluation.portfolio import Scenario

#: Amounts that count as none.
TINY = "1e-15::DOUBLE"


def _zip(body: str) -> str:
    """A list over securities, from an expression of the place ``i``."""
    return f"list_transform(range(1, len(h) + 1), lambda i: {body})"


def _literal(s: Scenario) -> str:
    text = lambda x: f"'{x}'"
    number = lambda x: "NULL::INTEGER" if x is None else str(x)
    return (
        f"({text(s.name)}, {text(s.direction)}, {s.horizon}, {s.stride}, {text(s.formation)}, {s.top_fraction}::DOUBLE, {number(s.top_n)}, {number(s.quantile)}, {s.quantiles}, {s.benchmark}, {s.buy_cost}::DOUBLE, {s.sell_cost}::DOUBLE,"
        f" DATE '{s.start}', DATE '{s.end}', DATE '{s.score_start or s.start}', DATE '{s.score_end or s.end}', {s.ramp})"
    )


def walk_sql(scenarios: Iterable[Scenario]) -> str:
    """CTEs over the book ``b``: sc (scenarios), wk (every sleeve on every date), nv (name, date, gross, net, kept) of every walked date.

    Needs WITH RECURSIVE. Names of columns in wk: h holdings, cash, due (the sleeve was due), buys, sells, stuck, unfilled, filled.
    """
    return f"""
sc(name, dir, horizon, stride, formation, frac, top_n, band, bands, bench, bc, xc, lo, hi, slo, shi, ramp) AS (VALUES {", ".join(map(_literal, scenarios))}),
rk AS (SELECT pos, code, count(*) OVER (PARTITION BY pos) AS n, row_number() OVER (PARTITION BY pos ORDER BY score DESC, code) AS high, row_number() OVER (PARTITION BY pos ORDER BY score, code) AS low,
 rank() OVER (PARTITION BY pos ORDER BY score) - 1 + (count(*) OVER (PARTITION BY pos, score) - 1) / 2.0::DOUBLE AS mid FROM b WHERE eligible AND score IS NOT NULL),
chosen AS (SELECT name, pos, code FROM sc JOIN rk ON CASE WHEN bench THEN false WHEN band IS NOT NULL THEN band = CASE WHEN n = 1 THEN bands // 2 ELSE least(floor(mid / (n - 1) * bands), bands - 1) END
  WHEN top_n IS NOT NULL THEN CASE dir WHEN 'high' THEN high ELSE low END <= top_n ELSE CASE dir WHEN 'high' THEN high ELSE low END <= greatest(1, ceil(n * frac)) END
 UNION ALL SELECT name, pos, code FROM sc JOIN b ON bench AND eligible),
tg AS (SELECT sc.name, b.pos, list((c.code IS NOT NULL)::DOUBLE ORDER BY b.code) AS t, count(c.code) AS m FROM sc JOIN b ON true LEFT JOIN chosen c ON c.name = sc.name AND c.pos = b.pos AND c.code = b.code GROUP BY 1, 2),
gw AS (SELECT *, lag(open) OVER (PARTITION BY code ORDER BY pos) AS o0 FROM b),
dy AS (SELECT pos, min(date) AS date, list(CASE WHEN open > 0 AND o0 > 0 THEN open / o0 ELSE 1 END ORDER BY code) AS g, list(buyable ORDER BY code) AS y, list(sellable ORDER BY code) AS z,
 count(*) FILTER (eligible AND score IS NOT NULL) / greatest(1, count(*) FILTER (eligible))::DOUBLE AS cover FROM gw GROUP BY pos),
sp AS (SELECT sc.*, (SELECT min(pos) FROM dy WHERE date >= lo) AS first, (SELECT max(pos) FROM dy WHERE date <= hi) AS last FROM sc),
du AS (SELECT sp.name, a.pos, CASE formation WHEN 'session_stride' THEN (a.pos - 1 - first) % stride = 0 ELSE month(a.date) <> month(o.date) END AS due, old.t, old.m, o.cover FROM sp JOIN dy a ON a.pos > first AND a.pos <= last JOIN dy o ON o.pos = a.pos - 1 JOIN tg old ON old.name = sp.name AND old.pos = a.pos - 1),
pl AS (SELECT *, count(*) FILTER (due) OVER (PARTITION BY name ORDER BY pos) - 1 AS nth FROM du),
wk(name, k, pos, h, cash, opening, started, due, buys, sells, stuck, unfilled, filled) AS (
 SELECT name, k, first, list_transform((SELECT g FROM dy WHERE pos = first), lambda x: 0.0::DOUBLE), 1.0::DOUBLE / horizon, 0.0::DOUBLE, false, false, 0.0::DOUBLE, 0.0::DOUBLE, false, 0::BIGINT, 0::BIGINT FROM sp, LATERAL (SELECT unnest(range(horizon)) AS k)
 UNION ALL
 SELECT name, k, pos, CASE WHEN final THEN {_zip("CASE WHEN z[i] THEN 0 ELSE h2[i] END")} ELSE h2 END, cash3 + CASE WHEN final THEN list_sum({_zip("CASE WHEN z[i] THEN h2[i] ELSE 0 END")}) * (1 - xc) ELSE 0 END, opening, started OR act, act,
  list_sum(paid), list_sum(sold), act AND (list_sum({_zip(f"CASE WHEN gap[i] > {TINY} AND NOT y[i] OR gap[i] < -{TINY} AND NOT z[i] THEN 1 ELSE 0 END")}) > 0), CASE WHEN act THEN list_sum({_zip(f"CASE WHEN t[i] > 0 AND h2[i] <= {TINY} THEN 1 ELSE 0 END")})::BIGINT ELSE 0 END,
  CASE WHEN act THEN list_sum({_zip(f"CASE WHEN t[i] > 0 AND h2[i] > {TINY} THEN 1 ELSE 0 END")})::BIGINT ELSE 0 END
 FROM (SELECT *, {_zip("h1[i] - sold[i] + paid[i] * (1 - bc)")} AS h2, CASE WHEN cash2 - list_sum(paid) BETWEEN -1e-12 AND 0 THEN 0 ELSE cash2 - list_sum(paid) END AS cash3
 FROM (SELECT *, {_zip(f"CASE WHEN y[i] AND asked > 0 AND bid[i] * least(1, cash2 / asked) > {TINY} THEN bid[i] * least(1, cash2 / asked) ELSE 0.0::DOUBLE END")} AS paid
 FROM (SELECT *, cash + list_sum(sold) * (1 - xc) AS cash2, list_sum({_zip("CASE WHEN y[i] THEN bid[i] ELSE 0.0::DOUBLE END")}) AS asked
 FROM (SELECT *, {_zip(f"CASE WHEN z[i] AND gap[i] < -{TINY} THEN -gap[i] ELSE 0.0::DOUBLE END")} AS sold, {_zip(f"CASE WHEN gap[i] > {TINY} THEN gap[i] / (1 - bc) ELSE 0.0::DOUBLE END")} AS bid
 FROM (SELECT *, {_zip("CASE WHEN act THEN t[i] * greatest(opening, 0) / greatest(1, m) - h1[i] ELSE 0.0::DOUBLE END")} AS gap
 FROM (SELECT *, list_sum(h1) + cash AS opening
 FROM (SELECT wk.name, wk.k, pl.pos, wk.h, wk.cash, wk.started, {_zip("h[i] * dy.g[i]")} AS h1, pl.due AND pl.nth % sp.horizon = wk.k AND pl.pos < sp.last AS act, pl.pos = sp.last AS final, pl.t, pl.m, dy.y, dy.z, sp.bc, sp.xc
  FROM wk JOIN sp ON sp.name = wk.name JOIN pl ON pl.name = wk.name AND pl.pos = wk.pos + 1 JOIN dy ON dy.pos = pl.pos)))))))),
tt AS (SELECT name, pos, sum(list_sum(h) + cash) AS closing, sum(opening) AS opening, bool_and(started) AS ready FROM wk GROUP BY 1, 2),
nv AS (SELECT * FROM (SELECT tt.name, dy.pos, dy.date, opening / lag(closing) OVER q - 1 AS gross, closing / lag(closing) OVER q - 1 AS net, tt.pos > first AND dy.date BETWEEN slo AND shi AND (ramp OR ready) AS kept
 FROM tt JOIN sp ON sp.name = tt.name JOIN dy ON dy.pos = tt.pos WINDOW q AS (PARTITION BY tt.name ORDER BY tt.pos)) WHERE kept)"""
