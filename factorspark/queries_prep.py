"""Registered queries of data preparation, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tables as t
from .prep import intervals, suspension, views
from .queries import PANEL_SQL, L, register, w
from .sources.plugins import merge_sources

OBS = "obs AS (SELECT DISTINCT l_suppkey AS code, CAST(l_shipdate AS DATE) AS date FROM lineitem)"
CALENDAR = """days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders),
cal0 AS (SELECT 'SSE' AS exchange, d, dayofweek(d) BETWEEN 1 AND 5 AS o FROM days UNION ALL SELECT 'SZSE', d, dayofweek(d) BETWEEN 1 AND 5 AND day(d) % 7 <> 0 FROM days)"""
MASTER = "master AS (SELECT l_suppkey AS code, CASE WHEN l_suppkey % 2 = 0 THEN 'SSE' ELSE 'SZSE' END AS exchange, CAST(min(l_shipdate) AS DATE) AS list_date FROM lineitem GROUP BY 1)"
SPECIAL = "st AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS s, CASE WHEN l_linenumber < 7 OR l_quantity < 40 THEN CAST(l_shipdate AS DATE) + CAST(l_linenumber * 10 AS INTEGER) END AS e FROM lineitem WHERE l_returnflag = 'R' AND l_tax > 0.075)"
SNAPSHOTS = """snap AS (SELECT * FROM (SELECT l_suppkey AS con_code, CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH AS DATE) - 1 AS snapshot_date,
  row_number() OVER (PARTITION BY date_trunc('quarter', l_shipdate) ORDER BY sum(l_quantity) DESC, l_suppkey) AS r FROM lineitem GROUP BY l_suppkey, date_trunc('quarter', l_shipdate)) WHERE r <= 30)"""
STOPPED = "ps AS (SELECT *, close IS NULL AND code % 2 = 0 AS susp FROM p)"


@register("prep_st_interval", f"WITH {OBS}, {SPECIAL} SELECT code, date, EXISTS (SELECT 1 FROM st WHERE st.code = obs.code AND obs.date >= st.s AND (st.e IS NULL OR obs.date <= st.e)) AS is_st FROM obs")
def st_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.in_interval(t.observations(spark, sf_dir), t.special_intervals(spark, sf_dir), "is_st")


@register("prep_category_pit", f"""WITH {OBS}, iv AS (SELECT DISTINCT l_suppkey AS code, CAST(l_shipdate AS DATE) AS s, CAST(l_shipdate AS DATE) + 60 AS e, l_linestatus || l_linenumber AS label FROM lineitem WHERE l_returnflag = 'A' AND l_tax < 0.005 AND l_quantity <= 10),
h AS (SELECT o.code, o.date, count(iv.code) AS hits, max(iv.label) AS label FROM obs o LEFT JOIN iv ON iv.code = o.code AND o.date BETWEEN iv.s AND iv.e GROUP BY 1, 2)
SELECT code, date, hits, CASE WHEN hits = 1 THEN CAST(CAST(CAST('0x' || substr(sha256(label), 1, 12) AS BIGINT) AS DOUBLE) AS DOUBLE) END AS category FROM h""")
def category_pit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.category_at(t.observations(spark, sf_dir), t.category_intervals(spark, sf_dir))


@register("prep_category_audit", f"""WITH {OBS}, iv AS (SELECT DISTINCT l_suppkey AS code, CAST(l_shipdate AS DATE) AS s, CAST(l_shipdate AS DATE) + 60 AS e, l_linestatus || l_linenumber AS label FROM lineitem WHERE l_returnflag = 'A' AND l_tax < 0.005 AND l_quantity <= 10),
h AS (SELECT o.code, o.date, count(iv.code) AS hits FROM obs o LEFT JOIN iv ON iv.code = o.code AND o.date BETWEEN iv.s AND iv.e GROUP BY 1, 2)
SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS observations, count(*) FILTER (hits = 0) AS missing, count(*) FILTER (hits = 1) AS "unique", count(*) FILTER (hits > 1) AS ambiguous FROM h GROUP BY 1""")
def category_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.category_audit(category_pit(spark, sf_dir))


@register("prep_listing_age", f"""WITH {OBS}, {CALENDAR}, {MASTER}
SELECT o.code, o.date, CAST(coalesce((SELECT count(*) FROM cal0 c WHERE c.exchange = m.exchange AND c.o AND c.d BETWEEN m.list_date AND o.date), 0) AS BIGINT) AS listing_trading_days FROM obs o JOIN master m ON m.code = o.code""")
def listing_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.listing_age(t.observations(spark, sf_dir), t.stock_master(spark, sf_dir), t.trade_calendar(spark, sf_dir))


@register("prep_snapshot_next_day", f"WITH {CALENDAR}, {SNAPSHOTS} SELECT con_code, snapshot_date, (SELECT min(d) FROM cal0 WHERE o AND exchange = 'SSE' AND d > snapshot_date) AS effective_date FROM snap")
def snapshot_next_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    calendar = t.trade_calendar(spark, sf_dir).filter("exchange = 'SSE'")
    return intervals.next_open_day(t.snapshots(spark, sf_dir), calendar).select("con_code", "snapshot_date", "effective_date")


@register("prep_membership_asof", f"""WITH {OBS}, {CALENDAR}, {SNAPSHOTS},
eff AS (SELECT con_code AS code, (SELECT min(d) FROM cal0 WHERE o AND exchange = 'SSE' AND d > snapshot_date) AS e FROM snap),
ed AS (SELECT e, lead(e) OVER (ORDER BY e) AS until FROM (SELECT DISTINCT e FROM eff))
SELECT o.code, o.date, EXISTS (SELECT 1 FROM eff JOIN ed ON ed.e = eff.e WHERE eff.code = o.code AND o.date >= ed.e AND (ed.until IS NULL OR o.date < ed.until)) AS member FROM obs o""")
def membership_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    calendar = t.trade_calendar(spark, sf_dir).filter("exchange = 'SSE'")
    return intervals.members_at(t.observations(spark, sf_dir), intervals.next_open_day(t.snapshots(spark, sf_dir), calendar))


@register("prep_snapshot_check", f"WITH {SNAPSHOTS} SELECT 'top' AS index_code, snapshot_date, count(*) AS rows, count(DISTINCT con_code) AS members FROM snap GROUP BY 2 HAVING abs(count(DISTINCT con_code) - 28) > 1 OR count(*) <> count(DISTINCT con_code)")
def snapshot_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.check_snapshots(t.snapshots(spark, sf_dir), 28, 1)


def _stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.stock_panel(spark, sf_dir).withColumn("suspended", F.col("close").isNull() & (F.col("code") % 2 == 0))


UP = "(PARTITION BY code ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@register("prep_suspension_fill", f"""WITH {PANEL_SQL}, {STOPPED}, q AS (SELECT *, max(CASE WHEN close IS NOT NULL THEN pos END) OVER {UP} AS seen, max(CASE WHEN close IS NULL AND NOT susp THEN pos END) OVER {UP} AS bar, last_value(close IGNORE NULLS) OVER {UP} AS c FROM ps)
SELECT code, date, CASE WHEN close IS NULL AND susp AND seen > coalesce(bar, -1) THEN c ELSE close END AS close, CASE WHEN volume IS NULL AND susp THEN 0 ELSE volume END AS volume FROM q""")
def suspension_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suspension.carry(_stopped(spark, sf_dir), ["close"], ["volume"]).select("code", "date", "close", "volume")


@register("prep_valuation_ffill", f"WITH {PANEL_SQL} SELECT code, date, last_value(open IGNORE NULLS) OVER {UP} AS open FROM p")
def valuation_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suspension.forward_fill(t.stock_panel(spark, sf_dir), ["open"]).select("code", "date", "open")


@register("prep_calendar_mean", f"WITH {PANEL_SQL} SELECT code, date, round(CASE WHEN count(volume) OVER {w(6)} >= 4 THEN avg(volume) OVER {w(6)} END, 6) AS value FROM p")
def calendar_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.stock_panel(spark, sf_dir).select("code", "date", F.round(suspension.calendar_mean("volume", 6, 4), 6).alias("value"))


@register("prep_calendar_slope", f"WITH {PANEL_SQL} SELECT code, date, round(CASE WHEN count(volume) OVER {w(6)} >= 4 THEN regr_slope(volume, pos) OVER {w(6)} END, 6) + 0.0 AS value FROM p")
def calendar_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.stock_panel(spark, sf_dir).select("code", "date", (F.round(suspension.calendar_slope("volume", 6, 4), 6) + 0.0).alias("value"))


@register("prep_observed_mean", f"WITH {PANEL_SQL}, q AS (SELECT *, avg(volume) OVER {w(5)} AS m, count(*) OVER {w(5)} AS n FROM p WHERE volume IS NOT NULL) SELECT p.code, p.date, round(CASE WHEN n = 5 THEN m END, 6) AS value FROM p LEFT JOIN q ON q.code = p.code AND q.date = p.date")
def observed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suspension.observed_mean(t.stock_panel(spark, sf_dir), "volume", 5, "value").select("code", "date", F.round("value", 6).alias("value"))


@register("prep_observation_class", f"""WITH {OBS}, m AS (SELECT DISTINCT o_custkey % 100 AS code, CAST(o_orderdate AS DATE) AS date FROM orders),
s AS (SELECT code, date, CASE WHEN (code + day(date)) % 5 = 0 THEN true WHEN (code + day(date)) % 5 < 4 THEN false END AS stop FROM m WHERE (code + month(date)) % 3 > 0)
SELECT m.code, m.date, CASE WHEN o.code IS NOT NULL THEN CASE WHEN stop IS NULL THEN 'observed_state_unknown' WHEN stop THEN 'confirmed_suspension_with_bar' ELSE 'observed_trading' END
  ELSE CASE WHEN stop IS NULL THEN 'unknown_state_missing_bar' WHEN stop THEN 'confirmed_suspension_no_bar' ELSE 'confirmed_non_suspension_missing_bar' END END AS observation_state
FROM m LEFT JOIN obs o ON o.code = m.code AND o.date = m.date LEFT JOIN s ON s.code = m.code AND s.date = m.date""")
def observation_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 100).alias("code"), F.to_date("o_orderdate").alias("date")).distinct()
    k = (F.col("code") + F.dayofmonth("date")) % 5
    states = members.filter((F.col("code") + F.month("date")) % 3 > 0).withColumn("is_suspended", F.when(k == 0, True).when(k < 4, False))
    return suspension.observation_class(members, t.observations(spark, sf_dir), states)


@register("prep_eligibility", f"""WITH {OBS}, {CALENDAR}, {MASTER}, {SPECIAL}
SELECT o.code, o.date, (o.code + day(o.date)) % 9 <> 0 AND (o.code + day(o.date)) % 10 <> 0
  AND NOT EXISTS (SELECT 1 FROM st WHERE st.code = o.code AND o.date >= st.s AND (st.e IS NULL OR o.date <= st.e))
  AND (SELECT count(*) FROM cal0 c WHERE c.exchange = m.exchange AND c.o AND c.d BETWEEN m.list_date AND o.date) >= 120 AND o.date >= m.list_date AS signal_eligible
FROM obs o JOIN master m ON m.code = o.code""")
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = intervals.listing_age(st_interval(spark, sf_dir), t.stock_master(spark, sf_dir), t.trade_calendar(spark, sf_dir)).join(t.stock_master(spark, sf_dir).select("code", "list_date"), "code")
    k = F.col("code") + F.dayofmonth("date")
    stopped = F.when(k % 9 == 0, True).when(k % 10 != 0, False)  # unknown where ten divides
    return obs.select("code", "date", views.eligible(stopped, F.col("is_st"), F.col("listing_trading_days"), F.col("date") >= F.col("list_date"), []).alias("signal_eligible"))


LIQUID = f"lq AS (SELECT *, CASE WHEN count(amount) OVER b = 6 THEN quantile_cont(amount, 0.5) OVER b END AS med FROM p WHERE amount IS NOT NULL WINDOW b AS (PARTITION BY code ORDER BY date ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))"


def _liquid(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = t.stock_panel(spark, sf_dir).filter(F.col("amount").isNotNull())
    return own.withColumn("liquidity", views.trailing_liquidity("amount", 6))


@register("prep_liquid_view", f"WITH {PANEL_SQL}, {LIQUID} SELECT code, date, round(med, 4) AS liquidity, coalesce(med >= 300000, false) AS liquid FROM lq")
def liquid_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _liquid(spark, sf_dir).select("code", "date", F.round("liquidity", 4).alias("liquidity"), F.coalesce(F.col("liquidity") >= 300000, F.lit(False)).alias("liquid"))


@register("prep_small_cap_view", f"""WITH {PANEL_SQL}, {LIQUID}, h AS (SELECT *, coalesce(u AND med > 0 AND close IS NOT NULL, false) AS have FROM lq),
r AS (SELECT *, have AND row_number() OVER (PARTITION BY date, have ORDER BY med, code) > ceil(count(*) FILTER (have) OVER (PARTITION BY date) * 0.1::DOUBLE) AS keep FROM h)
SELECT code, date, keep AND row_number() OVER (PARTITION BY date, keep ORDER BY close, code) <= 25 AS dynamic_small_liquid FROM r""")
def small_cap_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.small_liquid(_liquid(spark, sf_dir), "liquidity", "close", 0.1, 25).select("code", "date", "dynamic_small_liquid")


@register("prep_tradability", f"""WITH {PANEL_SQL}, q AS (SELECT *, lag(close) OVER {L} AS pc, (code + pos) % 7 = 0 AS stop FROM p)
SELECT code, date, coalesce(open > 0 AND NOT stop AND open < pc * 1.5::DOUBLE, false) AS buyable, coalesce(open > 0 AND NOT stop AND open > pc * 0.5::DOUBLE, false) AS sellable FROM q""")
def tradability(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("close").over(Window.partitionBy("code").orderBy("pos"))
    rows = t.stock_panel(spark, sf_dir).withColumns({"pc": before, "stop": (F.col("code") + F.col("pos")) % 7 == 0})
    buy, sell = views.tradable(F.col("open"), F.col("stop"), F.col("pc") * 1.5, F.col("pc") * 0.5)
    return rows.select("code", "date", buy.alias("buyable"), sell.alias("sellable"))


_SIZES = {"sm": "l_quantity <= 10", "md": "l_quantity > 10 AND l_quantity <= 25", "lg": "l_quantity > 25 AND l_quantity <= 40", "elg": "l_quantity > 40"}
_FLOW = "f AS (SELECT l_suppkey AS code, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, " + ", ".join(f"coalesce(sum(l_quantity) FILTER (l_linestatus = '{st}' AND {cond}), 0) AS {side}_{s}" for s, cond in _SIZES.items() for side, st in (("buy", "O"), ("sell", "F"))) + " FROM lineitem GROUP BY 1, 2)"
_R = "CASE WHEN {b} > 0 THEN ({a}) / ({b}) END"


@register("prep_moneyflow_ratio", f"WITH {_FLOW} SELECT code, date, " + ", ".join(f"round({_R.format(a=f'buy_{s} - sell_{s}', b=f'(buy_{s} + sell_{s})')}, 8) + 0.0 AS {n}_flow_imbalance" for s, n in (("sm", "small"), ("md", "medium"), ("lg", "large"), ("elg", "extra_large")))
          + f", round({_R.format(a='buy_sm + buy_md + buy_lg + buy_elg - sell_sm - sell_md - sell_lg - sell_elg', b='(buy_sm + buy_md + buy_lg + buy_elg + sell_sm + sell_md + sell_lg + sell_elg)')}, 8) + 0.0 AS total_flow_imbalance, round({_R.format(a='buy_lg + sell_lg + buy_elg + sell_elg', b='(buy_sm + buy_md + buy_lg + buy_elg + sell_sm + sell_md + sell_lg + sell_elg)')}, 8) + 0.0 AS large_flow_share FROM f")
def moneyflow_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("l_quantity") <= 10, "sm").when(F.col("l_quantity") <= 25, "md").when(F.col("l_quantity") <= 40, "lg").otherwise("elg")
    rows = t.lineitem(spark, sf_dir).select(F.col("l_suppkey").alias("code"), F.trunc("l_shipdate", "MM").alias("date"), "l_quantity", size.alias("size"), F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("side"))
    raw = rows.groupBy("code", "date").agg(*[F.coalesce(F.sum(F.when((F.col("size") == s) & (F.col("side") == side), F.col("l_quantity"))), F.lit(0.0)).alias(f"{side}_{s}_amount") for s in ("sm", "md", "lg", "elg") for side in ("buy", "sell")])
    got = views.money_flow(raw)
    return got.select("code", "date", *[(F.round(c, 8) + 0.0).alias(c) for c in got.columns[2:]])


@register("prep_plugin_outer_merge", """WITH a AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS x FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2), b AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS date, max(l_tax) AS y FROM lineitem WHERE l_linenumber = 2 GROUP BY 1, 2)
SELECT coalesce(a.code, b.code) AS code, coalesce(a.date, b.date) AS date, x, y FROM a FULL JOIN b ON a.code = b.code AND a.date = b.date""")
def plugin_outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.lineitem(spark, sf_dir).select(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("date"), "l_linenumber", "l_quantity", "l_tax")
    a = rows.filter("l_linenumber = 1").groupBy("code", "date").agg(F.sum("l_quantity").alias("x"))
    b = rows.filter("l_linenumber = 2").groupBy("code", "date").agg(F.max("l_tax").alias("y"))
    return merge_sources([a, b])


@register("prep_anti_join_check", f"WITH {OBS}, o AS (SELECT DISTINCT o_custkey AS code, CAST(o_orderdate AS DATE) AS date FROM orders) SELECT code, date FROM obs WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.code = obs.code AND o.date = obs.date)")
def anti_join_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("code"), F.to_date("o_orderdate").alias("date"))
    return views.orphans(t.observations(spark, sf_dir), other, "code", "date")


@register("prep_duplicate_check", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.duplicates(t.lineitem(spark, sf_dir), "l_orderkey", "l_linenumber")
