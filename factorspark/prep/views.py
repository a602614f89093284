"""Daily bars to research frames: units, limits, eligibility, liquidity, universe views, sidecars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DataError
from .intervals import in_interval, listing_age

#: Open days a security must have been listed, and exchanges whose securities are taken.
SEASONED_DAYS = 120
EXCHANGES = ("SSE", "SZSE")
#: Fixed value: the market label of the main board, "main board" in Chinese.
MAIN_BOARD = "\u4e3b\u677f"


def adjusted(bars: DataFrame) -> DataFrame:
    """Raw and back-adjusted prices, shares (lots of 100) and currency (thousands)."""
    prices = ("open", "high", "low", "close")
    return bars.select(
        "code", "date", "adj_factor", *[F.col(c).alias(f"raw_{c}") for c in prices], *[(F.col(c) * F.col("adj_factor")).alias(f"hfq_{c}") for c in prices],
        (F.col("vol") * 100).alias("volume_shares"), (F.col("amount") * 1000).alias("amount_cny"),
    )


def eligible(suspended: Column, st: Column, age: Column, listed: Column, positive: list[Column]) -> Column:
    """Seasoned, listed and not yet delisted, known not to be suspended, not under special treatment, with positive prices and activity."""
    ok = ~suspended & ~F.coalesce(st, F.lit(False)) & (age >= SEASONED_DAYS) & listed
    for x in positive:
        ok = ok & (x > 0)
    return F.coalesce(ok, F.lit(False))


def trailing_liquidity(amount: str = "amount", window: int = 20) -> Column:
    """Median of the ``window`` rows before this one, over a security's own rows."""
    before = Window.partitionBy("code").orderBy("date").rowsBetween(-window, -1)
    return F.when(F.count(amount).over(before) == window, F.percentile(amount, F.lit(0.5)).over(before))


def small_liquid(panel: DataFrame, liquidity: str, size: str, drop: float = 0.1, keep: int = 1000, flag: str = "dynamic_small_liquid") -> DataFrame:
    """Two-stage choice a date: without the ``drop`` share that is least liquid, the ``keep`` smallest; ties by code."""
    have = F.coalesce(F.col("in_universe") & (F.col(liquidity) > 0) & F.col(size).isNotNull(), F.lit(False))
    rank = F.row_number().over(Window.partitionBy("date", have).orderBy(liquidity, "code"))
    left = panel.withColumn("_have", have).withColumn("_liquid", F.col("_have") & (rank > F.ceil(F.count_if(have).over(Window.partitionBy("date")) * F.lit(float(drop)))))
    small = F.row_number().over(Window.partitionBy("date", "_liquid").orderBy(size, "code"))
    return left.withColumn(flag, F.col("_liquid") & (small <= keep)).drop("_have", "_liquid")


def tradable(open_price: Column, suspended: Column, up: Column, down: Column) -> tuple[Column, Column]:
    """(buyable, sellable) at the open: there is a price, trading, and the limit is known and not reached."""
    there = F.coalesce((open_price > 0) & ~suspended, F.lit(False))
    return there & F.coalesce(open_price < up, F.lit(False)), there & F.coalesce(open_price > down, F.lit(False))


def daily_basic(raw: DataFrame) -> DataFrame:
    return raw.select("code", "date", (F.col("turnover_rate_f") / 100).alias("turnover_free"), "volume_ratio", "pb", "circ_mv")


def money_flow(raw: DataFrame) -> DataFrame:
    """Net share of each order size, of all, and of the large sizes in the total; zero totals give none."""
    def net(*sizes: str) -> Column:
        buy, sell = sum(F.col(f"buy_{s}_amount") for s in sizes), sum(F.col(f"sell_{s}_amount") for s in sizes)
        return (buy - sell) / F.when(buy + sell > 0, buy + sell)

    every = ("sm", "md", "lg", "elg")
    total = sum(F.col(f"{side}_{s}_amount") for s in every for side in ("buy", "sell"))
    large = sum(F.col(f"{side}_{s}_amount") for s in ("lg", "elg") for side in ("buy", "sell"))
    names = {"sm": "small", "md": "medium", "lg": "large", "elg": "extra_large"}
    return raw.select("code", "date", *[net(s).alias(f"{n}_flow_imbalance") for s, n in names.items()], net(*every).alias("total_flow_imbalance"), (large / F.when(total > 0, total)).alias("large_flow_share"))


def require_empty(rows: DataFrame, message: str) -> None:
    """Raise if an integrity query finds anything; one row is enough to know."""
    bad = rows.limit(1).collect()
    if bad:
        raise DataError(f"{message}: {bad[0].asDict()}")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(rows: DataFrame, others: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key the other table lacks."""
    return rows.join(others.select(*keys).distinct(), list(keys), "left_anti")


def negative_flows(raw: DataFrame) -> DataFrame:
    columns = [c for c in raw.columns if c.endswith("_amount")]
    bad = F.lit(False)
    for c in columns:
        bad = bad | (F.col(c) < 0)
    return raw.filter(bad)


def research_frame(bars: DataFrame, states: DataFrame, master: DataFrame, st: DataFrame, calendar: DataFrame) -> DataFrame:
    """The production frame: bars and market states of listed securities with limits, age, eligibility and liquidity."""
    require_empty(duplicates(bars, "code", "date"), "bars repeat a key")
    require_empty(duplicates(states, "code", "date"), "states repeat a key")
    require_empty(duplicates(master, "code"), "the master repeats a code")
    require_empty(orphans(bars, states, "code", "date").select("code", "date"), "bars without a market state")
    require_empty(orphans(bars, master, "code").select("code"), "codes without a master row")
    joined = adjusted(bars).join(states.select("code", "date", "is_suspended", "up_limit", "down_limit"), ["code", "date"], "full_outer")
    joined = joined.join(master.select("code", "exchange", "market", "list_date", "delist_date"), "code", "left").filter(F.col("exchange").isin(*EXCHANGES))
    aged = in_interval(listing_age(joined, master, calendar), st, "is_st")
    listed = (F.col("list_date") <= F.col("date")) & (F.col("delist_date").isNull() | (F.col("date") <= F.col("delist_date")))
    positive = [F.col(c) for c in ("raw_open", "raw_high", "raw_low", "raw_close", "adj_factor", "volume_shares", "amount_cny")]
    out = aged.withColumns({
        "hfq_up_limit": F.col("up_limit") * F.col("adj_factor"), "hfq_down_limit": F.col("down_limit") * F.col("adj_factor"), "trailing_20d_median_amount_cny": trailing_liquidity("amount_cny"),
        "signal_eligible": eligible(F.col("is_suspended"), F.col("is_st"), F.col("listing_trading_days"), listed, positive),
    })
    return out.withColumns({"mainboard": F.col("signal_eligible") & (F.col("market") == MAIN_BOARD), "liquid_20m": F.col("signal_eligible") & F.coalesce(F.col("trailing_20d_median_amount_cny") >= 20_000_000, F.lit(False))})
