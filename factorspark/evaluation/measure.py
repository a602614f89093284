"""Cross-sectional measurement of a factor: rank IC, the rank-weighted book, quintiles, turnover, horizons.

Input is a *book*: a dense panel (code, date, pos, eligible, score, open, close). A signal of date t is traded at the open
of t+1. Forward prices are leads on a security's rows (one shuffle by code); all statistics are windows and aggregates of a
date (one shuffle by date).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import newey_west
from ..operators.windows import average_rank, centred_rank, day, path, rank_correlation


def asset_return(entry: Column, leave: Column) -> Column:
    ok = (entry > 0) & (leave > 0)
    return F.when(ok, leave / F.when(ok, entry) - 1)


def directed(direction: str) -> Column:
    if direction not in ("high", "low"):
        raise ValueError("direction must be high or low")
    return F.when(F.col("eligible"), F.col("score") * (1.0 if direction == "high" else -1.0))


def mean_rank(x: Column, n: Column) -> Column:
    """Average one-based rank among the date's values."""
    return F.when(x.isNotNull(), F.when(n == 1, 1.0).otherwise(average_rank(x, day(), n) * (n - 1) + 1))


def rank_ic_by_date(book: DataFrame, horizon: int, start: str | None = None, end: str | None = None) -> DataFrame:
    """(date, rank_ic, n): Spearman correlation of scores with open-to-open returns over ``horizon`` days from t+1.

    Dates with under two pairs, or all alike on a side, are left out; signal and exit dates lie in [start, end].
    """
    if horizon <= 0:
        raise ValueError("the horizon must be positive")
    ahead = book.withColumns({"_in": F.lead("open", 1).over(path()), "_out": F.lead("open", 1 + horizon).over(path()), "_exit": F.lead("date", 1 + horizon).over(path())})
    rows = ahead.withColumn("_ret", asset_return(F.col("_in"), F.col("_out"))).filter(F.col("eligible") & F.col("score").isNotNull() & F.col("_ret").isNotNull() & F.col("_exit").isNotNull())
    if start is not None:
        rows = rows.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.filter(F.col("_exit") <= F.lit(end).cast("date"))
    return correlation_by_date(rows, "score", "_ret", "rank_ic")


def correlation_by_date(rows: DataFrame, x: str, y: str, name: str) -> DataFrame:
    """(date, name, n): correlation of the two average ranks of each date, from whole numbers: a correlation of zero is exactly zero."""
    n = F.count("*").over(day())
    ranks = rows.withColumns({"_a": centred_rank(F.col(x), day(), n), "_b": centred_rank(F.col(y), day(), n)})
    return ranks.groupBy("date").agg(rank_correlation(F.col("_a"), F.col("_b")).alias(name), F.count("*").alias("n")).filter(F.col(name).isNotNull())


def rank_ic_summary(by_date: DataFrame) -> DataFrame:
    g = by_date.agg(F.count("*").alias("observation_count"), F.avg("rank_ic").alias("rank_ic_mean"), F.stddev_samp("rank_ic").alias("_sd"), F.avg((F.col("rank_ic") > 0).cast("double")).alias("positive_rate"), F.avg("n").alias("_n"))
    sd = F.when(F.col("observation_count") > 0, F.coalesce("_sd", F.lit(0.0)))
    return g.select("observation_count", "rank_ic_mean", sd.alias("rank_ic_std"), (F.col("rank_ic_mean") / F.when(sd > 0, sd)).alias("rank_ic_ir"), "positive_rate", F.coalesce("_n", F.lit(0.0)).alias("average_cross_section_count"))


def rank_weights(score: Column) -> Column:
    """Weights with zero net and unit gross, linear in the average rank; 0 for what has no score."""
    n = F.count(score).over(day())
    centred = average_rank(score, day(), n) - 0.5  # the mean of (rank - 1) / (n - 1) is one half
    return centred


def with_weights(book: DataFrame, direction: str) -> DataFrame:
    """``book`` with _s (directed score) and weight."""
    scored = book.withColumn("_s", directed(direction)).withColumn("_c", rank_weights(F.col("_s")))
    gross = F.sum(F.abs("_c")).over(day())
    return scored.withColumn("weight", F.coalesce(F.col("_c") / F.when(gross > 1e-12, gross), F.lit(0.0))).drop("_c")


def held_return(weight: Column, ret: Column) -> Column:
    """Return of a book: 0 without holdings, missing if a held security's return is."""
    held = F.abs(weight) > 0
    return F.when(F.count_if(held) == 0, 0.0).when(F.count_if(held & ret.isNull()) > 0, None).otherwise(F.sum(F.when(held, weight * ret)))


def trace(book: DataFrame, direction: str) -> DataFrame:
    """One row a signal date: coverage, IC, book returns, turnovers, quintiles. The last two dates have no return yet."""
    w = with_weights(book, direction)
    ahead = w.withColumns({"_o1": F.lead("open", 1).over(path()), "_o2": F.lead("open", 2).over(path()), "_c1": F.lead("close", 1).over(path()), "_d1": F.lead("date", 1).over(path()), "_d2": F.lead("date", 2).over(path()), "_w0": F.lag("weight").over(path())})
    rows = ahead.withColumns({"_ret": asset_return(F.col("_o1"), F.col("_o2")), "_day": asset_return(F.col("_o1"), F.col("_c1")), "_night": asset_return(F.col("_c1"), F.col("_o2"))})
    scored = F.col("_s").isNotNull()
    fifth = F.when(scored & (F.count("_s").over(day()) >= 5), F.ntile(5).over(Window.partitionBy("date", scored).orderBy("_s", "code")))
    rows = rows.withColumn("_q", fifth).withColumn("_top", F.coalesce(F.col("_q") == 5, F.lit(False)))
    rows = rows.withColumn("_top0", F.lag("_top").over(path())).filter(F.col("_d2").isNotNull())
    both = F.when(scored & F.col("_ret").isNotNull(), F.lit(True))
    ranks = rows.withColumn("_b", both)
    n = F.count("_b").over(day())
    ranks = ranks.withColumns({"_ra": centred_rank(F.when(F.col("_b"), F.col("_s")), day(), n), "_rb": centred_rank(F.when(F.col("_b"), F.col("_ret")), day(), n)})
    q = {i: F.avg(F.when(F.col("_q") == i, F.col("_ret"))) for i in range(1, 6)}
    union = F.count_if(F.col("_top") | F.coalesce("_top0", F.lit(False)))
    g = ranks.groupBy("date").agg(
        F.min("pos").alias("_p"), F.min("_d1").alias("entry_date"), F.min("_d2").alias("exit_date"), F.count_if("eligible").alias("eligible_count"), F.count_if(scored).alias("scored_count"),
        F.sum(F.abs("weight")).alias("gross_exposure"), rank_correlation(F.col("_ra"), F.col("_rb")).alias("rank_ic"), F.count("_b").alias("rank_ic_count"),
        held_return(F.col("weight"), F.col("_ret")).alias("factor_return"), held_return(F.col("weight"), F.col("_day")).alias("intraday_return"), held_return(F.col("weight"), F.col("_night")).alias("overnight_return"),
        (F.sum(F.abs(F.col("weight") - F.col("_w0"))) * 0.5).alias("target_weight_turnover"), union.alias("_u"), F.count_if(F.col("_top") & F.coalesce("_top0", F.lit(False))).alias("_i"), *[q[i].alias(f"q{i}_return") for i in range(1, 6)],
    )
    return g.select(
        F.col("date").alias("signal_date"), "entry_date", "exit_date", "eligible_count", "scored_count", (F.col("scored_count") / F.when(F.col("eligible_count") > 0, F.col("eligible_count"))).alias("coverage"), "gross_exposure",
        "rank_ic", "rank_ic_count", "factor_return", "intraday_return", "overnight_return", "target_weight_turnover",
        F.when(F.col("_p") > 0, F.when(F.col("_u") > 0, 1 - F.col("_i") / F.when(F.col("_u") > 0, F.col("_u"))).otherwise(0.0)).alias("top20_membership_turnover"),
        F.col("q5_return").alias("top20_return"), F.col("q1_return").alias("bottom20_return"), (F.col("q5_return") - F.col("q1_return")).alias("top_bottom_return"), *[f"q{i}_return" for i in range(1, 6)],
    )


def membership(book: DataFrame, direction: str) -> DataFrame:
    """(signal_date, code) of the top fifth, without the last two dates."""
    s = book.withColumn("_s", directed(direction)).withColumn("_d2", F.lead("date", 2).over(path())).filter(F.col("_s").isNotNull() & F.col("_d2").isNotNull())
    five = s.withColumn("_n", F.count("*").over(day())).withColumn("_q", F.ntile(5).over(day().orderBy("_s", "code")))
    return five.filter("_n >= 5 and _q = 5").select(F.col("date").alias("signal_date"), "code")


def horizon_curve(book: DataFrame, direction: str, horizons: list[int]) -> DataFrame:
    """(horizon, payoff_mean, payoff_hac_t_stat, rank_ic_mean, ..., incremental_payoff_mean, ...) for rising horizons."""
    w = with_weights(book, direction)
    steps = list(zip([0, *horizons[:-1]], horizons, strict=True))
    opens = w.withColumns({f"_o{k}": F.lead("open", 1 + k).over(path()) for k in {0, *horizons}} | {f"_x{k}": F.lead("date", 1 + k).over(path()) for k in horizons})
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(p).alias("previous"), asset_return(F.col("_o0"), F.col(f"_o{h}")).alias("fwd"), asset_return(F.col(f"_o{p}"), F.col(f"_o{h}")).alias("inc"), F.col(f"_x{h}").isNotNull().alias("there")) for p, h in steps]))
    rows = opens.select("date", "code", "weight", "_s", each.alias("h")).select("date", "weight", "_s", "h.*").filter("there")
    both = F.when(F.col("_s").isNotNull() & F.col("fwd").isNotNull(), F.lit(True))
    by = Window.partitionBy("horizon", "date")
    ranks = rows.withColumn("_b", both)
    n = F.count("_b").over(by)
    ranks = ranks.withColumns({"_ra": centred_rank(F.when(F.col("_b"), F.col("_s")), by, n), "_rb": centred_rank(F.when(F.col("_b"), F.col("fwd")), by, n)})
    daily = ranks.groupBy("horizon", "previous", "date").agg(held_return(F.col("weight"), F.col("fwd")).alias("payoff"), held_return(F.col("weight"), F.col("inc")).alias("increment"), rank_correlation(F.col("_ra"), F.col("_rb")).alias("ic"), F.count("_b").alias("n"))
    out = daily.groupBy("horizon").agg(
        F.min("previous").alias("previous_horizon"), F.avg("payoff").alias("payoff_mean"), F.avg("ic").alias("rank_ic_mean"), F.avg((F.col("payoff") > 0).cast("double")).alias("positive_payoff_ratio"),
        F.avg("n").alias("average_cross_section_count"), F.avg("increment").alias("incremental_payoff_mean"),
    )
    for value, name in (("payoff", "payoff_hac_t_stat"), ("ic", "rank_ic_hac_t_stat"), ("increment", "incremental_payoff_hac_t_stat")):
        out = out.join(newey_west(daily, ["horizon"], value, name), "horizon", "left")
    return out


def horizon_diagnostics(curve: DataFrame) -> DataFrame:
    """One row about a horizon curve: where the mean payoff is largest in size, where it first has the other sign than at the
    shortest horizon, and where the added payoff is first not positive. Horizons without a payoff do not count."""
    known = curve.filter(F.col("payoff_mean").isNotNull())
    order = Window.orderBy("horizon").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row a horizon
    start = F.signum(F.first("payoff_mean").over(order))
    marked = known.withColumns({"_turned": (F.signum("payoff_mean") != 0) & (F.signum("payoff_mean") != start), "_flat": F.col("incremental_payoff_mean") <= 0})
    return marked.agg(
        F.max_by("horizon", F.struct(F.abs("payoff_mean"), -F.col("horizon"))).alias("strongest_absolute_horizon"),
        F.min(F.when(F.col("_turned"), F.col("horizon"))).alias("first_reversal_horizon"),
        F.min(F.when(F.col("_flat"), F.col("horizon"))).alias("first_nonpositive_increment_horizon"),
    )


def coverage_by_date(book: DataFrame) -> DataFrame:
    g = book.groupBy("date").agg(F.count_if("eligible").alias("eligible_count"), F.count_if(F.col("eligible") & F.col("score").isNotNull()).alias("scored_count"))
    return g.withColumn("coverage", F.coalesce(F.col("scored_count") / F.when(F.col("eligible_count") > 0, F.col("eligible_count")), F.lit(0.0)))


def extreme_share(trace_rows: DataFrame, value: str = "factor_return", n: int = 10) -> DataFrame:
    """Share of the ``n`` largest absolute returns in the sum of all."""
    x = trace_rows.filter(F.col(value).isNotNull()).select(F.abs(value).alias("x"))
    top = x.orderBy(F.desc("x")).limit(n).agg(F.sum("x").alias("t"))  # one row, like the total: their product is one row
    both = top.crossJoin(x.agg(F.sum("x").alias("s")))
    return both.select((F.col("t") / F.when(F.col("s") > 0, F.col("s"))).alias("extreme_abs_return_top10_share"))


def monotonicity(quintile_means: list[float | None]) -> float | None:
    """Correlation of the quintile means with 1 to 5, over those that are known."""
    known = [(i, m) for i, m in enumerate(quintile_means, 1) if m is not None]
    if len(known) < 2:
        return None
    n = len(known)
    mx, my = sum(i for i, _ in known) / n, sum(m for _, m in known) / n
    sxx, syy = sum((i - mx) ** 2 for i, _ in known), sum((m - my) ** 2 for _, m in known)
    return sum((i - mx) * (m - my) for i, m in known) / (sxx * syy) ** 0.5 if syy > 0 else None
