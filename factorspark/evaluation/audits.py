"""Audits: does a factor use the future, and is there data behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..engine import Engine

#: Fixed value: largest difference between two evaluations of the same cell.
TOLERANCE = 1e-12
TARGET_LIKE = ("future", "forward", "label", "target", "next_", "lead_")


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: cells compared, mismatches (one side missing, or apart by more than the tolerance), first bad date."""
    a, b = left.select("code", "date", F.col("value").alias("_a")), right.select("code", "date", F.col("value").alias("_b"))
    bad: Column = F.col("_a").isNull() != F.col("_b").isNull()
    bad = bad | F.coalesce(F.abs(F.col("_a") - F.col("_b")) > TOLERANCE, F.lit(False))
    joined = a.join(b, ["code", "date"], "full_outer")
    return joined.agg(F.count("*").alias("compared"), F.count_if(bad).alias("mismatches"), F.min(F.when(bad, F.col("date"))).alias("first_mismatch"))


def prefix_invariance(engine: Engine, panel: DataFrame, expression: str, cutoff: str) -> DataFrame:
    """Values up to ``cutoff`` from the whole panel against those from the panel cut there: equal for a causal factor."""
    plan = engine.plan(engine.compile(expression))
    name = plan.expressions[0].factor_id
    early = F.col("date") <= F.lit(cutoff).cast("date")
    whole = plan.results(panel).filter(early).select("code", "date", F.col(name).alias("value"))
    part = plan.results(panel.filter(early)).select("code", "date", F.col(name).alias("value"))
    return compare(whole, part)


def coverage_by_year(panel: DataFrame, fields: list[str], factor: str = "score", mask: str = "in_universe") -> DataFrame:
    """Shares of universe cells with each field, all fields, and the factor: by year and over all years (year 0)."""
    inside = panel.filter(F.col(mask)).withColumn("year", F.year("date"))
    every = F.lit(True)
    for f in fields:
        every = every & F.col(f).isNotNull()
    share = lambda c: F.avg(c.cast("double"))
    out = inside.rollup("year").agg(
        F.count("*").alias("universe_cells"), *[share(F.col(f).isNotNull()).alias(f"{f}_coverage") for f in fields], share(every).alias("all_inputs_coverage"), share(F.col(factor).isNotNull()).alias("factor_coverage"),
        share(F.when(every, F.col(factor).isNotNull())).alias("factor_given_inputs"),
    )
    return out.withColumn("year", F.coalesce("year", F.lit(0)))


def breadth(panel: DataFrame, factor: str = "score", mask: str = "in_universe") -> DataFrame:
    """Median and tenth percentile of scored securities a date, and dates with none."""
    daily = panel.groupBy("date").agg(F.count_if(F.col(mask) & F.col(factor).isNotNull()).alias("n"))
    return daily.agg(F.percentile("n", F.lit(0.5)).alias("median_breadth"), F.percentile("n", F.lit(0.1)).alias("p10_breadth"), F.count_if(F.col("n") == 0).alias("empty_dates"), F.count("*").alias("dates"))


def reject_targets(fields: tuple[str, ...]) -> None:
    bad = [f for f in fields if any(t in f for t in TARGET_LIKE)]
    if bad:
        raise ValueError(f"fields look like targets: {bad}")
