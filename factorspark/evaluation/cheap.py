"""The quick staggered screen without execution constraints, and clustering of factors by rank correlation."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.windows import day, path


def staggered(book: DataFrame, direction: str, horizon: int, roundtrip_cost: float, start: str, end: str, fraction: float = 0.2, top_n: int | None = None, all_tradable: bool = False) -> DataFrame:
    """(date, gross, net, benchmark, excess, cost_load): daily returns of ``horizon`` overlapping books, fully relational.

    ``book`` is dense: code, date, pos, score, open. A decision needs every open of its holding period; its weights earn the
    ``horizon`` open-to-open returns from t+1 on. A date counts when ``horizon`` decisions are alive.
    """
    ahead = path().rowsBetween(1, horizon + 1)
    rows = book.withColumns({"_path": F.collect_list(F.when(F.col("open") > 0, F.col("open"))).over(ahead), "_exit": F.lead("date", horizon + 1).over(path())})
    rows = rows.filter((F.col("date") >= F.lit(start).cast("date")) & (F.col("_exit") <= F.lit(end).cast("date")) & (F.size("_path") == horizon + 1)).withColumn("_ok", F.col("score").isNotNull())
    n = F.count_if("_ok").over(day())
    size = F.greatest(F.lit(1), F.ceil(n * F.lit(float(fraction))))
    size = F.least(size, F.lit(top_n)) if top_n is not None else size
    order = F.col("score").desc() if direction == "high" else F.col("score").asc()
    base = F.count("*").over(day()) if all_tradable else n
    ranked = rows.withColumns({"_n": n, "_k": size, "_m": base, "_r": F.row_number().over(Window.partitionBy("date", "_ok").orderBy(order, "code"))}).filter("_n > 0")
    member = F.lit(True) if all_tradable else F.col("_ok")
    books = ranked.select("code", "date", "pos", "_path", F.when(F.col("_ok") & (F.col("_r") <= F.col("_k")), 1 / F.col("_k")).otherwise(0.0).alias("w"), F.when(member, 1 / F.col("_m")).otherwise(0.0).alias("b"))
    decisions = books.select("pos").distinct()
    # Turnover against the book of ``horizon`` dates before, on the union of their securities.
    chosen = books.filter("w > 0").select("pos", "code", "w")
    old = chosen.select((F.col("pos") + horizon).alias("pos"), "code", F.col("w").alias("w0"))
    moved = chosen.join(old, ["pos", "code"], "full_outer").groupBy("pos").agg((F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("w0", F.lit(0.0)))) * 0.5).alias("moved"))
    had = decisions.select((F.col("pos") + horizon).alias("pos"), F.lit(True).alias("had"))
    turnover = decisions.join(had, "pos", "left").join(moved, "pos", "left").select("pos", F.when(F.col("had"), F.col("moved")).otherwise(1.0).alias("turnover"))
    steps = books.select("pos", "w", "b", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda i: F.element_at("_path", i + 1) / F.element_at("_path", i) - 1)).alias("k", "r"))
    daily = steps.groupBy((F.col("pos") + 1 + F.col("k")).alias("at")).agg((F.sum(F.col("w") * F.col("r")) / horizon).alias("gross"), (F.sum(F.col("b") * F.col("r")) / horizon).alias("benchmark"), F.count_distinct("pos").alias("alive"))
    dated = book.select("pos", "date").distinct().select((F.col("pos") - 1).alias("at"), "date")
    joined = daily.filter(F.col("alive") == horizon).join(turnover.select((F.col("pos") + 1).alias("at"), (F.col("turnover") / horizon).alias("cost_load")), "at").join(dated, "at")
    net = (1 + F.col("gross")) * (1 - F.lit(roundtrip_cost) * F.col("cost_load")) - 1
    return joined.select("date", "gross", net.alias("net"), "benchmark", ((1 + net) / (1 + F.col("benchmark")) - 1).alias("excess"), "cost_load")


def reprice(result: DataFrame, roundtrip_cost: float) -> DataFrame:
    """The same books at another cost."""
    net = (1 + F.col("gross")) * (1 - F.lit(roundtrip_cost) * F.col("cost_load")) - 1
    return result.select("date", "gross", net.alias("net"), "benchmark", ((1 + net) / (1 + F.col("benchmark")) - 1).alias("excess"), "cost_load")


def rank_correlations(values: DataFrame, names: list[str]) -> DataFrame:
    """(left, right, n, correlation) of the percentile ranks of every pair of factor columns of ``values`` (code, date, ...).

    A row a pair and partition is shuffled, whatever the number of rows; the plan does not grow with the pairs.
    """
    names = list(names)
    ranks = values.select(*[_percentile_rank(n).alias(f"r{i}") for i, n in enumerate(names)])
    schema = "i int, j int, n bigint, x double, y double, xx double, yy double, xy double"

    def gram(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        """Sums over the rows of a partition on which both columns have a value, for all pairs at once: products of matrices."""
        k = len(names)
        both, one, square, cross = (np.zeros((k, k)) for _ in range(4))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float) if batch.num_rows else np.empty((0, k))
            there = (~np.isnan(x)).astype(float)
            x = np.where(there > 0, x - 0.5, 0.0)  # about their mean, so that little is lost in the differences below
            both += there.T @ there
            one += x.T @ there
            square += (x * x).T @ there
            cross += x.T @ x
        i, j = np.triu_indices(k, 1)
        columns = [i.astype(np.int32), j.astype(np.int32), both[i, j].astype(np.int64), one[i, j], one[j, i], square[i, j], square[j, i], cross[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "j", "n", "x", "y", "xx", "yy", "xy"])

    pairs = ranks.mapInArrow(gram, schema).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    sx, sy = F.col("xx") - F.col("x") * F.col("x") / F.col("n"), F.col("yy") - F.col("y") * F.col("y") / F.col("n")
    some = (F.col("n") >= 3) & (sx > 1e-12) & (sy > 1e-12)
    name = F.array(*[F.lit(n) for n in names])
    return pairs.select(name[F.col("i")].alias("left"), name[F.col("j")].alias("right"), "n", ((F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.when(some, F.sqrt(sx) * F.sqrt(sy))).alias("correlation"))


def _percentile_rank(name: str):
    from ..operators.windows import average_rank

    n = F.count(name).over(day())
    return F.when(F.col(name).isNotNull(), F.when(n == 1, 1.0).otherwise((average_rank(F.col(name), day(), n) * (n - 1) + 1) / n))


def clusters(values: DataFrame, names: list[str], threshold: float) -> dict[str, str]:
    """Factors joined by absolute rank correlations of at least ``threshold``, labelled in order of their first names.

    One row a pair of factors comes to the driver; the panel does not.
    """
    names = sorted(names)
    root = {n: n for n in names}
    for r in rank_correlations(values, names).collect():
        if r["correlation"] is not None and abs(r["correlation"]) >= threshold:
            a, b = root[r["left"]], root[r["right"]]
            root = {n: min(a, b) if x in (a, b) else x for n, x in root.items()}
    order = {x: f"cluster_{i:04d}" for i, x in enumerate(sorted(set(root.values())))}
    return {n: order[root[n]] for n in names}
