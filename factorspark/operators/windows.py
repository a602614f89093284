"""Windows over a long panel with columns code, date, pos (dense position of the date)."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

EPS = 1e-12


def path():
    """A security's rows in date order."""
    return Window.partitionBy("code").orderBy("pos")


def day():
    return Window.partitionBy("date")


def trailing(k: int):
    """The last k grid rows of a security, this one included."""
    return path().rowsBetween(-(k - 1), 0)


def so_far():
    return path().rowsBetween(Window.unboundedPreceding, 0)


def within(group: Column):
    return Window.partitionBy("date", group)


def full(k: int, *xs: Column) -> Column:
    """Whether all of these have a value on each of the last k rows."""
    together = xs[0] if len(xs) == 1 else F.when(xs[0].isNotNull() & xs[1].isNotNull(), F.lit(1))
    return F.count(together).over(trailing(k)) == k


def at_least_one(x: Column) -> Column:
    return F.greatest(F.lit(1.0), x)


def average_rank(key: Column, window, n: Column) -> Column:
    """(average one-based rank - 1) / (n - 1) among the keys of a window that are not null; 0.5 alone."""
    ordered = window.orderBy(key.asc_nulls_last())
    ties = F.count(key).over(ordered.rangeBetween(Window.currentRow, Window.currentRow))
    rank = F.rank().over(ordered) + (ties - 1) / F.lit(2.0) - 1
    return F.when(key.isNull(), None).when(n == 1, 0.5).otherwise(rank / F.when(n > 1, n - 1))


def centred_rank(key: Column, window, n: Column) -> Column:
    """Twice the average rank less twice its mean, among the ``n`` keys of a window that are not null: a whole number.

    Sums of such ranks and of their products are exact, whatever the order in which rows are added up.
    """
    ordered = window.orderBy(key.asc_nulls_last())
    ties = F.count(key).over(ordered.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(key.isNotNull(), 2 * F.rank().over(ordered).cast("bigint") + ties - n - 2)


def rank_correlation(a: Column, b: Column) -> Column:
    """Correlation of two ``centred_rank`` columns as an aggregate; missing for under two rows or a side that is all alike."""
    squares = F.sqrt(F.sum(a * a).cast("double")) * F.sqrt(F.sum(b * b).cast("double"))
    return F.sum(a * b).cast("double") / F.when(squares > 0, squares)
