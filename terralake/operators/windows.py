"""Window functions over time-ordered series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralake.operators.rows import order_columns
from terralake.operators.scan import Ranges


def lag_by(c: str, n: int, keys: Sequence[str], order: Sequence[str]) -> Column:
    return F.lag(F.col(c), n).over(Window.partitionBy(*keys).orderBy(*order))


def moving_mean(
    c: str, first: int, last: int, keys: Sequence[str], order: Sequence[str]
) -> Column:
    """Mean of a row frame by offset: (-20, -7) is the 14 rows that end a week ago."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(first, last)
    return F.avg(c).over(window)


def with_running_sum(df: DataFrame, name: str, c: str, order: Sequence[str], keys: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Adds the running total in the given order, per key or over all rows.

    Without keys rows are dealt out by ranges of the order, so none of the tasks sees them all.
    """
    if not keys:
        return Ranges.of(df, order, parts).running(name, F.col(c)).done()
    window = Window.partitionBy(*keys).orderBy(*order_columns(order))
    return df.withColumn(name, F.sum(c).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def with_regime(
    df: DataFrame,
    c: str,
    order: Sequence[str],
    changed: str = "coverage_regime_change",
    regime: str = "coverage_regime",
    keys: Sequence[str] = (),
    parts: int | None = None,
) -> DataFrame:
    """Consecutive rows with one value share a regime number, counted from 0; `changed` is NULL on the first row.

    Without keys rows are dealt out by ranges of the order; value and number are carried over their borders.
    """
    step = F.when(F.col(changed), 1).otherwise(0)
    if not keys:
        ranges = Ranges.of(df, order, parts).lagged("_earlier", c)
        ranges = Ranges(ranges.rows.withColumn(changed, F.col(c) != F.col("_earlier")).drop("_earlier"))
        return ranges.running(regime, step).done()
    window = Window.partitionBy(*keys).orderBy(*order_columns(order))
    flagged = df.withColumn(changed, F.col(c) != F.lag(c).over(window))
    return flagged.withColumn(regime, F.sum(step).over(window))


def over_keys(aggregate: Column, keys: Sequence[str]) -> Column:
    """An aggregate of the row's group beside the row.

    Every row of a group goes to one task, so use it on aggregated rows; for
    raw rows see ``terralake.operators.aggregates.beside``.
    """
    return aggregate.over(Window.partitionBy(*keys))


def deseason(c: str, season: Sequence[str]) -> Column:
    """Value minus the mean of its calendar month over the whole series."""
    return F.col(c) - over_keys(F.avg(c), season)


def group_total(c: str, keys: Sequence[str]) -> Column:
    return over_keys(F.sum(c), keys)
