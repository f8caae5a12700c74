"""One row per key: the newest revision, or the preferred kind."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralake.operators.rows import order_columns

_RANK = "_rank"


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key.

    ``row_number() = 1`` lets Spark cut every key to one row per task before the
    shuffle (partial WindowGroupLimit), so a key that holds a third of all rows
    still arrives at its reducer as at most one row per map task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_RANK, F.row_number().over(window)).filter(F.col(_RANK) == 1).drop(_RANK)


def value_by(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[Column], name: str) -> DataFrame:
    """(keys, value of the first row in the order that has one), one row per key with such a row."""
    usable = df.filter(F.col(value).isNotNull())
    return first_by(usable.select(*keys, value, *(c.alias(f"_o{i}") for i, c in enumerate(order))), keys, [F.col(f"_o{i}").asc() for i in range(len(order))]).select(
        *keys, F.col(value).alias(name)
    )


def latest_by(
    df: DataFrame,
    keys: Sequence[str],
    order: Iterable[str],
    drop: Sequence[str] = (),
) -> DataFrame:
    """Newest row per key; ``order`` names columns, newest (largest) first, NULLs last.

    Remaining columns break ties, so the result does not depend on file order.
    """
    order = [*order]
    rest = [c for c in df.columns if c not in (*keys, *order)]
    columns = [F.col(c).desc_nulls_last() for c in (*order, *rest)]
    return first_by(df, keys, columns).drop(*drop)


def prefer_by(
    df: DataFrame,
    keys: Sequence[str],
    kind: str,
    preferred: Sequence[object],
    ties: Iterable[str] = (),
) -> DataFrame:
    """Row of the most preferred kind per key; kinds not listed come last."""
    rank = F.lit(len(preferred))
    for position, value in reversed(list(enumerate(preferred))):
        rank = F.when(F.col(kind) == F.lit(value), F.lit(position)).otherwise(rank)
    return first_by(df, keys, [rank.asc(), *order_columns(ties)])
