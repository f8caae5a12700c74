"""Row filters, tags and orderings."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep rows where every listed measure is present."""
    return reduce(lambda d, c: d.filter(F.col(c).isNotNull()), cols, df)


def filter_valid(
    df: DataFrame,
    equals: Mapping[str, object] | None = None,
    not_equals_or_null: Mapping[str, object] | None = None,
    flags: Sequence[str] = (),
) -> DataFrame:
    """Validity rules: exact values, values that must not occur (NULL passes), flags."""
    rules: list[Column] = [F.col(c) == F.lit(v) for c, v in (equals or {}).items()]
    rules += [
        F.col(c).isNull() | (F.col(c) != F.lit(v)) for c, v in (not_equals_or_null or {}).items()
    ]
    rules += [F.col(c) for c in flags]
    return reduce(lambda d, rule: d.filter(rule), rules, df)


def where_opt(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """Apply the conditions that were asked for; None means no filter."""
    return reduce(lambda d, c: d.filter(c), (c for c in conditions if c is not None), df)


def opt(value: object | None, predicate) -> Column | None:
    """``predicate(value)`` when the argument was given."""
    return None if value is None else predicate(value)


def since(df: DataFrame, ts: str, days: int | None, as_of: str | None = None) -> DataFrame:
    """Rows of the last ``days`` days before ``as_of`` (default: now)."""
    if days is None:
        return df
    end = F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()
    return df.filter(F.col(ts) >= end - F.make_dt_interval(days=F.lit(days)))


def tag(df: DataFrame, **constants: object) -> DataFrame:
    """Constant columns, such as a scope or a model name."""
    return df.withColumns({name: F.lit(value) for name, value in constants.items()})


def having(df: DataFrame, count_col: str, min_n: int) -> DataFrame:
    """Drop groups that are too small to say anything."""
    return df.filter(F.col(count_col) >= min_n)


def sort_by(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Multi-key sort: ``-name`` is descending with NULLs last, ``name`` ascending.

    End the list with a unique key so that the order is total.
    """
    return df.orderBy(*order_columns(keys))


def order_columns(keys: Iterable[str]) -> list[Column]:
    return [
        F.col(k[1:]).desc_nulls_last() if k.startswith("-") else F.col(k).asc_nulls_last()
        for k in keys
    ]


def sort_first(df: DataFrame, predicate: Column, keys: Iterable[str]) -> DataFrame:
    """Rows that satisfy the predicate come first (a global row before its parts)."""
    return df.orderBy(predicate.desc(), *order_columns(keys))


def top_k(df: DataFrame, keys: Iterable[str], k: int) -> DataFrame:
    """First k rows; every task keeps only its own k (TakeOrderedAndProject)."""
    return sort_by(df, keys).limit(k)


def distinct_top_k(df: DataFrame, cols: Sequence[str], keys: Iterable[str], k: int) -> DataFrame:
    return top_k(df.select(*cols).distinct(), keys, k)
