"""Unions, unpivots, array rows and small row generators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def union_named(dfs: Sequence[DataFrame]) -> DataFrame:
    """Union all by column name; a column missing from one side is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    """Union all of frames with the same columns."""
    return reduce(lambda a, b: a.unionByName(b), dfs)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def unpivot(
    df: DataFrame,
    ids: Sequence[str],
    cols: Sequence[str],
    name: str = "column_name",
    value: str = "value",
) -> DataFrame:
    """Wide to long over numeric measures, as double, without the NULL cells."""
    typed = df.select(*ids, *(F.col(c).cast("double").alias(c) for c in cols))
    return typed.unpivot([*ids], [*cols], name, value).filter(F.col(value).isNotNull())


def months_to_rows(
    df: DataFrame, cols: Sequence[str], month: str = "month", value: str = "cnt"
) -> DataFrame:
    """Month columns to rows; the month is the position, counted from 1."""
    kept = [c for c in df.columns if c not in cols]
    rows = df.select(*kept, F.posexplode(F.array(*cols)).alias("_pos", value))
    return rows.withColumn(month, F.col("_pos") + 1).drop("_pos")


def spine(spark: SparkSession, first: int, last: int, name: str = "year") -> DataFrame:
    """One row per integer in [first, last]."""
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias(name))


def month_spine(spark: SparkSession, first: int, last: int) -> DataFrame:
    """One row per calendar month, without a join."""
    months = spine(spark, first * 12, last * 12 + 11, "_m").select(
        F.expr("_m div 12").cast("int").alias("year"),
        (F.col("_m") % 12 + 1).cast("int").alias("month"),
    )
    return months.withColumn("month_start", F.make_date("year", "month", F.lit(1)))


def doy_calendar(spark: SparkSession, period: int = 366) -> DataFrame:
    return spine(spark, 1, period, "doy")


def cross_values(df: DataFrame, name: str, values: Sequence[object]) -> DataFrame:
    """Every row once per value of a short literal list (an explode, not a join)."""
    return df.withColumn(name, F.explode(F.array(*(F.lit(v) for v in values))))
