"""Totals and values carried along one order of all rows, without a task that holds them all.

Rows are dealt out by ranges of the order and written, so that a row's range and its place in it are
fixed. Each range is worked on by itself; what the ranges before it come to is one row a range.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralake.operators.rows import order_columns
from terralake.session import ensure_checkpoint_dir

#: Bits of a row's place that number it within its range.
PLACE_BITS = 33


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again, so that they are made once and lineage ends at files."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Ranges:
    """Rows in ranges of an order: `rows` has the columns given and PART and AT.

    PART is the number of the range, AT grows along the order. Methods return Ranges with one
    more column. Rows that the order leaves equal stand in any order, but always the same.
    """

    PART, AT = "_part", "_at"

    def __init__(self, rows: DataFrame):
        self.rows = rows

    @classmethod
    def of(cls, df: DataFrame, order: Sequence[str | Column], parts: int | None = None) -> Ranges:
        """`order` has column names, "-" before those that descend, or sort expressions; `parts` is left to Spark if not given."""
        by = [c for o in order for c in (order_columns([o]) if isinstance(o, str) else [o])]
        dealt = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
        placed = dealt.sortWithinPartitions(*by).withColumn(cls.AT, F.monotonically_increasing_id())
        read = written(placed, "ranges")
        return cls(read.withColumn(cls.PART, F.shiftright(cls.AT, PLACE_BITS).cast("int")))

    def done(self) -> DataFrame:
        return self.rows.drop(self.PART, self.AT)

    def _window(self):
        return Window.partitionBy(self.PART).orderBy(self.AT)

    def _with_carried(self, name: str, totals: Column, step, backwards: bool = False) -> DataFrame:
        """The rows with what the ranges before (or after) their own come to; `step` folds one range's total into it."""
        spark, kind = self.rows.sparkSession, self.rows.select(totals.alias("t")).schema["t"].dataType
        ends = sorted(self.rows.groupBy(self.PART).agg(totals.alias("t")).collect(), reverse=backwards)
        before = [None, *accumulate((e.t for e in ends), step)][: len(ends)]
        table = spark.createDataFrame([(e[0], b) for e, b in zip(ends, before)], f"{self.PART} int, `{name}` {kind.simpleString()}")
        return self.rows.join(table, self.PART, "left")

    def running(self, name: str, value: Column) -> Ranges:
        """Sum of a value over this row and all before it; NULL values count for nothing."""
        rows = self._with_carried("_carried", F.sum(value), lambda a, b: b if a is None else a if b is None else a + b)
        own = F.sum(value).over(self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow))
        total = F.when(own.isNull(), F.col("_carried")).otherwise(own + F.coalesce(F.col("_carried"), F.lit(0)))
        return Ranges(rows.withColumn(name, total).drop("_carried"))

    def numbered(self, name: str) -> Ranges:
        """Number of each row, from 1."""
        return self.running(name, F.lit(1).cast("long"))

    def lagged(self, name: str, value: str) -> Ranges:
        """The value of the row before, NULL included; NULL on the first row of all."""
        rows = self._with_carried("_carried", F.max_by(F.struct(F.col(value).alias("v")), F.col(self.AT)), lambda a, b: b)
        first = F.row_number().over(self._window()) == 1
        return Ranges(rows.withColumn(name, F.when(first, F.col("_carried.v")).otherwise(F.lag(value).over(self._window()))).drop("_carried"))

    def filled(self, name: str, value: str, ahead: bool = False) -> Ranges:
        """The nearest value that is not NULL at or before the row, or at or after it."""
        known, at = F.col(value).isNotNull(), F.when(F.col(value).isNotNull(), F.col(self.AT))
        pick = F.min_by if ahead else F.max_by
        rows = self._with_carried("_carried", pick(F.when(known, F.col(value)), at), lambda a, b: a if b is None else b, backwards=ahead)
        frame = (Window.currentRow, Window.unboundedFollowing) if ahead else (Window.unboundedPreceding, Window.currentRow)
        end = F.first if ahead else F.last
        own = end(value, ignorenulls=True).over(self._window().rowsBetween(*frame))
        return Ranges(rows.withColumn(name, F.coalesce(own, F.col("_carried"))).drop("_carried"))

    def before(self, keys: Sequence[str], totals: Sequence[Column]) -> DataFrame:
        """(PART, keys, totals, total_before for each): totals of each range's rows of a key, and of its rows in the ranges before.

        Put the keys first in the order: then there are no more rows than keys and ranges. Keys must not be NULL.
        """
        each = self.rows.groupBy(self.PART, *keys).agg(*totals)
        names = [c for c in each.columns if c not in (self.PART, *keys)]
        window = Window.partitionBy(*keys).orderBy(self.PART).rowsBetween(Window.unboundedPreceding, -1)
        return each.select("*", *(F.coalesce(F.sum(n).over(window), F.lit(0)).alias(f"{n}_before") for n in names))
