"""Joins of the models, written so that none needs a nested loop.

Sides are never force-broadcast. Spark broadcasts a side by itself when its
measured size is under the session threshold and sorts or splits it otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralake.functions.scalar import DOY_PERIOD
from terralake.operators.dedup import prefer_by
from terralake.operators.rows import order_columns
from terralake.operators.scan import Ranges


def join_dim(df: DataFrame, dim: DataFrame, key: str, dim_key: str) -> DataFrame:
    """Inner join to a dimension; the dimension's own key is dropped."""
    renamed = dim.withColumnRenamed(dim_key, key)
    return df.join(renamed, key, "inner")


def left_zero(df: DataFrame, counts: DataFrame, keys: Sequence[str], c: str) -> DataFrame:
    """Keep every row; a missing count is 0."""
    joined = df.join(counts, [*keys], "left")
    return joined.withColumn(c, F.coalesce(F.col(c), F.lit(0)))


def left_preferred(
    df: DataFrame,
    other: DataFrame,
    keys: Sequence[str],
    kind: str,
    preferred: Sequence[object],
) -> DataFrame:
    """Left join to one row per key, the preferred kind; a missing match stays NULL."""
    return df.join(prefer_by(other, keys, kind, preferred, [kind]), [*keys], "left")


def panel(base: DataFrame, sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Left-join a list of per-key tables on a spine."""
    return reduce(lambda left, right: left.join(right, [*keys], "left"), sources, base)


def circular_neighbours(doy: str | Column, k: int, period: int = DOY_PERIOD) -> Column:
    """The 2k+1 calendar days within k of a day, 31 December next to 1 January."""
    day = F.col(doy) if isinstance(doy, str) else doy
    offsets = F.sequence(F.lit(-k), F.lit(k))
    return F.transform(offsets, lambda o: (F.pmod(day - 1 + o, F.lit(period)) + 1).cast("int"))


def circular_window(
    df: DataFrame, doy: str, k: int = 7, out: str = "doy", period: int = DOY_PERIOD
) -> DataFrame:
    """Every row once per calendar day it counts for: an explode, then equi keys."""
    days = circular_neighbours(doy, k, period)
    if out == doy:
        return df.withColumn(out, F.explode(days))
    return df.select("*", F.explode(days).alias(out))


def stab(
    spans: DataFrame, start: str, end: str | Column, first: int, last: int, out: str = "year"
) -> DataFrame:
    """One row per (span, year inside the span), clipped to [first, last]."""
    end = F.col(end) if isinstance(end, str) else end
    lo = F.greatest(F.col(start), F.lit(first)).cast("int")
    hi = F.least(end, F.lit(last)).cast("int")
    years = F.when(lo <= hi, F.sequence(lo, hi))
    return spans.withColumn(out, F.explode(years))


def walk_forward(
    df: DataFrame, year: str, cuts: Sequence[int], first_year: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Training rows (year <= cut) and test rows (year > cut) per cut.

    Rows are copied to the cuts they belong to and then matched on ``cut_year``
    by equality. Aggregate per year first where the statistic allows it.
    """
    all_cuts = F.array(*(F.lit(c) for c in cuts))
    train = df if first_year is None else df.filter(F.col(year) >= first_year)
    train = train.withColumn("cut_year", F.explode(F.filter(all_cuts, lambda c: F.col(year) <= c)))
    test = df.withColumn("cut_year", F.explode(F.filter(all_cuts, lambda c: F.col(year) > c)))
    return train, test


def bracket(base: DataFrame, anchors: DataFrame, on: str, cols: Sequence[str], parts: int | None = None) -> DataFrame:
    """Nearest anchor at or before (``lo_*``) and at or after (``hi_*``) each key.

    One pass over the ordered spine instead of an inequality join. The spine is dealt out by ranges,
    and the anchors nearest to a range are carried into it.
    """
    marked = anchors.select(F.col(on), F.struct(F.col(on), *map(F.col, cols)).alias("_a"))
    joined = base.join(marked, on, "left")
    kept = [c for c in joined.columns if c != "_a"]
    found = Ranges.of(joined, [on], parts).filled("_lo", "_a").filled("_hi", "_a", ahead=True).done()
    picks = [
        F.col(f"{side}.{c}").alias(f"{side[1:]}_{c}") for side in ("_lo", "_hi") for c in (on, *cols)
    ]
    return found.filter(F.col("_lo").isNotNull() & F.col("_hi").isNotNull()).select(*kept, *picks)


def link(a: DataFrame, b: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """Inner join along a causal id; the linked side's id column is dropped."""
    return a.join(b.withColumnRenamed(b_id, a_id), a_id, "inner")


def in_set(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows with a match; the keys are made distinct first."""
    return df.join(keys.select(*on).distinct(), [*on], "left_semi")


def not_in_set(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows without a match. A NULL key never matches, so such rows stay."""
    return df.join(keys.select(*on).distinct(), [*on], "left_anti")


def exists_flag(
    a: DataFrame,
    b: DataFrame,
    equal: Sequence[str],
    name: str,
    condition: Callable[[str, str], Column] | None = None,
    id_cols: Sequence[str] = (),
) -> DataFrame:
    """Flag the rows of ``a`` that have a partner in ``b``.

    ``equal`` are the columns that must agree; ``condition`` gets the prefixes of
    both sides and may compare further columns. The semi join stops at the first
    partner, and only ``id_cols`` of the matches travel back to ``a``.
    """
    ids = [*(id_cols or equal)]
    left = a.select(*(F.col(c).alias(f"a_{c}") for c in a.columns))
    right = b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns))
    on = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in equal]
    if condition is not None:
        on.append(condition("a_", "b_"))
    hits = left.join(right, reduce(lambda x, y: x & y, on), "left_semi")
    hits = hits.select(*(F.col(f"a_{c}").alias(c) for c in ids)).distinct()
    flagged = a.join(hits.withColumn(name, F.lit(True)), ids, "left")
    return flagged.withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def with_scalar(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """A one-row aggregate as a constant column (a scalar subquery, run once)."""
    return df.withColumn(name, one_row.scalar())


def acf(
    df: DataFrame,
    order: Sequence[str],
    value: str,
    lags: Sequence[int],
    corr: Callable[[str, str], Column],
    keys: Sequence[str] = (),
    parts: int | None = None,
) -> DataFrame:
    """Autocorrelation at several lags of a series, per key.

    The series is numbered once, by ranges of the order where there are no keys, copied per lag with a
    shifted index, and joined to itself by equality.
    """
    known = df.filter(F.col(value).isNotNull()).select(*keys, *order, value)
    if keys:
        window = Window.partitionBy(*keys).orderBy(*order_columns(order))
        numbered = known.withColumn("_t", F.row_number().over(window).cast("long"))
    else:
        numbered = Ranges.of(known, order, parts).numbered("_t").done()
    numbered = numbered.select(*keys, "_t", F.col(value).alias("_x"))
    shifted = numbered.withColumn("lag", F.explode(F.array(*(F.lit(k) for k in lags)))).select(
        *keys, "lag", (F.col("_t") + F.col("lag")).alias("_t"), F.col("_x").alias("_earlier")
    )
    pairs = shifted.join(numbered, [*keys, "_t"])
    return pairs.groupBy(*keys, "lag").agg(
        F.count(F.lit(1)).alias("n_pairs"), corr("_earlier", "_x").alias("acf")
    )
