"""Grouped results that plain groupBy does not give directly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralake.operators.scan import Ranges, written


def with_total(
    df: DataFrame, key: str, aggs: Sequence[Column], total: str, name: str | None = None
) -> DataFrame:
    """Per-key rows plus one pooled row labelled ``total``, in a single pass.

    The pooled row is recognised by its grouping bit, so a NULL key stays NULL.
    """
    grouped = df.groupingSets([[F.col(key)], []], F.col(key)).agg(
        F.grouping(key).alias("_pooled"), *aggs
    )
    scope = F.when(F.col("_pooled") == 1, F.lit(total)).otherwise(F.col(key).cast("string"))
    rest = [c for c in grouped.columns if c not in (key, "_pooled")]
    return grouped.select(scope.alias(name or key), *rest)


def quantiles_by(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ps: Mapping[str, float],
    extra: Sequence[Column] = (),
    parts: int | None = None,
) -> DataFrame:
    """Exact interpolated quantiles of one measure per key, safe for hot keys. Keys must not be NULL.

    The measure is read once: its rows are counted per (key, value) with map-side combine, and the counts are dealt out by ranges
    of key and value and written. What a key has in the ranges before gives the ranks of a range's values, so no task holds a
    key. Aggregates in ``extra`` may refer to the measure and its weight as ``_value`` and ``_n``.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    ranges = Ranges.of(counted, [*keys, "_value"], parts)
    part, at = Ranges.PART, Ranges.AT
    spans = written(ranges.before(keys, [F.sum("_n").alias("_own")]), "quantile-ranges")
    totals = ranges.rows.groupBy(*keys).agg(F.sum("_n").alias("_total"), *extra)
    upto = F.col("_own_before") + F.sum("_n").over(Window.partitionBy(part, *keys).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sizes = spans.groupBy(*keys).agg(F.sum("_own").alias("_all"))
    ranked = ranges.rows.join(spans.drop("_own"), [part, *keys]).join(sizes, [*keys]).withColumn("_upto", upto)
    holds = lambda rank: (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_n"))
    place = lambda p, total: F.lit(p) * (F.col(total) - 1).cast("double")
    ends = [(f"_{end}{i}", rounded(place(p, "_all"))) for i, p in enumerate(ps.values()) for end, rounded in (("a", F.floor), ("b", F.ceil))]
    found = ranked.groupBy(*keys).agg(*(F.max(F.when(holds(rank), F.col("_value"))).alias(name) for name, rank in ends))
    out = totals.join(found, [*keys])
    made = {}
    for i, (name, p) in enumerate(ps.items()):
        a, b, at_ = F.col(f"_a{i}"), F.col(f"_b{i}"), place(p, "_total")
        made[name] = F.when(a == b, a).otherwise((F.ceil(at_) - at_) * a + (at_ - F.floor(at_)) * b)
    names = [c for c in totals.columns if c not in keys and c != "_total"]
    return out.select(*keys, *names, *(c.cast("double").alias(name) for name, c in made.items()))


def beside(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Group aggregates beside every row, safe for hot keys.

    The aggregate shrinks to one row per key before the join, so no task has to
    hold a whole group as a window would. Keys must not be NULL.
    """
    return df.join(df.groupBy(*keys).agg(*aggs), [*keys], "left")
