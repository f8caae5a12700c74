"""Aggregate expressions: correlation, scores, conditional sums, picked values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from terralake.functions.scalar import col_of, ratio

__all__ = [
    "ace",
    "brier",
    "count_distinct_if",
    "gain_pct",
    "greatest_text",
    "indicator",
    "least_text",
    "mean_if",
    "ordered_concat",
    "quantile",
    "quantiles",
    "ratio_of_sums",
    "rmse",
    "safe_corr",
    "share_pct",
    "skill",
    "smoothed_rate",
    "sum_if",
    "value_at_max",
    "value_at_min",
]


def indicator(flag) -> Column:
    """1.0 when true, 0.0 when false or unknown."""
    return F.when(col_of(flag), F.lit(1.0)).otherwise(F.lit(0.0))


def safe_corr(x, y) -> Column:
    """Pearson r over rows where both are present; NULL for a constant column.

    Spark's own corr raises a division error on a constant column in ANSI mode.
    Constants are told by their range: merged partial variances may leave a tiny
    remainder above zero, and the quotient would then be noise.
    """
    x, y = col_of(x).cast("double"), col_of(y).cast("double")
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def sum_if(predicate, value=1) -> Column:
    """Sum over matching rows; NULL when none matches."""
    value = F.lit(value) if isinstance(value, (int, float)) else col_of(value)
    return F.sum(F.when(predicate, value))


def count_distinct_if(predicate, c) -> Column:
    return F.count_distinct(F.when(predicate, col_of(c)))


def mean_if(flag) -> Column:
    """Share of rows with the flag set, in [0, 1]."""
    return F.avg(indicator(flag))


def share_pct(flag) -> Column:
    return F.lit(100.0) * mean_if(flag)


def quantile(c, p: float) -> Column:
    """Exact interpolated quantile."""
    return F.percentile(col_of(c), F.lit(p))


def quantiles(c, ps: Sequence[float], weight=None) -> Column:
    """Several quantiles of one column in one buffer; returns an array."""
    args = [col_of(c), F.array(*(F.lit(p) for p in ps))]
    return F.percentile(*args, col_of(weight)) if weight is not None else F.percentile(*args)


def value_at_max(value, key, *ties) -> Column:
    """Value of the row with the largest key, among rows where the value is present.

    Further keys in ``ties`` decide between equal keys (largest wins).
    """
    value = col_of(value)
    rank = F.struct(*(col_of(c) for c in (key, *ties)))
    usable = value.isNotNull() & col_of(key).isNotNull()
    return F.max_by(F.when(usable, value), F.when(usable, rank))


def value_at_min(value, key, *ties) -> Column:
    value = col_of(value)
    rank = F.struct(*(col_of(c) for c in (key, *ties)))
    usable = value.isNotNull() & col_of(key).isNotNull()
    return F.min_by(F.when(usable, value), F.when(usable, rank))


def least_text(c) -> Column:
    """Smallest of a few distinct texts; unlike min it needs no sort of the rows."""
    return F.array_min(F.collect_set(col_of(c)))


def greatest_text(c) -> Column:
    return F.array_max(F.collect_set(col_of(c)))


def ordered_concat(c, order: Sequence[str], sep: str = " · ") -> Column:
    """Joined text in a fixed order. Meant for bounded lists such as a year's milestones."""
    entry = F.struct(*(col_of(o).alias(f"o{i}") for i, o in enumerate(order)), col_of(c).alias("text"))
    kept = F.when(col_of(c).isNotNull(), entry)
    texts = F.transform(F.array_sort(F.collect_list(kept)), lambda e: e["text"])
    return F.when(F.size(texts) > 0, F.array_join(texts, sep))


def ace(wind, synoptic, min_wind: float = 34.0) -> Column:
    """Accumulated cyclone energy: sum of v^2 / 10^4 on synoptic points at storm force."""
    wind = col_of(wind)
    return F.sum(F.when(col_of(synoptic) & (wind >= min_wind), wind * wind / F.lit(10000.0)))


def rmse(actual, predicted) -> Column:
    gap = col_of(actual) - col_of(predicted)
    return F.sqrt(F.avg(gap * gap))


def brier(probability, outcome) -> Column:
    gap = col_of(probability) - col_of(outcome)
    return F.avg(gap * gap)


def skill(model, baseline) -> Column:
    """1 is perfect, 0 equals the baseline, negative is worse than it."""
    return F.lit(1.0) - ratio(model, baseline)


def gain_pct(model, baseline) -> Column:
    return F.lit(100.0) * skill(model, baseline)


def smoothed_rate(flag) -> Column:
    """Laplace rate (k + 1) / (n + 2): never exactly 0 or 1."""
    return (F.sum(indicator(flag)) + 1) / (F.count(F.lit(1)) + F.lit(2.0))


def ratio_of_sums(num, den) -> Column:
    return ratio(F.sum(col_of(num)), F.sum(col_of(den)))
