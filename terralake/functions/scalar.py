"""Scalar column functions: geodesy, calendar, guarded arithmetic, labels."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "EARTH_RADIUS_KM",
    "DOY_PERIOD",
    "century",
    "clamp",
    "classify",
    "col_of",
    "doy_distance",
    "first_present",
    "haversine_km",
    "hours_crossed",
    "int_div",
    "label",
    "local_date",
    "local_ts",
    "ratio",
    "round_if",
    "round_to_long",
    "safe_date",
]

# Mean Earth radius (km) and the length of the circular calendar.
EARTH_RADIUS_KM = 6371.0088
DOY_PERIOD = 366


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance. The root is clamped because asin(1 + 1e-16) is NaN."""
    lat1, lon1, lat2, lon2 = map(col_of, (lat1, lon1, lat2, lon2))
    north = F.sin(F.radians(lat2 - lat1) / 2)
    east = F.sin(F.radians(lon2 - lon1) / 2)
    h = north * north + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * east * east
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def chord_km(distance_km: float) -> float:
    """Straight-line length under a great-circle distance."""
    half_turn = math.pi * EARTH_RADIUS_KM
    return 2 * EARTH_RADIUS_KM * math.sin(min(distance_km, half_turn) / (2 * EARTH_RADIUS_KM))


def space_time_cell(lat, lon, time, bits: int = 10) -> Column:
    """Number of a cell of space and time along a curve on which near cells mostly have near numbers.

    Each of the three is cut into 2^bits parts: latitude and longitude over their ranges, the time
    over 1900 to 2100, values beyond it at its ends. The bits of the three parts take turns, the
    highest first. NULL counts as the first part.
    """
    lat, lon, time = map(col_of, (lat, lon, time))
    whole = 1 << bits
    shares = (lat + 90) / 180, (lon + 180) / 360, (F.unix_seconds(time.cast("timestamp")) + 2_208_988_800) / 6_311_433_600
    parts = [F.greatest(F.lit(0), F.least(F.lit(whole - 1), F.floor(F.coalesce(s, F.lit(0.0)) * whole).cast("bigint"))) for s in shares]
    cell = F.lit(0).cast("bigint")
    for bit in range(bits):
        for turn, part in enumerate(parts):
            cell = cell.bitwiseOR(F.shiftleft(F.shiftright(part, bit).bitwiseAND(F.lit(1)), 3 * bit + 2 - turn))
    return cell


def doy_distance(a, b, period: int = DOY_PERIOD) -> Column:
    """Days apart on a circular calendar: 31 December is next to 1 January."""
    gap = F.abs(col_of(a) - col_of(b))
    return F.least(gap, F.lit(period) - gap)


def local_ts(instant, zone) -> Column:
    """Wall-clock time at an IANA zone given per row."""
    return F.from_utc_timestamp(col_of(instant), col_of(zone))


def local_date(instant, zone) -> Column:
    return F.to_date(local_ts(instant, zone))


def int_div(a, b: int) -> Column:
    """Integer division that truncates toward zero."""
    a = col_of(a).cast("bigint")
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def century(year) -> Column:
    """1976 is in 20, 1 in 1, -430 in -5: there is no year 0 and no century 0."""
    year = col_of(year)
    return F.when(year > 0, int_div(year - 1, 100) + 1).otherwise(-(int_div(-year - 1, 100) + 1))


def safe_date(year, month, day) -> Column:
    """A date, or NULL when the parts are missing or impossible (30 February)."""
    zero = F.lit(0)
    parts = [col_of(c).cast("int") for c in (year, month, day)]
    return F.to_date(F.try_make_timestamp(*parts, zero, zero, zero))


def hours_crossed(start, end) -> Column:
    """Clock-hour boundaries between two instants (00:59 to 02:01 is 2)."""
    first, last = (F.unix_seconds(F.date_trunc("hour", col_of(c))) for c in (start, end))
    return int_div(last - first, 3600)


def ratio(num, den) -> Column:
    """Division as double; NULL, not an error, when the denominator is 0."""
    return F.try_divide(col_of(num).cast("double"), col_of(den).cast("double"))


def clamp(c, low: float = 0.0, high: float = 1.0) -> Column:
    """Into [low, high]. A NULL becomes ``low``: greatest skips it."""
    return F.least(F.lit(high), F.greatest(F.lit(low), col_of(c)))


def classify(rules: Sequence[tuple[Column, str]], default: str | None = None) -> Column:
    """First matching label of an ordered ladder of (predicate, label)."""
    (first_pred, first_label), *rest = rules
    out = F.when(first_pred, F.lit(first_label))
    for predicate, name in rest:
        out = out.when(predicate, F.lit(name))
    return out.otherwise(F.lit(default))


def first_present(*cols) -> Column:
    return F.coalesce(*map(col_of, cols))


def round_if(c, digits: int, rounding: bool = True) -> Column:
    """Presentation rounding; models can be run without it for exact comparison."""
    c = col_of(c)
    return F.round(c, digits) if rounding else c


def round_to_long(c) -> Column:
    """Round before the cast: a bare cast to bigint would truncate."""
    return F.round(col_of(c)).cast("bigint")


def label(*parts) -> Column:
    """Text built from columns and literal strings wrapped in F.lit."""
    return F.concat(*(col_of(p).cast("string") for p in parts))
