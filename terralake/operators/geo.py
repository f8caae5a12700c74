"""Distance joins as equality joins on cells of a 3-D grid around the sphere.

Two points within d km are at most chord(d) apart along each axis, so with
cells of that edge they lie in the same cell or in one of its 26 neighbours.
This holds at the poles and across the antimeridian. One side is copied to the
27 cells around it, the other keeps its own cell, and the exact distance is
checked inside the join, so no candidate pair leaves it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralake.functions.scalar import EARTH_RADIUS_KM, chord_km, col_of, haversine_km
from terralake.operators.followers import follower_counter

_CELL = "_cell"
_SLOT = "_slot"
_SALT = "_salt"
_PART = "_centre_part"
_DAY_S = 86400
# Points of one cell that a task should get at most.
ROWS_PER_TASK = 1_000_000


class Grid:
    """Cell numbering for one search distance."""

    def __init__(self, km: float):
        # A little wider than the chord, so that rounding cannot lose a pair.
        self.edge = max(chord_km(km) * 1.0001, 0.05)
        self.side = math.ceil(2 * EARTH_RADIUS_KM / self.edge) + 4

    def cell(self, lat, lon) -> Column:
        lat, lon = F.radians(col_of(lat)), F.radians(col_of(lon))
        axes = (F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))
        x, y, z = (
            F.floor((axis + 1) * F.lit(EARTH_RADIUS_KM / self.edge)).cast("bigint") + 1
            for axis in axes
        )
        return (x * self.side + y) * self.side + z

    def copy_around(self, df: DataFrame, lat, lon, out: str) -> DataFrame:
        """Every row once per cell of its 3 x 3 x 3 neighbourhood.

        The own cell is computed below the explode, once per row; each copy only
        adds a fixed step to it.
        """
        steps = (-1, 0, 1)
        deltas = [
            (dx * self.side + dy) * self.side + dz for dx in steps for dy in steps for dz in steps
        ]
        own = df.withColumn("_own", self.cell(lat, lon))
        copies = own.withColumn("_step", F.explode(F.array(*(F.lit(d) for d in deltas))))
        return copies.withColumn(out, F.col("_own") + F.col("_step")).drop("_own", "_step")

    def copy_reached(self, df: DataFrame, lat, lon, km: float, out: str) -> DataFrame:
        """Every row once per cell that the cube of a shorter distance around it meets; at most eight cells of twice that edge."""
        around = chord_km(km) * 1.0001
        lat, lon = F.radians(col_of(lat)), F.radians(col_of(lon))
        axes = {"_x": F.cos(lat) * F.cos(lon), "_y": F.cos(lat) * F.sin(lon), "_z": F.sin(lat)}
        for name, axis in axes.items():
            first, last = (F.floor(((axis + 1) * F.lit(EARTH_RADIUS_KM) + F.lit(d)) / F.lit(self.edge)).cast("bigint") + 1 for d in (-around, around))
            df = df.withColumn(name, F.explode(F.sequence(first, last)))
        return df.withColumn(out, (F.col("_x") * self.side + F.col("_y")) * self.side + F.col("_z")).drop(*axes)


def salt_hot(
    points: DataFrame, centres: DataFrame, keys: Sequence[str], rows_per_task: int
) -> tuple[DataFrame, DataFrame]:
    """Spread the points of crowded cells over several tasks; copy centres to each.

    Only cells with more than ``rows_per_task`` points are listed, so the list
    has at most (all points / rows_per_task) rows; Spark broadcasts it if its size allows.
    Cells below the limit are not copied at all.
    """
    crowded = (
        points.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > rows_per_task)
        .select(*keys, F.ceil(F.col("_rows") / rows_per_task).cast("int").alias("_fan"))
    )
    fan = F.coalesce(F.col("_fan"), F.lit(1))
    spread = F.pmod(F.xxhash64(*points.columns), fan).cast("int")
    copies = F.explode(F.sequence(F.lit(0), fan - 1))
    salted = points.join(crowded, [*keys], "left").withColumn(_SALT, spread)
    copied = centres.join(crowded, [*keys], "left").withColumn(_SALT, copies)
    return salted.drop("_fan"), copied.drop("_fan")


def salt_both(
    points: DataFrame, centres: DataFrame, keys: Sequence[str], rows_per_task: int
) -> tuple[DataFrame, DataFrame]:
    """Rows whose keys occur on both sides; a crowded key's points and centres are each spread over parts, and every part of one meets every part of the other."""
    count = lambda df, n: df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows_per_task).cast("int").alias(n))
    met = count(points, "_points").join(count(centres, "_centres"), [*keys])
    spread = lambda df, fan: F.pmod(F.xxhash64(*df.columns), F.col(fan)).cast("int")
    copies = lambda fan: F.explode(F.sequence(F.lit(0), F.col(fan) - 1))
    near = points.join(met, [*keys]).withColumn(_SALT, spread(points, "_points")).withColumn(_PART, copies("_centres"))
    far = centres.join(met, [*keys]).withColumn(_PART, spread(centres, "_centres")).withColumn(_SALT, copies("_points"))
    return near.drop("_points", "_centres"), far.drop("_points", "_centres")


def geo_join(
    points: DataFrame,
    centres: DataFrame,
    km: float,
    point_at: tuple[str, str],
    centre_at: tuple[str, str],
    distance: str = "distance_km",
    rows_per_task: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """All (centre, point) pairs within ``km``, with the distance.

    Column names of the two sides must differ. Put the smaller side in
    ``centres``: it is the one copied to neighbouring cells. When it is small
    enough Spark broadcasts it and the points are not shuffled at all. Cells with more
    than ``rows_per_task`` points are split.
    """
    grid = Grid(km)
    near = points.withColumn(_CELL, grid.cell(*point_at))
    far = grid.copy_around(centres, *centre_at, _CELL)
    keys = [_CELL]
    if rows_per_task:
        near, far = salt_hot(near, far, keys, rows_per_task)
        keys = [_CELL, _SALT]
    gap = haversine_km(*centre_at, *point_at)
    left, right = far.alias("c"), near.alias("p")
    on = gap <= km
    for key in keys:
        on = on & (F.col(f"c.{key}") == F.col(f"p.{key}"))
    return left.join(right, on).drop(*keys).withColumn(distance, gap)


def _slot(time: Column, days: int) -> Column:
    return F.floor(F.unix_seconds(time) / F.lit(days * _DAY_S)).cast("bigint")


def _reach(centres: DataFrame, grid: Grid, days: int, at: tuple[str, str, str]) -> DataFrame:
    """Centres copied to every cell and time slot they can reach."""
    time, lat, lon = at
    slot = _slot(F.col(time), days)
    return grid.copy_around(centres.withColumn("_first", slot), lat, lon, _CELL).withColumn(
        _SLOT, F.explode(F.array(F.col("_first"), F.col("_first") + 1))
    ).drop("_first")


def _placed(points: DataFrame, grid: Grid, days: int, at: tuple[str, str, str]) -> DataFrame:
    time, lat, lon = at
    return points.withColumns({_CELL: grid.cell(lat, lon), _SLOT: _slot(F.col(time), days)})


def within_reach(
    points: DataFrame,
    centres: DataFrame,
    km: float,
    days: int,
    point_at: tuple[str, str, str],
    centre_at: tuple[str, str, str],
) -> DataFrame:
    """Points in a cell and slot that some centre can reach: a cheap semi join that
    thins a large table out before it is shuffled. A superset of the true partners."""
    grid = Grid(km)
    reached = _reach(centres.select(*centre_at), grid, days, centre_at).select(_CELL, _SLOT)
    near = _placed(points, grid, days, point_at)
    return near.join(reached.distinct(), [_CELL, _SLOT], "left_semi").drop(_CELL, _SLOT)


def space_time_join(
    points: DataFrame,
    centres: DataFrame,
    km: float,
    days: int,
    point_at: tuple[str, str, str],
    centre_at: tuple[str, str, str],
    condition: Column | None = None,
    rows_per_task: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Pairs with the point after the centre, within ``days`` and ``km``.

    ``*_at`` are (time, lat, lon). Time is cut into slots of ``days``: a centre
    in slot b can only reach slots b and b+1. Centres are copied 54 times, points
    stay single, so keep the rarer events as centres.
    """
    grid = Grid(km)
    (pt, plat, plon), (ct, clat, clon) = point_at, centre_at
    near = _placed(points, grid, days, point_at)
    far = _reach(centres, grid, days, centre_at)
    keys = [_CELL, _SLOT]
    if rows_per_task:
        near, far = salt_hot(near, far, keys, rows_per_task)
        keys.append(_SALT)
    window = F.make_dt_interval(days=F.lit(days))
    on = (F.col(pt) > F.col(ct)) & (F.col(pt) <= F.col(ct) + window)
    on = on & (haversine_km(clat, clon, plat, plon) <= km)
    if condition is not None:
        on = on & condition
    left, right = far.alias("c"), near.alias("p")
    for key in keys:
        on = on & (F.col(f"c.{key}") == F.col(f"p.{key}"))
    return left.join(right, on).drop(*keys)


def follow_counts(
    points: DataFrame,
    centres: DataFrame,
    km: float,
    days: int,
    point_at: tuple[str, str, str],
    centre_at: tuple[str, str, str],
    size: str,
    centre_size: str,
    centre_id: str,
    count: str = "n",
    largest: str = "largest",
    rows_per_task: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """(centre, day_after, count, largest): smaller points after each centre, by days of 24 clock hours from day 1.

    Points stay single in blocks of space and time, centres go to the blocks they can reach, and each block is
    counted on its own (see ``follower_counter``), so no pair of rows is made. Blocks with more than ``rows_per_task`` points or
    centres are split. Days without points have no row. The session's zone is UTC.
    """
    (pt, plat, plon), (ct, clat, clon) = point_at, centre_at
    place = lambda t, la, lo, s: [F.unix_micros(t).alias("_t"), F.col(la).alias("_la"), F.col(lo).alias("_lo"), F.col(s).cast("double").alias("_s")]
    slot = F.floor(F.col("_t") / F.lit(days * _DAY_S * 1_000_000)).cast("bigint")
    grid = Grid(2 * km)
    known = "_t IS NOT NULL AND _la IS NOT NULL AND _lo IS NOT NULL AND _s IS NOT NULL"
    near = points.select(*place(F.col(pt), plat, plon, size)).filter(known)
    near = near.withColumns({_CELL: grid.cell("_la", "_lo"), _SLOT: slot})
    mains = centres.select(F.col(centre_id).alias("_id"), *place(F.col(ct), clat, clon, centre_size)).filter(known)
    far = grid.copy_reached(mains, "_la", "_lo", km, _CELL).withColumn(_SLOT, F.explode(F.array(slot, slot + 1)))
    keys = [_CELL, _SLOT]
    near, far = salt_both(near, far, keys, rows_per_task or 1 << 40)
    keys += [_SALT, _PART]
    kinds = ", ".join(f"{n} {k}" for n, k in (("_id", mains.schema["_id"].dataType.simpleString()), ("day_after", "bigint"), ("_n", "bigint"), ("_s", "double")))
    by_block = far.groupBy(*keys).cogroup(near.groupBy(*keys)).applyInPandas(follower_counter(km, days), kinds)
    top = F.max("_s").cast(points.schema[size].dataType)
    return by_block.groupBy(F.col("_id").alias(centre_id), "day_after").agg(F.sum("_n").alias(count), top.alias(largest))


def decluster(
    events: DataFrame,
    km: float,
    days: int,
    time: str = "time",
    lat: str = "lat",
    lon: str = "lon",
    magnitude: str = "magnitude",
    rows_per_task: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Drop events that follow a larger one within ``days`` and ``km``.

    An anti join on (cell, time slot) of slots of ``days``: each event looks into its own cell and slot, and
    the possible parents (see ``skyline``) are copied to the cells and slots they can reach. Crowded cells
    are split: events stay single, so it does not matter which part holds one.
    """
    grid = Grid(km)
    own = _placed(events, grid, days, (time, lat, lon))
    keys = [_CELL, _SLOT]
    parents = grid.copy_around(skyline(events, days, time, lat, lon, magnitude), "_plat", "_plon", _CELL)
    if rows_per_task:
        own, parents = salt_hot(own, parents, keys, rows_per_task)
        keys.append(_SALT)
    window = F.make_dt_interval(days=F.lit(days))
    bigger_before = (
        (F.col("_pmag") > F.col(magnitude))
        & (F.col("_ptime") < F.col(time))
        & (F.col("_ptime") >= F.col(time) - window)
        & (haversine_km("_plat", "_plon", lat, lon) <= km)
    )
    for key in keys:
        bigger_before = bigger_before & (F.col(f"e.{key}") == F.col(f"p.{key}"))
    return own.alias("e").join(parents.alias("p"), bigger_before, "left_anti").drop(*keys)


def skyline(
    events: DataFrame,
    days: int,
    time: str = "time",
    lat: str = "lat",
    lon: str = "lon",
    magnitude: str = "magnitude",
) -> DataFrame:
    """(_plat, _plon, _pmag, _ptime, _slot): what the events of each spot and slot leave to look at, in their own slot and in the next.

    In its own slot an event beats another of its spot that is later and not larger; to the next slot, all of which is later,
    one that is earlier and not larger. Whatever follows the beaten one within the window follows the other too. Of equal magnitudes the earliest
    or the latest is taken before the shuffle, so a spot sends at most as many rows as it has magnitudes.
    """
    slot = _slot(F.col(time), days)
    spot = ["_plat", "_plon", "_from"]
    ends = events.groupBy(F.col(lat).alias("_plat"), F.col(lon).alias("_plon"), slot.alias("_from"), F.col(magnitude).alias("_pmag")).agg(
        F.min(time).alias("_first"), F.max(time).alias("_last")
    )
    larger = Window.partitionBy(*spot).orderBy(F.desc("_pmag")).rowsBetween(Window.unboundedPreceding, -1)
    beaten = ends.select("*", F.min("_first").over(larger).alias("_earlier"), F.max("_last").over(larger).alias("_later"))
    own = F.when(F.col("_earlier").isNull() | (F.col("_first") < F.col("_earlier")), F.struct(F.col("_first").alias("t"), F.col("_from").alias("s")))
    after = F.when(F.col("_later").isNull() | (F.col("_last") > F.col("_later")), F.struct(F.col("_last").alias("t"), (F.col("_from") + 1).alias("s")))
    left = beaten.select("_plat", "_plon", "_pmag", F.explode(F.array_compact(F.array(own, after))).alias("_p"))
    return left.select("_plat", "_plon", "_pmag", F.col("_p.t").alias("_ptime"), F.col("_p.s").alias(_SLOT))
