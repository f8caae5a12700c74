import random

import pytest
from helpers import executed_plan, rows
from pyspark.sql import functions as F

from terralake import functions as fn
from terralake.functions.scalar import EARTH_RADIUS_KM
from terralake.operators import aggregates, dedup, geo, joins, reshape, windows
from terralake.operators import rows as row_ops
from terralake.operators.followers import follower_counter

NO_PAIRS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def test_latest_by_cuts_hot_keys_before_the_shuffle(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("t"), (F.col("id") % 7).alias("v")
    )
    latest = dedup.latest_by(df, ["k"], ["t"])
    assert latest.filter("k = 0").first().t == 2997
    assert latest.count() == 2001
    plan = executed_plan(latest)
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_latest_by_puts_nulls_last_and_breaks_ties_by_content(spark):
    data = [("a", None, 9), ("a", 1, 2), ("b", 1, 5), ("b", 1, 7)]
    for order in (data, data[::-1]):
        df = spark.createDataFrame(order, "k string, t int, v int")
        assert sorted(rows(dedup.latest_by(df, ["k"], ["t"]))) == [("a", 1, 2), ("b", 1, 7)]


def test_prefer_by(spark):
    df = spark.createDataFrame([("x", "forecast", 1), ("x", "observed", 2), ("y", "forecast", 3)], "k string, kind string, v int")
    assert sorted(rows(dedup.prefer_by(df, ["k"], "kind", ["observed"]))) == [("x", "observed", 2), ("y", "forecast", 3)]


def test_circular_window_gives_the_pairs_of_the_distance_rule(spark):
    days = reshape.doy_calendar(spark)
    got = set(rows(joins.circular_window(days, "doy", 7, out="near")))
    want = {(a, b) for a in range(1, 367) for b in range(1, 367) if min(abs(a - b), 366 - abs(a - b)) <= 7}
    assert got == want


def _points(spark, n, seed, prefix):
    rng = random.Random(seed)
    data = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(n)]
    data += [(n + i, lat, lon) for i, (lat, lon) in enumerate([(90.0, 0.0), (-90.0, 10.0), (0.0, 180.0), (0.0, -180.0), (89.9, 179.9)])]
    return spark.createDataFrame(data, f"{prefix}id int, {prefix}lat double, {prefix}lon double")


@pytest.mark.parametrize("km", [150, 500, 700, 6000])
@pytest.mark.parametrize("rows_per_task", [None, 3])
def test_geo_join_equals_brute_force(spark, km, rows_per_task):
    p, c = _points(spark, 400, 1, "p"), _points(spark, 150, 2, "c")
    joined = geo.geo_join(p, c, km, ("plat", "plon"), ("clat", "clon"), rows_per_task=rows_per_task)
    brute = p.crossJoin(c).filter(fn.haversine_km("clat", "clon", "plat", "plon") <= km)
    assert sorted(rows(joined.select("cid", "pid"))) == sorted(rows(brute.select("cid", "pid")))
    assert not any(name in executed_plan(joined) for name in NO_PAIRS)


def _quakes(spark, n=700, seed=5):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        hot = i % 3 == 0  # a third of all events at one place
        lat, lon = (10.0, 20.0) if hot else (rng.uniform(8, 12), rng.uniform(18, 22))
        data.append((f"e{i}", rng.randrange(0, 200 * 86400), lat, lon, round(rng.uniform(4, 8), 1)))
    df = spark.createDataFrame(data, "event_id string, s bigint, lat double, lon double, magnitude double")
    return df.withColumn("time", F.timestamp_seconds("s")).drop("s")


@pytest.mark.parametrize("rows_per_task", [None, 10])
def test_space_time_join_equals_brute_force(spark, rows_per_task):
    q = _quakes(spark)
    mains = q.filter("magnitude >= 6.5").select(
        F.col("event_id").alias("m"), F.col("time").alias("mt"), F.col("lat").alias("mlat"), F.col("lon").alias("mlon"), F.col("magnitude").alias("mm")
    )
    rule = F.col("magnitude") < F.col("mm")
    got = geo.space_time_join(q, mains, 150, 30, ("time", "lat", "lon"), ("mt", "mlat", "mlon"), rule, rows_per_task)
    brute = q.crossJoin(mains).filter(
        rule & (F.col("time") > F.col("mt")) & (F.col("time") <= F.col("mt") + F.expr("INTERVAL 30 DAYS"))
        & (fn.haversine_km("mlat", "mlon", "lat", "lon") <= 150)
    )
    assert sorted(rows(got.select("m", "event_id"))) == sorted(rows(brute.select("m", "event_id")))
    assert not any(name in executed_plan(got) for name in NO_PAIRS)


@pytest.mark.parametrize("limit", [None, 400])
@pytest.mark.parametrize("least", [4.0, 6.8])
def test_follow_counts_makes_no_pairs_of_events(spark, limit, least):
    """Enough points for tiles inside and across the circles; events of one instant, of equal size, and with nulls."""
    rng = random.Random(11)
    data = [
        (f"e{i}", rng.randrange(0, 70 * 24) * 3_600 + rng.choice((0, 0, 1_800, 3_599)), rng.uniform(-1, 1) + 60, (rng.uniform(179, 182) + 180) % 360 - 180, round(rng.expovariate(1.5) + 4, 1))
        for i in range(2_500)
    ]
    data += [(f"n{i}", *(None if i == j else v for j, v in enumerate((100, 60.0, 180.0, 7.0)))) for i in range(4)]
    q = spark.createDataFrame(data, "event_id string, s long, lat double, lon double, magnitude double").withColumn("time", F.timestamp_seconds("s")).drop("s")
    mains = q.filter(F.col("magnitude").isNull() | (F.col("magnitude") >= least) & (F.xxhash64("event_id") % 4 == 0)).select(
        F.col("event_id").alias("m"), F.col("time").alias("mt"), F.col("lat").alias("mlat"), F.col("lon").alias("mlon"), F.col("magnitude").alias("mm")
    )
    mains = mains.unionByName(mains.limit(3))
    got = geo.follow_counts(q, mains, 60, 20, ("time", "lat", "lon"), ("mt", "mlat", "mlon"), "magnitude", "mm", "m", rows_per_task=limit)
    hours = F.unix_seconds(F.date_trunc("hour", "time")) - F.unix_seconds(F.date_trunc("hour", "mt"))
    brute = q.crossJoin(mains).filter(
        (F.col("magnitude") < F.col("mm")) & (F.col("time") > F.col("mt")) & (F.col("time") <= F.col("mt") + F.expr("INTERVAL 20 DAYS"))
        & (fn.haversine_km("mlat", "mlon", "lat", "lon") <= 60)
    ).groupBy("m", (F.floor(hours / 86_400) + 1).alias("day_after")).agg(F.count(F.lit(1)).alias("n"), F.max("magnitude").alias("largest"))
    assert sorted(rows(got)) == sorted(rows(brute)) and brute.count() > 50
    assert "ASIN" not in executed_plan(got)  # no join looks at the distance of two events


def test_followers_of_a_crowd_cut_by_the_circles_are_not_looked_at_one_by_one(monkeypatch):
    """Half the crowd lies in each circle: its points are dealt out finely however close they lie."""
    import numpy as np
    import pandas as pd

    rng, hour = np.random.default_rng(5), 3_600_000_000
    n, m = 20_000, 300
    points = pd.DataFrame(
        {"_t": rng.integers(0, 720 * hour, n), "_la": rng.uniform(0, 0.02, n), "_lo": rng.uniform(1.0, 1.02, n), "_s": rng.integers(45, 60, n) / 10, "_slot": 0}
    )
    points.loc[n] = [10 * hour, 2.5, 2.5, 4.5, 0]  # far from the crowd
    points = points.astype({"_t": "int64", "_slot": "int64"})
    # 1.01 degrees are 112.306 km: the circles run through the middle of the crowd.
    centres = pd.DataFrame({"_id": [f"m{i}" for i in range(m)], "_t": rng.integers(-720 * hour, 720 * hour, m), "_la": 0.01, "_lo": rng.uniform(-0.005, 0.005, m), "_s": 7.0, "_slot": 0})
    repeat, made = np.repeat, []
    monkeypatch.setattr(np, "repeat", lambda *a, **k: made.append(repeat(*a, **k)) or made[-1])
    got = follower_counter(112.306, 30)(centres, points)
    monkeypatch.undo()
    looked = sum(len(x) for x in made)
    want, seen = {}, 0
    for c in centres.to_dict("records"):
        p = points[(points._t > c["_t"]) & (points._t <= c["_t"] + 720 * hour)]
        la, lo = np.radians(p._la - c["_la"]), np.radians(p._lo - c["_lo"])
        h = np.sin(la / 2) ** 2 + np.cos(np.radians(c["_la"])) * np.cos(np.radians(p._la)) * np.sin(lo / 2) ** 2
        seen += len(p)
        p = p[2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(h)) <= 112.306]
        for day, of_day in p.groupby((p._t // hour - c["_t"] // hour) // 24 + 1):
            want[c["_id"], day] = (len(of_day), of_day._s.max())
    assert {(r["_id"], r["day_after"]): (r["_n"], r["_s"]) for r in got.to_dict("records")} == want and len(want) > m
    assert looked < seen  # three arrays per pair looked at


def test_decluster_equals_brute_force(spark):
    q = _quakes(spark, 400).filter("magnitude >= 6")
    p = q.select(*(F.col(c).alias(f"p_{c}") for c in q.columns))
    brute = q.join(
        p,
        (F.col("p_magnitude") > F.col("magnitude")) & (F.col("p_time") < F.col("time"))
        & (F.col("p_time") >= F.col("time") - F.expr("INTERVAL 90 DAYS"))
        & (fn.haversine_km("p_lat", "p_lon", "lat", "lon") <= 150),
        "left_anti",
    )
    got = geo.decluster(q, 150, 90)
    assert sorted(rows(got.select("event_id"))) == sorted(rows(brute.select("event_id")))
    assert 0 < got.count() < q.count()
    assert not any(name in executed_plan(got) for name in NO_PAIRS)


def test_decluster_over_few_spots_with_ties(spark):
    """Many events of one spot, of equal times and magnitudes, over several slots; events of neighbouring spots count too."""
    rng = random.Random(4)
    data = [(f"e{k}", rng.randrange(0, 400) * 43_200, 10.0 + rng.randrange(3) * 0.5, 20.0, 5 + rng.randrange(8) / 2) for k in range(900)]
    q = spark.createDataFrame(data, "event_id string, s long, lat double, lon double, magnitude double").withColumn("time", F.timestamp_seconds("s")).drop("s")
    near = lambda a, b: abs(a[2] - b[2]) < 0.6
    beaten = {e[0] for e in data for p in data if p[4] > e[4] and p[1] < e[1] <= p[1] + 30 * 86_400 and near(p, e)}
    for limit in (None, 40):
        got = {r.event_id for r in geo.decluster(q, 70, 30, rows_per_task=limit).collect()}
        assert got == {e[0] for e in data} - beaten
    # Three spots of fourteen magnitudes and eight slots: at most two rows for each of them.
    left = geo.skyline(q, 30)
    assert left.count() < 0.3 * 2 * len(data)
    assert left.groupBy("_plat", "_slot").count().agg(F.max("count")).first()[0] <= 2 * 14


def test_stab_clips_and_skips_spans_outside(spark):
    spans = spark.createDataFrame([(1, 1990, 1992), (2, 1980, 1985), (3, 2001, None), (4, 1999, 1998)], "id int, s int, e int")
    got = sorted(rows(joins.stab(spans, "s", F.coalesce("e", F.lit(2026)), 1991, 2002).select("id", "year")))
    assert got == [(1, 1991), (1, 1992), (3, 2001), (3, 2002)]


def test_walk_forward_never_mixes_past_and_future(spark):
    df = reshape.spine(spark, 2000, 2010)
    train, test = joins.walk_forward(df, "year", [2003, 2007], first_year=2002)
    assert rows(train.filter("year > cut_year OR year < 2002")) == []
    assert rows(test.filter("year <= cut_year")) == []
    assert (train.count(), test.count()) == (2 + 6, 7 + 3)


def test_bracket(spark):
    anchors = spark.createDataFrame([(2, 20.0), (5, 50.0)], "year int, v double")
    got = rows(joins.bracket(reshape.spine(spark, 1, 6), anchors, "year", ["v"]).orderBy("year"))
    assert got == [(2, 2, 20.0, 2, 20.0), (3, 2, 20.0, 5, 50.0), (4, 2, 20.0, 5, 50.0), (5, 5, 50.0, 5, 50.0)]


def test_exists_flag(spark):
    a = spark.createDataFrame([(1, 10, 0.0), (2, 10, 5.0), (3, 10, 99.0), (4, None, 0.0)], "id int, k int, x double")
    near = lambda l, r: (F.col(f"{l}id") != F.col(f"{r}id")) & (F.abs(F.col(f"{l}x") - F.col(f"{r}x")) < 10)
    got = joins.exists_flag(a, a, ["k"], "twin", near, ["id"])
    assert sorted(rows(got.select("id", "twin"))) == [(1, True), (2, True), (3, False), (4, False)]


def test_acf_of_an_alternating_series(spark):
    df = spark.range(40).select(F.col("id").alias("t"), (F.col("id") % 2).cast("double").alias("v"))
    got = {r.lag: r.acf for r in joins.acf(df, ["t"], "v", [1, 2], fn.safe_corr).collect()}
    assert got[1] == pytest.approx(-1) and got[2] == pytest.approx(1)


def test_with_total_keeps_a_null_key_apart(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 4)], "k string, v int")
    got = set(rows(aggregates.with_total(df, "k", [F.sum("v").alias("s")], "ALL")))
    assert got == {("a", 3), (None, 4), ("ALL", 7)}


def test_quantiles_by_equals_the_plain_quantile(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).alias("k"), (F.col("id") * 37 % 101).cast("double").alias("v"))
    got = {r.k: (r.a, r.b) for r in aggregates.quantiles_by(df, ["k"], "v", {"a": 0.05, "b": 0.95}).collect()}
    want = {r.k: tuple(r.q) for r in df.groupBy("k").agg(F.percentile("v", F.array(F.lit(0.05), F.lit(0.95))).alias("q")).collect()}
    assert got == want


def test_regimes(spark):
    df = spark.createDataFrame([(1, 3), (2, 3), (3, 4), (4, 3)], "year int, n int")
    got = rows(windows.with_regime(df, "n", ["year"]).orderBy("year"))
    assert got == [(1, 3, None, 0), (2, 3, False, 0), (3, 4, True, 1), (4, 3, True, 2)]


def test_unpivot_drops_missing_cells(spark):
    df = spark.createDataFrame([(1, 2, None)], "year int, a int, b double")
    assert rows(reshape.unpivot(df, ["year"], ["a", "b"])) == [(1, "a", 2.0)]


def test_months_to_rows(spark):
    df = spark.createDataFrame([(7, 1, 0)], "id int, m01 int, m02 int")
    assert sorted(rows(reshape.months_to_rows(df, ["m01", "m02"]).select("id", "month", "cnt"))) == [(7, 1, 1), (7, 2, 0)]


def test_union_named_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "id int, a string")
    b = spark.createDataFrame([("y", 2)], "b string, id int")
    assert sorted(rows(reshape.union_named([a, b]).select("id", "a", "b"))) == [(1, "x", None), (2, None, "y")]


def test_month_spine(spark):
    got = rows(reshape.month_spine(spark, 1999, 2000).selectExpr("year", "month", "string(month_start)"))
    assert len(got) == 24 and got[0] == (1999, 1, "1999-01-01") and got[-1] == (2000, 12, "2000-12-01")


def test_filters(spark):
    df = spark.createDataFrame([(1, None), (2, "deleted"), (3, "ok")], "id int, status string")
    assert sorted(rows(row_ops.filter_valid(df, not_equals_or_null={"status": "deleted"}).select("id"))) == [(1,), (3,)]
    assert row_ops.where_opt(df, row_ops.opt(None, lambda v: F.col("id") == v)).count() == 3
    assert rows(row_ops.top_k(df, ["-status", "id"], 2).select("id")) == [(3,), (2,)]


def test_since_needs_no_clock_when_a_date_is_given(spark):
    df = spark.sql("SELECT timestamp'2024-01-31 12:00:00' AS t UNION ALL SELECT timestamp'2024-01-01 00:00:00'")
    assert row_ops.since(df, "t", 5, "2024-02-01").count() == 1
    assert row_ops.since(df, "t", None).count() == 2


def test_within_reach_keeps_every_partner(spark):
    q = _quakes(spark)
    mains = q.filter("magnitude >= 7.5").select(F.col("time").alias("mt"), F.col("lat").alias("mlat"), F.col("lon").alias("mlon"))
    at = (("time", "lat", "lon"), ("mt", "mlat", "mlon"))
    near = {r.event_id for r in geo.within_reach(q, mains, 50, 10, *at).collect()}
    partners = {r.event_id for r in geo.space_time_join(q, mains, 50, 10, *at).collect()}
    assert partners <= near and len(near) < q.count()


def test_duplicates_are_found_on_one_spot_and_nearby(spark):
    from terralake.plans.gold_disasters import suspected_duplicates

    data = [(1, 1900, 50, 10.0, 20.0), (2, 1900, 50, 10.0, 20.0), (3, 1900, 50, 11.0, 20.0), (4, 1900, 50, 40.0, 20.0),
            (5, 1900, 60, 10.0, 20.0), (6, 1901, 70, 0.0, 179.9), (7, 1901, 70, 0.0, -179.9), (8, 1900, 50, None, None)]
    df = spark.createDataFrame(data, "id int, year int, deaths_best int, latitude double, longitude double")
    spots = {tuple(r)[:4] for r in suspected_duplicates(df, 200).collect()}
    assert spots == {(1900, 50, 10.0, 20.0), (1900, 50, 11.0, 20.0), (1901, 70, 0.0, 179.9), (1901, 70, 0.0, -179.9)}


def _series(spark, n=400):
    """Rows in a random order; long stretches of one phase, many values missing."""
    order = random.Random(7).sample(range(n), n)
    return spark.createDataFrame([(t, (t * 37) % 11, "ab"[t // 130 % 2], t if t % 90 == 5 else None) for t in order], "t long, v long, phase string, anchor long")


def test_totals_and_regimes_are_carried_over_ranges(spark):
    df = _series(spark)
    totals = windows.with_running_sum(df, "since", "v", ["-t"], parts=8)
    assert {r.t: r.since for r in totals.collect()} == {t: sum((k * 37) % 11 for k in range(t, 400)) for t in range(400)}
    regimes = {r.t: (r.changed, r.regime) for r in windows.with_regime(df, "phase", ["t"], "changed", "regime", parts=8).collect()}
    assert regimes == {t: (None if t == 0 else t % 130 == 0, t // 130) for t in range(400)}
    for made in (totals, windows.with_regime(df, "phase", ["t"], "changed", "regime", parts=8)):
        plan = executed_plan(made)
        assert "SinglePartition" not in plan and "CartesianProduct" not in plan
    by_key = windows.with_regime(df.withColumn("k", F.col("t") % 2), "phase", ["t"], "changed", "regime", keys=["k"])
    assert {r.t: r.regime for r in by_key.collect()} == {t: t // 130 for t in range(400)}


def test_ranges_without_rows_and_with_nulls(spark):
    empty = spark.createDataFrame([], "t long, v long")
    assert windows.with_running_sum(empty, "s", "v", ["t"]).count() == 0
    odd = spark.createDataFrame([(1, None), (2, 3), (None, 4), (2, 3)], "t long, v long")
    assert sorted(rows(windows.with_running_sum(odd, "s", "v", ["t"], parts=4)), key=str) == sorted([(1, None, None), (2, 3, 3), (2, 3, 6), (None, 4, 10)], key=str)


def test_bracket_and_acf_over_ranges(spark):
    df = _series(spark)
    anchors = df.filter("anchor IS NOT NULL").select("t", (F.col("v") + 100).alias("w"))
    marks = {t: (t * 37) % 11 + 100 for t in range(400) if t % 90 == 5}
    got = {r.t: (r.lo_t, r.lo_w, r.hi_t, r.hi_w) for r in joins.bracket(df.select("t"), anchors, "t", ["w"], parts=8).collect()}
    lo = lambda t: max(a for a in marks if a <= t)
    hi = lambda t: min(a for a in marks if a >= t)
    assert got == {t: (lo(t), marks[lo(t)], hi(t), marks[hi(t)]) for t in range(5, 366)}
    whole = joins.acf(df, ["t"], "v", [1, 5], fn.safe_corr, parts=8)
    keyed = joins.acf(df.withColumn("k", F.lit(1)), ["t"], "v", [1, 5], fn.safe_corr, keys=["k"]).drop("k")
    near = lambda f: sorted((r.lag, r.n_pairs, round(r.acf, 9)) for r in f.collect())
    assert near(whole) == near(keyed) and "SinglePartition" not in executed_plan(whole)


def test_quantiles_read_the_measure_once(spark, tmp_path):
    spark.range(4000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 40).cast("string")).alias("k"), (F.col("id") * 7919 % 1009 / 8).alias("v")).write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    got = aggregates.quantiles_by(df, ["k"], "v", {"a": 0.05, "b": 0.5, "c": 1.0}, [F.sum("_n").alias("n")], parts=8)
    want = df.groupBy("k").agg(F.percentile("v", F.array(F.lit(0.05), F.lit(0.5), F.lit(1.0))).alias("q"), F.count("*").alias("n"))
    assert {r.k: (r.n, round(r.a, 9), round(r.b, 9), round(r.c, 9)) for r in got.collect()} == {r.k: (r.n, *(round(x, 9) for x in r.q)) for r in want.collect()}
    plan = executed_plan(got).split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") <= 4 and str(tmp_path) not in plan
