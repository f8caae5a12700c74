"""Full rebuild: seeds, silver and gold in dependency order, each saved as a table."""

from __future__ import annotations

import inspect
import time
import uuid
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession

from terralake.functions.scalar import space_time_cell
from terralake.plans import (
    gold_cyclones as cyclones,
    gold_disasters as disasters,
    gold_panels as panels,
    gold_quakes as quakes,
    gold_skill as skill,
    gold_weather as weather,
    silver,
)
from terralake.sources.bronze import bronze_tables, path_exists
from terralake.sources.seeds import dim_locations

Model = Callable[..., DataFrame]

# In dependency order: a model may read any table above it.
MODELS: dict[str, Model] = {
    f.__name__: f
    for f in (
        silver.silver_weather_hourly,
        silver.silver_earthquakes,
        silver.silver_bird_observations,
        silver.silver_historical_disasters,
        silver.silver_epidemics,
        silver.silver_cyclone_tracks,
        silver.silver_population,
        silver.silver_oni,
        silver.silver_historical_events,
        weather.gold_weather_daily,
        weather.gold_climatology,
        weather.gold_temperature_anomaly,
        quakes.gold_quake_magnitude_frequency,
        quakes.gold_quake_b_value,
        quakes.gold_quake_sequences,
        quakes.gold_quake_pressure_test,
        disasters.gold_bird_daily,
        quakes.gold_quakes_near_city,
        disasters.gold_disasters_ranked,
        disasters.gold_disaster_cascades,
        disasters.gold_disasters_by_century,
        disasters.gold_epidemics_vs_disasters,
        cyclones.gold_cyclones,
        cyclones.gold_cyclone_seasons,
        cyclones.gold_cyclones_near_city,
        cyclones.gold_world_population,
        disasters.gold_catastrophes_per_capita,
        cyclones.gold_enso_cyclones,
        weather.gold_heatwave_features,
        weather.gold_heatwave_model,
        weather.gold_heatwave_backtest,
        quakes.gold_aftershock_forecast,
        skill.gold_model_skill,
        panels.gold_year_panel,
        panels.gold_month_panel,
        panels.gold_panel_coverage,
        weather.gold_heat_threshold_drift,
    )
}


class LazyTables(Mapping):
    """Table name to DataFrame, each model planned on first use.

    ``options`` gives keyword arguments per model; ``rounding`` goes to every
    model that takes it. With ``stage`` a model that others read is written once
    and read back, so that it is not computed again for each of its readers;
    without it a read is one logical plan from the inputs to the asked table.
    """

    def __init__(
        self,
        inputs: Mapping[str, DataFrame],
        rounding: bool = True,
        options: Mapping[str, Mapping[str, object]] | None = None,
        stage: Callable[[DataFrame, str], DataFrame] | None = None,
    ):
        self._done = dict(inputs)
        self._rounding = rounding
        self._options = options or {}
        self._stage = stage or (lambda df, name: df)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._done:
            self._done[name] = self._stage(self.model(name), name)
        return self._done[name]

    def put(self, name: str, df: DataFrame) -> None:
        self._done[name] = df

    def model(self, name: str) -> DataFrame:
        """The plan of one model over the tables it reads."""
        return run_model(name, self, self._rounding, self._options.get(name, {}))

    def __iter__(self) -> Iterator[str]:
        return iter({**self._done, **MODELS})

    def __len__(self) -> int:
        return len({**self._done, **MODELS})


def run_model(
    name: str, t: Mapping[str, DataFrame], rounding: bool = True, options: Mapping | None = None
) -> DataFrame:
    model = MODELS[name]
    arguments = dict(options or {})
    if "rounding" in inspect.signature(model).parameters:
        arguments.setdefault("rounding", rounding)
    return model(t, **arguments)


# Tables that are read by place or by key are dealt out in ranges of these and sorted inside
# their files, so that the statistics of a file span few values and a filtered read skips most
# files. Events that are looked for by distance and time follow a curve through both.
SORTED_BY: dict[str, tuple[str | Callable[[], Column], ...]] = {
    "silver_weather_hourly": ("location_id", "time"),
    "silver_earthquakes": (lambda: space_time_cell("lat", "lon", "time"), "time"),
    "gold_weather_daily": ("location_id", "local_date"),
    "gold_climatology": ("location_id", "doy"),
    "gold_temperature_anomaly": ("location_id", "local_date"),
    "gold_heatwave_features": ("location_id", "local_date"),
    "gold_bird_daily": ("location_id", "obs_date"),
    "gold_quakes_near_city": ("location_id", "time"),
    "gold_cyclones_near_city": ("location_id", "closest_time"),
    "silver_cyclone_tracks": ("sid", "time"),
}


def table_path(out: str, name: str) -> str:
    return f"{out.rstrip('/')}/{name}"


def versions(spark: SparkSession, out: str, name: str) -> list[str]:
    """Paths of the complete versions of a table, the oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table_path(out, name))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = [s.getPath().toString() for s in files.listStatus(path) if s.isDirectory()]
    return sorted(p for p in found if path_exists(spark, f"{p}/_SUCCESS"))


def clustered(df: DataFrame, name: str) -> DataFrame:
    """The rows in the order their table is written in, each task a range of it.

    Ranges are cut at sampled rows, between all keys: a place with a third of all rows is cut
    along its days. Rows with the same values in all keys stay in one range. Computed keys are
    columns until the rows are sorted: a sort would compute them anew for each two rows it compares.
    """
    computed = {f"_key{i}": k() for i, k in enumerate(SORTED_BY.get(name, ())) if callable(k)}
    keys = [f"_key{i}" if callable(k) else k for i, k in enumerate(SORTED_BY.get(name, ()))]
    if not keys:
        return df
    return df.withColumns(computed).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*computed)


def save(df: DataFrame, out: str, name: str) -> DataFrame:
    """Replace a table by a new version and return it as read back.

    A version counts once it is complete, so a job that fails leaves the table as it was.
    The version before stays for readers that have begun; older ones are deleted.
    Reading back cuts the lineage at a written table, so a lost executor costs a
    re-read of files and not a re-run of everything before.
    """
    spark = df.sparkSession
    before = versions(spark, out, name)
    path = f"{table_path(out, name)}/v{time.time_ns():020d}-{uuid.uuid4().hex}"
    clustered(df, name).write.option("compression", "zstd").parquet(path)
    for old in before[:-1]:
        target = spark._jvm.org.apache.hadoop.fs.Path(old)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return spark.read.schema(df.schema).parquet(path)


def build(
    spark: SparkSession,
    bronze: str,
    out: str,
    options: Mapping[str, Mapping[str, object]] | None = None,
) -> dict[str, DataFrame]:
    """All tables, rebuilt from bronze; running it twice gives the same tables."""
    t = LazyTables(
        bronze_tables(spark, bronze), options=options, stage=lambda df, name: save(df, out, name)
    )
    places = save(dim_locations(spark), out, "dim_locations")
    t.put("dim_locations", places)
    return {"dim_locations": places, **{name: t[name] for name in MODELS}}


def load(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The tables of an earlier build, each in its newest complete version."""
    found = {n: versions(spark, out, n) for n in ["dim_locations", *MODELS]}
    return {n: spark.read.parquet(paths[-1]) for n, paths in found.items() if paths}
