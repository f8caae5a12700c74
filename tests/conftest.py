import pathlib
import sys

import pytest

for folder in (pathlib.Path(__file__).resolve().parent, pathlib.Path(__file__).resolve().parents[1]):
    sys.path.insert(0, str(folder))

from helpers import BUILD_OPTIONS, SF  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from workload.verify import local_session

    return local_session(cpus=4, partitions=4)


def _batch(table, driver):
    """Bronze rows from the driver's tables, with the ids of real places."""
    from pyspark.sql import functions as F
    from terralake.schemas import DATASETS
    from terralake.sources.seeds import FLAGSHIP_IDS
    from workload.domain import INPUTS

    place = lambda k: F.get(F.array(*(F.lit(i) for i in FLAGSHIP_IDS)), k.cast("int"))
    if table == "bronze_weather":
        return driver["lineitem"].select(
            place(F.col("l_suppkey") % 12).alias("location_id"),
            (F.col("l_shipdate") + F.make_dt_interval(hours=F.col("l_linenumber"))).alias("time"),
            F.lit("observed").alias("kind"),
            F.col("l_quantity").alias("temperature_2m"),
            F.col("l_discount").alias("precipitation"),
            (F.col("l_extendedprice") / 100).alias("pressure_msl"),
        )
    batch = INPUTS[table](driver).select(*DATASETS[table].schema.fieldNames())
    if "location_id" in batch.columns:
        batch = batch.withColumn("location_id", place(F.col("location_id")))
    return batch


@pytest.fixture(scope="session")
def built(spark, tmp_path_factory):
    """All tables, built from bronze files written from the driver's tables."""
    from terralake.plans.build import build
    from terralake.schemas import DATASETS
    from terralake.sources.bronze import write_bronze
    from workload.domain import OPTIONS, Driver

    root = tmp_path_factory.mktemp("lake")
    driver = Driver(spark, SF)
    for table in DATASETS:
        assert write_bronze(_batch(table, driver), f"{root}/bronze", table)
    tables = build(spark, f"{root}/bronze", f"{root}/out", OPTIONS | BUILD_OPTIONS)
    return {"root": str(root), "tables": tables}
