"""Append-only bronze tables: Parquet with zstd, partitioned by ingest date."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralake.schemas import DATASETS, Dataset, with_provenance


def bronze_path(root: str, dataset: Dataset) -> str:
    return f"{root.rstrip('/')}/{dataset.source}/{dataset.name}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Checks through Hadoop, so it works on any file system of the cluster."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def empty_bronze(spark: SparkSession, table: str) -> DataFrame:
    """A typed empty source, so that models run before a dataset was ever ingested."""
    return spark.createDataFrame([], with_provenance(DATASETS[table].schema))


def read_bronze(spark: SparkSession, root: str, table: str) -> DataFrame:
    """All files of a dataset under its fixed schema; absent columns are NULL."""
    dataset = DATASETS[table]
    path = bronze_path(root, dataset)
    if not path_exists(spark, path):
        return empty_bronze(spark, table)
    return spark.read.schema(with_provenance(dataset.schema)).parquet(path)


def write_bronze(
    df: DataFrame, root: str, table: str, ingested_at: datetime | None = None
) -> bool:
    """Append a batch with its provenance; an empty batch writes nothing.

    Returns whether anything was written. ``isEmpty`` reads at most one row.
    """
    if df.isEmpty():
        return False
    dataset = DATASETS[table]
    stamp = F.lit(ingested_at) if ingested_at else F.current_timestamp()
    (
        df.withColumns({"_ingested_at": stamp.cast("timestamp"), "_source": F.lit(dataset.source)})
        .withColumn("ingest_date", F.to_date("_ingested_at"))
        .write.mode("append")
        .partitionBy("ingest_date")
        .option("compression", "zstd")
        .parquet(bronze_path(root, dataset))
    )
    return True


def bronze_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {table: read_bronze(spark, root, table) for table in DATASETS}


def bronze_stats(spark: SparkSession, root: str) -> DataFrame:
    """Files, rows and bytes per dataset; datasets without files show zeros.

    Rows are counted by file; only file metadata is read, no column.
    """
    out = None
    for table, dataset in DATASETS.items():
        path = bronze_path(root, dataset)
        names = [F.lit(dataset.source).alias("source"), F.lit(dataset.name).alias("dataset")]
        if path_exists(spark, path):
            per_file = (
                spark.read.schema(with_provenance(dataset.schema))
                .parquet(path)
                .groupBy(
                    F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_size").alias("size"),
                )
                .count()
            )
            row = per_file.agg(
                F.count(F.lit(1)).alias("files"),
                F.coalesce(F.sum("count"), F.lit(0)).alias("rows"),
                F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
            )
        else:
            zero = F.lit(0).cast("bigint")
            row = spark.range(1).select(zero.alias("files"), zero.alias("rows"), zero.alias("bytes"))
        row = row.select(*names, "files", "rows", "bytes")
        out = row if out is None else out.unionByName(row)
    return out
