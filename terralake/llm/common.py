"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralake.session import ensure_checkpoint_dir

#: Characters of text that one step of a Python task holds at once; one longer text is a step of its own.
STEP_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again, so that lineage ends at files."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that `staged` gave and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for place in {file.rpartition("/")[0] for file in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(place))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def id_and_text(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Only the id and the text (NULL: empty), so that other columns cannot clash with results."""
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores after it until the table has no such column."""
    while name in df.columns:
        name += "_"
    return name


def in_steps(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of at most STEP_CHARS bytes of text."""
    for batch in batches:
        sizes = [x or 0 for x in pc.binary_length(batch.column(text)).to_pylist()]
        start = held = 0
        for at, size in enumerate(sizes):
            if held and held + size > STEP_CHARS:
                yield batch.slice(start, at - start)
                start, held = at, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


def map_texts(df: DataFrame, make: Callable[[], Callable[[list[str]], list[pa.Array]]], fields: str, keep_text: bool = False) -> DataFrame:
    """Adds columns that a function of the texts gives; `make` builds it once for each task.

    The column `text` is left out unless asked for; the others pass through.
    """
    added = T.StructType.fromDDL(fields)
    kept = [f for f in df.schema.fields if keep_text or f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_texts = make()
        names = [f.name for f in kept] + added.names
        for step in in_steps(batches):
            arrays = of_texts(step.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([step.column(f.name) for f in kept] + arrays, names=names)

    return df.mapInArrow(run, T.StructType(kept + added.fields))


_SHIPPED: set[str] = set()


#: Rows of an Arrow batch; texts are long, and Spark's default of 10,000 is meant for narrow rows.
BATCH_ROWS = 1_000


def ship(spark: SparkSession) -> None:
    """Sends this package's sources to the executors, once for each application; needless where it is installed there.

    Also makes Arrow batches smaller where the session has Spark's default.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp(prefix="terralake-py-")) / "terralake.zip"
    with zipfile.ZipFile(target, "w") as z:
        for source in sorted((root / "terralake").rglob("*.py")):
            z.write(source, source.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def with_texts(df: DataFrame, text_col: str, make: Callable[[], Callable[..., list[pa.Array]]], fields: str, more: Sequence[str] = (), as_given: bool = False) -> DataFrame:
    """The rows with columns that a function of the text (and of the columns in `more`, which go) gives.

    The function takes a list of texts (NULL: empty) and an Arrow array for each of `more`. With `as_given`
    the column is not made a string first; packed texts come as bytes.
    Input columns of the same names as the added ones are replaced. Other columns pass
    through untouched, packed together so that no name clashes.
    """
    added = T.StructType.fromDDL(fields)
    names = [n for n in df.columns if n not in more]
    packed = df.select(
        (F.col(f"`{text_col}`") if as_given else F.col(f"`{text_col}`").cast("string")).alias("text"),
        F.struct(F.lit(0).alias("_"), *(F.col(f"`{n}`").alias(f"_{i}") for i, n in enumerate(names) if n not in (*added.names, text_col))).alias("rest"),
        *(F.col(n).alias(f"more_{n}") for n in more),
    )
    made_names = [f"made_{n}" for n in added.names]
    schema = T.StructType([packed.schema["text"], packed.schema["rest"], *(T.StructField(f"made_{f.name}", f.dataType) for f in added.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_texts = make()
        for step in in_steps(batches):
            texts = [t or "" for t in step.column("text").to_pylist()]
            arrays = of_texts(texts, *(step.column(f"more_{n}") for n in more))
            yield pa.RecordBatch.from_arrays([step.column("text"), step.column("rest"), *arrays], names=schema.names)

    made = packed.mapInArrow(run, schema)
    place = dict(zip(added.names, made_names))
    kept = [F.col(place[n] if n in place else "text" if n == text_col else f"rest._{i}").alias(n) for i, n in enumerate(names)]
    return made.select(*kept, *(F.col(place[n]).alias(n) for n in added.names if n not in names))
