"""From parsed rows to bronze: validate, append the good rows, hand back the rest."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame

from terralake.session import ensure_checkpoint_dir
from terralake.sources.bronze import write_bronze
from terralake.sources.validation import checked_bronze, split


def ingest(
    parsed: DataFrame, root: str, table: str, ingested_at: datetime | None = None
) -> DataFrame:
    """Append a parsed batch and return its rejected rows with the rules they broke.

    The checked batch is written once to the shared folder and split from there, so the payloads
    are parsed once, and the rejected rows stay the same whenever they are read.
    """
    checked = checked_bronze(parsed, table)
    path = f"{ensure_checkpoint_dir(parsed.sparkSession)}/ingest-{table}-{uuid.uuid4().hex}"
    checked.write.parquet(path)
    good, rejected = split(parsed.sparkSession.read.schema(checked.schema).parquet(path))
    write_bronze(good, root, table, ingested_at)
    return rejected
