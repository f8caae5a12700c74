import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from llm_helpers import CLASHES, SF, TEXTS  # noqa: E402

@pytest.fixture(scope="session")
def documents(spark):
    from terralake.llm.common import ship

    ship(spark)
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd(spark, documents):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash."""
    rows = [(i, t, "en", "src0", 0, *("clash" for _ in CLASHES)) for i, t in TEXTS]
    fields = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(rows, fields)
