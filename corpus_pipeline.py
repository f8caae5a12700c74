"""A corpus pipeline: toxicity, repeated lines, near-duplicates, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on everything the stage before it kept; `run`
writes each result to the shared folder and reads it again. All stages but the last return the
columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralake.llm import bpe, leaks, lines, simhash, toxicity
from terralake.llm.common import ship, staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold; rows without an id or a text are judged like others.

    The model is fitted on the given documents and the labels, outside the held-out fold. Equal texts go or stay together; very long ones are scored whole. Without labels of
    both kinds all rows go or stay. An empty table gives no rows.
    """
    ship(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, later repeats deleted from their texts and n_chars counted anew where a text changed."""
    ship(spark)
    cleaned = lines.drop_repeated_lines(docs)
    chars = F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", chars).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, texts of 0.8 similarity or more in five-word shingles, one row: that of the smallest id.

    Of several rows of that id the one of the least text hash stays, of equal rows any one; of a group whose ids are all NULL one row, too.
    Empty and NULL texts are one group. Very long texts are compared whole. An empty table gives no rows.
    """
    ship(spark)
    of_text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    # A row's own number tells repeated rows apart; it is fixed by writing it.
    numbered = staged(docs.withColumn("row_of_stage", F.monotonically_increasing_id()), "numbered")
    found = simhash.similar_texts(numbered.select("doc_id", "text"))
    # Whole groups of rows without an id are known by their texts' hash, which is all that such a class has.
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.min("of_text").alias("kept_text"))
    nameless = found.filter("component_id IS NULL").select(F.col("of_text").alias("kept_text")).distinct()
    candidates = numbered.select("doc_id", of_text.alias("kept_text"), "row_of_stage")
    rows = candidates.join(kept, ["doc_id", "kept_text"]).union(candidates.filter("doc_id IS NULL").join(nameless, "kept_text").select("doc_id", "kept_text", "row_of_stage"))
    one = rows.groupBy("doc_id", "kept_text").agg(F.min("row_of_stage").alias("row_of_stage")).select("row_of_stage")
    return numbered.join(one, "row_of_stage", "left_semi").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, within eight edits in a hundred characters, case and white space aside.

    Rows without a text hold none and stay, as do repeated rows; very long texts are searched whole. Without items all rows stay. An empty table gives no rows.
    """
    ship(spark)
    return leaks.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document that is left.

    NULL and empty texts have no tokens. Repeated rows and ids give one row each; very long texts are encoded whole. An empty table gives no rows.
    """
    ship(spark)
    return bpe.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-duplicates", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("tokens", tokens),
]

#: Models, edit distances and fingerprints are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
