"""Registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terralake.llm import alignment, bpe, chat, classifier, leaks, lines, mixing, prefixes, rules, shards, simhash, toxicity, warc
from terralake.llm.common import ship

_RUNS = [
    classifier.op1_classifier,
    warc.op2_warc,
    bpe.op3_bpe,
    chat.op4_chat,
    simhash.op5_simhash,
    rules.op6_rules,
    lines.op7_lines,
    toxicity.op8_toxicity,
    shards.op9_shards,
    leaks.op10_leaks,
    alignment.op11_alignment,
    prefixes.op12_prefixes,
    mixing.op13_mixing,
]


def _query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return run(spark, sf_dir)

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {run.__name__: _query(run) for run in _RUNS}

SQL: dict[str, str] = {"op2_warc": warc.OP2_SQL, "op4_chat": chat.OP4_SQL, "op12_prefixes": prefixes.OP12_SQL, "op13_mixing": mixing.OP13_SQL}
