import pytest
from llm_helpers import SF
from pyspark.sql import functions as F

from terralake.llm import mixing


def _targets(sizes, weights, share, most):
    """Shared out again and again until no source has too much."""
    full, wanted = {}, share * sum(sizes.values())
    while True:
        open_ = [k for k in sizes if k not in full]
        left, weight = wanted - sum(full.values()), sum(weights[k] for k in open_)
        over = [k for k in open_ if weights[k] * left / weight > most * sizes[k]]
        if not over:
            return full | {k: weights[k] * left / weight for k in open_}
        full |= {k: most * sizes[k] for k in over}


def _laws(found, weights, share=1.5, most=2.0):
    by_source = {}
    for r in found:
        by_source.setdefault(r.source, []).append(r)
    sizes = {k: sum(r.size for r in v) for k, v in by_source.items()}
    want = _targets(sizes, dict(zip(sorted(by_source, key=lambda k: (k is None, k or "")), weights * len(by_source))), share, most)
    for k, v in by_source.items():
        assert {(r.source_size, round(r.target, 6)) for r in v} == {(sizes[k], round(want[k], 6))}
        assert abs(sum(r.copies * r.size for r in v) - want[k]) <= max(r.size for r in v) + 1e-3
        rate = want[k] / sizes[k] if sizes[k] else 0
        assert all(int(rate) <= r.copies <= -int(-rate // 1) for r in v) and all(r.copies <= most for r in v)


def test_targets_and_words_taken(spark, documents, texts):
    found = mixing.mix(documents).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    assert all(r.size == len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", texts[r.doc_id]) if w]) for r in found)
    _laws(found, [5.0, 2.0, 1.0])
    again = mixing.mix(documents.repartition(7).orderBy(F.rand(1))).collect()
    assert sorted(found) == sorted(again)
    other = mixing.mix(documents, seed="another").collect()
    assert sorted(found) != sorted(other)
    _laws(other, [5.0, 2.0, 1.0])


def test_a_hot_source_over_many_ranges(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.expr("repeat('w ', CAST(id * 31 % 97 AS INT))").alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("source"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _laws(mixing.mix(rows).collect(), [5.0, 2.0, 1.0])
        _laws(mixing.mix(rows, [1.0], share=0.4).collect(), [1.0], share=0.4)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_weights_by_name(spark, documents):
    found = mixing.mix(documents, {"src0": 3, "src1": 1, "no such source": 9}, share=0.01).collect()
    words = {}
    for r in found:
        words[r.source] = words.get(r.source, 0) + r.copies * r.size
    assert {k for k, v in words.items() if v} <= {"src0", "src1"}
    target = {r.source: r.target for r in found}
    assert target["src0"] == pytest.approx(3 * target["src1"])


def test_odd_rows_and_the_mix_itself(spark, odd):
    found = mixing.mix(odd)
    assert found.count() == odd.count()
    assert all(r.size == 0 for r in found.filter("doc_id IN (2, 3, 4)").collect())
    _laws(found.collect(), [5.0, 2.0, 1.0])
    whole = mixing.mixed(odd)
    assert set(whole.columns) == {*odd.columns, "copy"}
    assert whole.count() == found.agg(F.sum("copies")).first()[0]
    assert whole.agg(F.sum(mixing.words("text"))).first()[0] == found.agg(F.sum(F.col("copies") * F.col("size"))).first()[0]
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mixed(odd.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    from terralake.llm.registry import QUERIES

    plan = QUERIES["op13_mixing"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "SinglePartition", "CartesianProduct", "NestedLoop"))
