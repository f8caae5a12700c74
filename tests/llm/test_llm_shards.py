import zlib

from pyspark.sql import functions as F

from terralake.llm import shards


def laws(rows, count, texts=None):
    bytes_, slots, groups = [0] * count, [[] for _ in range(count)], {}
    for r in rows:
        bytes_[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        groups.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    return bytes_, groups


def test_sizes_are_near_equal_and_copies_stay_together(spark, documents, texts):
    sf = "/root/testdata/sf0.01"
    found = shards.op9_shards(spark, sf)
    assert found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = found.collect()
    given = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in given.items()}
    sizes, groups = laws(rows, 8)
    assert max(sizes) <= 1.03 * min(sizes) and all(len(g) == 1 for g in groups.values())


def test_plans_are_native(spark, documents):
    plan = shards.shards(documents, count=4)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_group_larger_than_a_shard_is_cut(spark, documents):
    rows = [(i, "same text " * 20, "s") for i in range(600)] + [(1000 + i, f"other text {i} " * 12, f"s{i % 7}") for i in range(1200)]
    sizes, groups = laws(shards.shards(spark.createDataFrame(rows, "doc_id long, text string, source string"), count=8).collect(), 8)
    assert max(sizes) <= 1.35 * min(sizes)
    assert sorted(len(g) for g in groups.values())[-2:] == [1, max(len(g) for g in groups.values())]


def test_shards_by_bytes_and_odd_counts(spark, documents):
    frame = spark.range(900).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("t"), "id"), (F.col("id") % 30).cast("int")).alias("text"), F.lit(None).cast("string").alias("source"))
    total = frame.agg(F.sum(shards.size_of("text"))).first()[0]
    rows = shards.shards(frame, target_bytes=total // 5).collect()
    sizes, _ = laws(rows, 5)
    assert max(sizes) <= 1.1 * min(sizes)


def test_odd_rows(spark, odd):
    rows = shards.shards(odd, count=3).collect()
    laws(rows, 3)
    assert len(rows) == odd.count() and sorted(r["size"] for r in rows if r["text_crc32"] == 0) == [1, 1, 1]
    assert shards.shards(odd.limit(0), count=3).collect() == []
    assert {r["shard"] for r in shards.shards(odd, count=1).collect()} == {0}
