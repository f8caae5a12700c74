import itertools
import random

import brute
import numpy as np

from terralake.llm import simhash
from terralake.llm.components import components


def test_whole_table_equals_all_pairs(spark, documents, texts):
    found = simhash.op5_simhash(spark, brute.SF).collect()
    fps = {i: brute.fingerprint(t) for i, t in texts.items()}
    assert {r["doc_id"]: r["fingerprint"] for r in found} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r["doc_id"]: r["component_id"] for r in found} == brute.classes(list(fps), list(fps.values()))


def test_keys_cover_all_differences_within_the_distance():
    ring = simhash.segments(7)
    assert sum(ring) == (1 << 64) - 1
    keys = {frozenset(held) for _, held in simhash.chain_keys(4, 7, 3)}
    for segments in itertools.combinations_with_replacement(range(7), 4):
        assert any(not held & set(segments) for held in keys)


def test_keys_are_shuffled_once(spark):
    """The list of crowded keys is copied to the tasks at any size, so keys do not travel to meet it."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = simhash.links(spark.range(50).withColumnRenamed("id", "fp"))._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_links_connect_what_all_pairs_connect(spark, documents):
    """A dense ball of near fingerprints, chains of steps, and strangers."""
    rng = random.Random(3)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    centre = rng.getrandbits(64)
    fps = {centre} | {flip(centre, rng.randint(1, 3)) for _ in range(800)} | {rng.getrandbits(64) for _ in range(500)}
    chain = [rng.getrandbits(64)]
    for _ in range(60):
        chain.append(flip(chain[-1], 4))
    fps = sorted(fps | set(chain))
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    frame = spark.createDataFrame([(s,) for s in signed], "fp long")
    links = simhash.links(frame)
    assert links.count() < 12 * len(fps)
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    wanted = brute.classes(signed, fps)
    groups = lambda label: {frozenset(k for k in signed if label.get(k, k) == v) for v in set(label.get(k, k) for k in signed)}
    assert groups(roots) == groups(wanted)


def test_blocks_of_a_large_key_lose_nothing(spark, documents, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "PART", 1)
    base = 0x0123456789ABCDEF
    fps = [base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)][:300]
    frame = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    assert len({r["root"] for r in components(simhash.links(frame)).collect()}) == 1


def test_components_of_a_long_path_and_odd_links(spark):
    path = [(i, i + 1) for i in range(200)] + [(500, 500), (None, 3), (7, None), (300, 301), (301, 300)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(201)} | {300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_odd_rows(odd):
    made = simhash.near_duplicates(odd).collect()
    assert len(made) == odd.count()
    empty = [r for r in made if r["fp"] == 0]
    # Empty, blank and NULL texts are one group, under the smallest id among them.
    assert {r["component_id"] for r in empty} == {2} and len(empty) == 4
    assert [r["component_id"] for r in made if r["doc_id"] is None and r["fp"] != 0] == [None]
    assert simhash.near_duplicates(odd.limit(0)).collect() == []


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_similar_texts_against_all_pairs(spark, documents):
    """Near copies of every degree, a hot group of copies and a hot group of near copies; what is linked is similar, and nine in ten similar pairs are linked."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    docs, n = [], 0
    for _ in range(150):
        base = [word() for _ in range(rng.randint(120, 400))]
        for k in (0, 0, 1, 2, 4, 6):
            docs.append((n, edited(rng, base, min(k, len(base) // 45))))
            n += 1
    hot = [word() for _ in range(250)]
    docs += [(n + k, edited(rng, hot, k % 4)) for k in range(400)] + [(n + 400 + k, "the same text " * 9) for k in range(200)]
    docs += [(5000, ""), (5001, None), (5002, " \n")]
    found = {r.doc_id: r.component_id for r in simhash.similar_texts(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).collect()}
    want = brute.similar_classes(docs)
    sets = brute.shingle_sets(docs)
    assert len(found) == len(docs) and all(found[k] <= k for k in found)
    # Classes found are parts of the true ones.
    assert all(want[k] == want[found[k]] for k in found)
    near = [(a, b) for a, b in itertools.combinations(range(900), 2) if a // 6 == b // 6 and 0.8 <= brute.jaccard(sets[a], sets[b]) < 1]
    assert len(near) > 500 and sum(found[a] == found[b] for a, b in near) >= 0.9 * len(near)
    assert len({found[n + k] for k in range(400)}) == 1 and len({found[n + 400 + k] for k in range(200)}) == 1
    assert found[5000] == found[5001] == found[5002] == 5000


def test_similar_texts_of_the_table(spark):
    """Recall over the pairs of the given table, by brute force over shared shingles."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    found = {r.doc_id: r.component_id for r in simhash.similar_texts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want, sets = brute.similar_classes(docs), brute.shingle_sets(docs)
    assert all(want[k] == want[found[k]] for k in found)
    classes = {}
    for k, v in want.items():
        classes.setdefault(v, []).append(k)
    pairs = [(a, b) for v in classes.values() for a, b in itertools.combinations(v, 2) if 0.8 <= brute.jaccard(sets[a], sets[b]) < 1]
    linked = sum(found[a] == found[b] for a, b in pairs)
    assert linked >= 0.9 * len(pairs), (linked, len(pairs))


def test_similar_texts_odd_rows(odd):
    made = simhash.similar_texts(odd).collect()
    assert len(made) == odd.count()
    assert [r["component_id"] for r in made if r["doc_id"] in (2, 3, 4)] == [2, 2, 2]
    assert simhash.similar_texts(odd.limit(0)).collect() == []
