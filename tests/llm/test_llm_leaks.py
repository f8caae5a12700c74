import random

import brute
from hypothesis import given, settings
from hypothesis import strategies as st

from terralake.llm import leaks


def wanted(docs, items, rate=leaks.RATE, least=leaks.LEAST_CHARS):
    found = set()
    for d, text in docs:
        for i, item in items:
            item = leaks.plain(item)
            if len(item) >= least:
                edits = brute.edits_inside(item, leaks.plain(text))
                if edits <= int(len(item) * rate):
                    found.add((d, i, edits))
    return found


@settings(max_examples=200, deadline=None)
@given(st.text("ab ", min_size=1, max_size=12), st.text("ab ", max_size=40))
def test_distance(item, text):
    edits, end = leaks.Item(0, item, 0).nearest(text)
    assert edits == brute.edits_inside(item, text)
    assert min(len(item), brute.edits_inside(item, text[:end])) == edits


def test_equals_brute_force(spark, documents):
    rng = random.Random(7)
    words = [f"{a}{b}" for a in ("ta", "ro", "mi", "sel") for b in ("ka", "no", "ti", "lu")]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(8, 25)))) for k in range(12)] + [(20, "short"), (21, None)]
    docs = []
    for d in range(60):
        text = " ".join(rng.choices(words, k=rng.randint(0, 60)))
        if rng.random() < 0.7:
            part = list(rng.choice(items[:12])[1])
            for _ in range(rng.randint(0, 8)):
                at = rng.randrange(len(part))
                rng.choice([lambda: part.insert(at, "x"), lambda: part.pop(at), lambda: part.__setitem__(at, "Q")])()
            text = f"{text}\n{''.join(part).upper() if rng.random() < 0.3 else ''.join(part)}  {text}"
        docs.append((d, text))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"], r["edits"]) for r in leaks.find_leaks(frame, bench).collect()}
    assert found == wanted(docs, [x for x in items if x[1]]) and found
    kept = {r["doc_id"] for r in leaks.without_leaks(frame, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _, _ in found}


def test_more_items_than_a_block(spark, documents, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 60)
    items = [(k, f"item number {k} asks about the colour of thing {k * 7}") for k in range(5)]
    docs = [(k, f"before {t} after") for k, t in items]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r[0], r[1]) for r in leaks.find_leaks(frame, bench, rate=0.0).collect()} == {(k, k) for k in range(5)}
    assert leaks.without_leaks(frame, bench).count() == 0


def test_short_items_stand_exactly_and_as_words(spark, documents):
    items = [(1, "What is a Monad?"), (2, "光合作用とは"), (3, "red fox")]
    docs = [(1, "so: what  is a monad? a box"), (2, "問題光合作用とは何か"), (3, "a hundred foxes, a red foxhound"), (4, "hired fox; the red fox."), (5, "What is a gonad?")]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"], r["edits"], r["ends_at"]) for r in leaks.find_leaks(frame, bench).collect()}
    assert found == {(1, 1, 0, 20), (2, 2, 0, 8), (4, 3, 0, 22)}
    assert {r["doc_id"] for r in leaks.without_leaks(frame, bench).collect()} == {3, 5}


def test_table_has_all_exact_passages(spark, documents, texts):
    bench = spark.read.parquet(f"{brute.SF}/benchmark.parquet")
    exact = {(d, r["item_id"]) for d, t in texts.items() for r in bench.collect() if leaks.plain(r["text"]) in leaks.plain(t)}
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in leaks.op10_leaks(spark, brute.SF).collect()}
    assert exact and exact == {k for k, e in found.items() if e == 0}


def test_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "no id at all here, not even one of them"), (None, "word word word word word word"), (3, ""), (4, None)], "item_id long, text string")
    found = leaks.find_leaks(odd, bench).collect()
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in found} == {(5, None, 0)}
    kept = leaks.without_leaks(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1
    assert kept.filter("doc_id = 2 AND text IS NULL").count() == 1
    assert leaks.find_leaks(odd, bench.limit(0)).collect() == [] and leaks.find_leaks(odd.limit(0), bench).collect() == []
