import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralake.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_folds_follow_the_checksum(documents):
    found = documents.select("doc_id", toxicity.fold("doc_id").alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["doc_id"]).encode()) % 4 for r in found)


def test_pieces_cover_whole_words():
    long = "ab" * 40
    assert list(toxicity.pieces(f"É_x9! {long}")) == ["^é", "^x9", "^" + long[:24], "~" + long[24:48], "~" + long[48:72], "~" + long[72:]]
    assert "".join(p[1:] for p in toxicity.pieces("x" * 1_000_000)) == "x" * 1_000_000


def test_planes_give_back_places_and_times():
    random = np.random.default_rng(5)
    for n, of in ((0, 1), (1, 1), (300, 70_000), (4_000, 2**32 - 1)):
        places = random.choice(of, n, replace=False).astype("<u4") if of < 2**31 else np.unique(random.integers(0, of, n, dtype=np.uint32))[::-1]
        times = random.geometric(0.01, len(places)).astype("<u4")
        found = toxicity.from_planes(toxicity.in_planes(places, times))
        assert dict(zip(*found.tolist())) == dict(zip(places.tolist(), times.tolist())) and (np.diff(found[0].astype(np.int64)) > 0).all()


class Plain:
    """The two models, straight from the formulas."""

    def __init__(self, texts):
        self.n = {True: collections.Counter(), False: collections.Counter()}
        for text, toxic in texts:
            for piece in set(toxicity.pieces(text)):
                whole = piece + "$"
                self.n[toxic].update(whole[: k + 1] for k in range(1, len(whole)))
        self.edges = set(self.n[True]) | set(self.n[False])
        words = {piece + "$" for text, _ in texts for piece in toxicity.pieces(text)}
        self.tails = [collections.Counter(w[: j + 1][-k:] for w in words for j in range(1, len(w))) for k in (1, 2, 3)]

    def shared(self, tail, order):
        counts = self.tails[order]
        after = {t: c for t, c in counts.items() if t[:-1] == tail[:-1]}
        lower = self.shared(tail[-order:], order - 1) if order else 1 / len(after)
        return (max(after[tail] - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(after) * lower) / sum(after.values())

    def p(self, toxic, context, letter):
        after = {e: c for e, c in self.n[toxic].items() if e[:-1] == context}
        lower = self.shared((context + letter)[-3:], 2) if context + letter in self.edges else 1.0
        if not after:
            return lower
        return (max(after.get(context + letter, 0) - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(after) * lower) / sum(after.values())

    def score(self, piece):
        whole, total = piece + "$", 0.0
        for k in range(1, len(whole)):
            if not any(e[:-1] == whole[:k] for e in self.n[True]):
                break
            total += math.log(self.p(True, whole[:k], whole[k])) - math.log(self.p(False, whole[:k], whole[k]))
            if whole[: k + 1] not in self.edges:
                break
        return total


TEXTS = [
    ("you are a grobian and a grobianist", True), ("grobian grobi, gone", True), ("йцукенгшщзхъ йцу", True), ("x" * 30, True),
    ("you are a good one and a gardener", False), ("gone to the garden", False), ("йцукенгшщзхэ", False), ("good good good", False), ("", False),
]


def test_models_equal_the_formulas(spark, documents):
    plain = Plain(TEXTS)
    edges, tails = toxicity.tables(spark.createDataFrame(TEXTS, "text string, toxic boolean"))
    begun = {e[:-1] for e in plain.n[True]}
    useful = {e for e in plain.edges if e[:-1] in begun or len(e) <= toxicity.BEGINNING}
    assert {r.gram: (r.toxic, r.ordinary) for r in edges.collect()} == {e: (plain.n[True][e], plain.n[False][e]) for e in useful}
    backoff = {r.tail: r.shared for r in toxicity.shared_backoff(tails).collect()}
    assert backoff == pytest.approx({t: plain.shared(t, 2) for t in plain.tails[2]})
    rows = toxicity.ratios(edges, tails).collect()
    scorer = toxicity.Scorer([r.gram for r in rows], [r.score for r in rows], [r.leaving for r in rows])
    words = [p for t, _ in TEXTS for p in toxicity.pieces(t)] + ["^grobianly", "^gz", "^zz", "^йцук", "^", "~q", "^garden"]
    for word in words:
        assert scorer.of(word) == pytest.approx(plain.score(word), abs=1e-4), word
    assert scorer.of("^grobian") > 1 > scorer.of("^garden") and scorer.of("^йцукенгшщзхъ") > scorer.of("^йцукенгшщзхэ")
    # Each class's letters after a context and what is left for unseen ones make one.
    for context in {e[:-1] for e in plain.n[True]}:
        seen = sum(plain.p(True, context, e[-1]) for e in plain.edges if e[:-1] == context)
        assert seen <= 1 + 1e-9


@pytest.fixture(scope="module")
def judged(spark, documents):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return toxicity.op8_toxicity(spark, SF).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()


def test_held_out_labels_of_every_language_are_found(judged):
    for lang in {r["lang"] for r in judged}:
        toxic = [r["predicted"] for r in judged if r["toxic"] == 1 and r["lang"] == lang]
        assert toxic and sum(toxic) >= 0.8 * len(toxic), lang
    assert sum(r["predicted"] == 1 and r["toxic"] == 0 for r in judged) <= 0.01 * len(judged)


def test_held_out_labels_do_not_count(spark, documents):
    """Turning every label of the held-out fold changes nothing."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.fold("doc_id") == toxicity.HELD_OUT, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert a.weights == pytest.approx(b.weights) and a.entries.exceptAll(b.entries).count() == b.entries.exceptAll(a.entries).count() == 0


def test_entries_go_to_the_ranges_packed(spark, documents, monkeypatch):
    monkeypatch.setattr(toxicity, "RANGE_ENTRIES", 1_000)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    counted = ~toxicity.fold("doc_id").isin(toxicity.HELD_OUT, toxicity.CURVE)
    entries = [(r.gram, r.score, r.leaving) for r in toxicity.ratios(*toxicity.tables(toxicity.labelled(documents, labels, "doc_id", "text", "toxic", counted))).collect()]
    model = toxicity.fit(documents, labels)
    runs = model.runs.toArrow()
    assert model.ranges >= 16 and set(runs.column("range").to_pylist()) <= set(range(model.ranges))
    held = collections.defaultdict(set)
    for k in range(runs.num_rows):
        for row in zip(*toxicity.unpacked_entries(runs.slice(k, 1))):
            held[row].add(runs.column("range")[k].as_py())
    assert len(entries) == len(set(entries)) and set(held) == set(entries)
    assert {(r.range, r.gram, r.score, r.leaving) for r in model.entries.collect()} == {(k, *row) for row, ranges in held.items() for k in ranges}
    for row, ranges in held.items():
        short = len(row[0]) < toxicity.BEGINNING
        assert ranges == (set(range(model.ranges)) if short else {zlib.crc32(row[0][: toxicity.BEGINNING].encode()) % model.ranges})
    assert toxicity.unpacked_entries(runs.slice(0, 0)) == ([], [], [])


def test_blocks_and_parts_of_any_size_give_the_same(spark, documents, monkeypatch):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = toxicity.fit(documents, labels)
    of = lambda df: sorted(map(tuple, toxicity.features(df, model, keep=[F.col("doc_id")]).collect()))
    whole = of(documents)
    monkeypatch.setattr(toxicity, "SCORED_WORDS", 50)
    assert of(documents.repartition(11)) == whole
    top = documents.filter("text IS NOT NULL").first()
    assert len(set(toxicity.pieces(top.text))) > 4


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (None, 1), (6, None), (7, 0), (2, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    made = toxicity.score(odd, model)
    rows = made.collect()
    assert sorted(made.columns) == sorted(odd.columns) and len(rows) == odd.count()
    assert all(0 <= r["toxicity"] <= 1 for r in rows) and len({r["toxicity"] for r in rows if not (r["text"] or "").strip()}) == 1
    assert toxicity.without_toxic(odd, model, threshold=2.0).count() == len(rows) and toxicity.without_toxic(odd, model, threshold=0.0).count() == 0
    empty = toxicity.fit(odd.limit(0), labels.limit(0))
    assert len({r["toxicity"] for r in toxicity.score(odd, empty).collect()}) == 1
    assert toxicity.score(odd.limit(0), model).collect() == []
