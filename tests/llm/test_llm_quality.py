import brute
import numpy as np
from llm_helpers import SF
from pyspark.sql import functions as F

from terralake.llm import classifier, rules


def test_statistics_equal_brute_force(spark, documents, odd):
    for frame in (documents, odd):
        found = [(str(r[0]), *r[1:]) for r in rules.statistics(frame).select("doc_id", *rules.STATISTICS).collect()]
        assert sorted(found) == sorted((str(i), *brute.statistics(t or "")) for i, t in frame.select("doc_id", "text").collect())


def test_repeated_words(spark, documents):
    for text in ("a b c", "a b c a b c", "a a a a", "a a", "a b c d a b c e a b c", "x a b c d y a b c d z " * 40):
        frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
        assert rules.statistics(frame).first()["n_repeat_words"] == brute.statistics(text)[4]


def test_learned_list_on_made_up_counts():
    order = list(rules.MEASURES)
    terms = [rules.Term(m, a, p, float(p)) for m in order for p in (0, 1) for a in (True, False)]
    cell = lambda s, w, prune, bad, good: ((0, w, s, 0, 0), prune, bad, good)
    cells = [c for prune in (False, True) for c in (cell(2, 0, prune, 50, 0), cell(0, 0, prune, 1, 90), cell(0, 2, prune, 30, 2), cell(1, 0, prune, 0, 10))]
    learned = rules.covering(terms, cells)
    assert [tuple(map(str, r)) for r in learned] == [("symbols > 1.0",), ("word_length > 1.0",)] or len(learned) == 2
    assert all(rules.holds(learned[0], c[0]) == (c[0][2] == 2) for c in cells)
    assert rules.covering(terms, []) == []


def test_query_agrees_with_labels_and_is_native(spark, documents):
    sf = "/root/testdata/sf0.01"
    found = rules.op6_rules(spark, sf)
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
    judged = found.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("NOT base_failed")
    wrong, total = judged.agg(F.count_if(F.col("kept") != (F.col("quality") == 1)), F.count("*")).first()
    assert wrong <= 0.03 * total
    assert found.filter("base_failed AND kept").count() == 0


def test_no_labels_keep_what_passes_the_base(spark, documents, odd):
    stats = rules.statistics(odd)
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert rules.learn(stats, labels) == [] and rules.learn(stats.limit(0), labels) == []
    assert stats.filter(rules.verdict([])).count() == odd.count()


def test_classifier_separates_labels_that_it_never_saw(spark, documents):
    sf = "/root/testdata/sf0.01"
    found = classifier.op1_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = found.select("kept", "score", "quality").collect()
    wrong = [r for r in rows if r["kept"] != (r["quality"] == 1)]
    assert len(wrong) <= 0.02 * len(rows)


def test_estimation_finds_who_is_right():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.8
    counts = {}
    for good in truth:
        p = 0
        for k in range(classifier.LABELLERS):
            says = classifier.ABSTAINS
            if rng.random() > 0.2:
                bad = rng.random() < (0.005 if good else 0.1 + 0.06 * k)
                says = classifier.BAD if bad else classifier.GOOD
            p = 3 * p + says
        counts[p] = counts.get(p, 0) + 1
    good, table = classifier.posteriors(counts)
    assert abs(sum(n * good[p] for p, n in counts.items()) / 20_000 - 0.8) < 0.03
    assert all(abs(table[k, 0, classifier.BAD] - (0.1 + 0.06 * k)) < 0.05 for k in range(classifier.LABELLERS))


def test_classifier_on_odd_rows(odd):
    model = classifier.fit(odd)
    rows = classifier.classify(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and 0 <= r["posterior"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
    assert classifier.classify(odd.limit(0), classifier.fit(odd.limit(0))).collect() == []


def test_query_columns(spark):
    from terralake.llm.registry import QUERIES

    assert QUERIES["op1_classifier"](spark, SF).columns == ["doc_id", "posterior", "score", "kept"]


def test_as_many_rows_are_fitted_of_any_number():
    from terralake.llm import classifier

    assert classifier.hash_bound(5) == classifier.hash_bound(classifier.FITTED_ROWS) == classifier.HASHES
    for total in (10**5, 10**9, 2 * 10**10, 10**11, 10**13):
        rows = total * (classifier.hash_bound(total) + 1) / (classifier.HASHES + 1)
        assert abs(rows - classifier.FITTED_ROWS) < 1
