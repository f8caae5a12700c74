import brute
from test_llm_leaks import wanted as leaks_of
from test_llm_lines import picks

import corpus_pipeline
from terralake.llm import lines, toxicity
from terralake.llm.common import staged


def test_stages_equal_brute_force(spark, documents, texts):
    docs = staged(documents, "given")
    model = toxicity.fit(docs, spark.read.parquet(f"{brute.SF}/labels.parquet"))
    scores = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, model).collect()}
    left = {i: t for i, t in sorted(texts.items()) if scores[i] < toxicity.THRESHOLD}
    for (name, stage), step in zip(corpus_pipeline.STAGES, range(5)):
        made = staged(stage(spark, docs, brute.SF), "stage")
        if step == 1:
            left = brute.without_repeats(sorted(left.items()), picks(lines.NOISE, lines.SURE), lines.NOISE, lines.SURE, lines.LONG, lines.REACH)
        elif step == 2:
            group = brute.similar_classes(list(left.items()))
            left = {i: t for i, t in left.items() if group[i] == i}
        elif step == 3:
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{brute.SF}/benchmark.parquet").collect()]
            held = {d for d, _, _ in leaks_of(left.items(), items)} if len(left) * len(items) < 500 else {d for d, t in left.items() if _holds(items, t)}
            left = {i: t for i, t in left.items() if i not in held}
        if step < 4:
            assert made.columns == documents.columns
            assert {r["doc_id"]: r["text"] or "" for r in made.collect()} == left, name
            docs = made
    encoding = brute.library()
    assert {r[0]: tuple(r[1:]) for r in made.collect()} == {i: brute.token_digests(encoding, t) for i, t in left.items()}
    assert 0 < len(left) < len(texts)


def _holds(items, text):
    from terralake.llm import leaks

    plain = leaks.plain(text)
    return any(leaks.Item(k, p, leaks.RATE).nearest(plain)[0] <= int(len(p) * leaks.RATE) for k, t in items if len(p := leaks.plain(t)) >= leaks.LEAST_CHARS)


def test_odd_rows(spark, odd, documents):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, brute.SF).count() <= odd.count()
        assert stage(spark, odd.limit(0), brute.SF).count() == 0
    deduplicated = corpus_pipeline.keep_one_of_each(spark, odd, brute.SF)
    assert sorted(str(r["doc_id"]) for r in deduplicated.collect()) == ["1", "2", "5", "6", "7", "None"]


def test_run_writes_the_last_stage(spark, documents):
    assert corpus_pipeline.run(spark, brute.SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
