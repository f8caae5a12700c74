import random

import brute

from terralake.llm import lines


def picks(noise, sure):
    def selected(text):
        found = lines.Grams([text], noise, sure)
        return {i for i, s in enumerate(found.selected.tolist()) if s}

    return selected


def made_up(rng, n_docs):
    pool = [" ".join(rng.choice(["ra", "bo", "ke", "lu", "mi", "zo"]) + str(rng.randint(0, 30)) for _ in range(rng.randint(1, 9))) + "." for _ in range(60)]
    passage = pool[:6]
    docs = []
    for i in range(n_docs):
        parts = [rng.choice(pool) + ("" if rng.random() < 0.5 else str(i)) for _ in range(rng.randint(0, 25))]
        if rng.random() < 0.5:
            at = rng.randint(0, len(parts))
            parts[at:at] = passage[rng.randint(0, 1) :]
        docs.append((i, "".join(p + rng.choice(["\n", " ", "\n\n", "  "]) for p in parts)))
    return docs


def test_equals_brute_force(spark, documents):
    rng = random.Random(5)
    docs = made_up(rng, 60) + [(100, "a b c d e.\n" * 30), (101, "a b c d e.\n" * 30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for noise, sure in ((6, 12), (20, 40), (lines.NOISE, lines.SURE)):
        found = {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(frame, noise=noise, sure=sure).collect()}
        assert found == brute.without_repeats(docs, picks(noise, sure), noise, sure, lines.LONG, lines.REACH)


def test_equals_brute_force_on_the_table(spark, documents, texts):
    found = {r["doc_id"]: r["text"] for r in lines.op7_lines(spark, brute.SF).collect()}
    assert found == brute.without_repeats(sorted(texts.items()), picks(lines.NOISE, lines.SURE), lines.NOISE, lines.SURE, lines.LONG, lines.REACH)


def test_every_sure_passage_goes(spark, documents):
    """A passage of whole sentences, alone on lines or inside them, stays where it stands first."""
    passage = " ".join(f"The {w} of number {k} went to the {w} again and again." for k, w in enumerate("sea hill road town".split()))
    docs = [(k, f"Own words number {k} here.\nAnd more of {k}. {passage} End of {k}." if k % 2 else f"Start {k}\n{passage}\nOther end {k}") for k in range(40)]
    found = {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found[0] == docs[0][1]
    assert all(passage[:40] not in found[k] and f"{k}" in found[k] for k in range(1, 40))
    clean = [(k, " ".join(f"w{k}_{j}" + "." * (j % 7 == 6) for j in range(200))) for k in range(20)]
    kept = {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(spark.createDataFrame(clean, "doc_id long, text string")).collect()}
    assert kept == dict(clean)


def test_passages_inside_sentences_go(spark, documents):
    """Passages of 51 and more words between other words of one line, with and without sentence marks, lose all but their ends."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    few = [word() for _ in range(12)]
    docs, inside = [], {}
    for size in (51, 60, 80):
        for k in range(20):
            passage = [rng.choice(few) if k % 4 == 3 else word() for _ in range(size)]
            if k % 2:
                passage = [w + "." * (i % 12 == 11) for i, w in enumerate(passage)]
            for _ in range(2):
                around = [[word() for _ in range(rng.randint(0, 30))] for _ in range(2)]
                inside[len(docs)] = passage, around
                docs.append((len(docs), " ".join(around[0] + passage + around[1])))
    found = {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    for i, (passage, (before, after)) in inside.items():
        left = found[i].split()
        if i % 2 == 0:
            assert found[i] == docs[i][1]
        else:
            assert left[: len(before)] == before and left[len(left) - len(after) :] == after
            assert len(left) - len(before) - len(after) <= 2 * lines.LONG


def test_a_run_takes_one_separator_along(spark, documents):
    passage = " ".join(f"word{k}" for k in range(60)) + "."
    docs = [(0, passage), (1, f"Before it.  {passage}\nNext line"), (2, f"First\n\n{passage}\n\nLast"), (3, passage), (4, f"é\u00a0ü. {passage} ß")]
    found = {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [found[i] for i in range(5)] == [passage, "Before it.\nNext line", "First\n\nLast", "", "é\u00a0ü. ß"]


def test_odd_rows(odd):
    made = lines.drop_repeated_lines(odd)
    assert made.columns == [c for c in odd.columns if c not in ("lines", "removed_lines")] + ["lines", "removed_lines"]
    rows = made.collect()
    assert len(rows) == odd.count() and all(r["text"] is not None and r["fp"] == "clash" for r in rows)
    assert [r["text"] for r in rows if r["doc_id"] == 1] == ["alpha beta gamma delta. epsilon zeta\neta theta"] * 2
    assert lines.drop_repeated_lines(odd.limit(0)).collect() == []
