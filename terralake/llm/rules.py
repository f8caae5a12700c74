"""Quality rules learned as a decision list, in DataFrame and SQL functions only.

Statistics of every text are Spark expressions. A list that says which texts to reject is learned by
sequential covering: a conjunction of thresholds is grown on one part of the labelled rows, pruned on
another and kept if it is right more often than wrong there; what it covers is set aside and the
next one is grown. The list becomes one conditional expression.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralake.llm.common import staged, table

#: White space is ASCII: space and the characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What rules compare, from the statistics.
MEASURES = {
    "words": "CAST(n_words AS DOUBLE)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "repeated_lines": "n_dup_lines / greatest(n_words, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
}
#: Points of each label's distribution between whose values thresholds lie: at most nine a measure.
POINTS = [0.0, 0.05, 0.5, 0.95, 1.0]
MOST_RULES, MOST_TERMS = 16, 4


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) for each row, without a shuffle.

    NULL is the empty text, of zeros. n_repeat_words counts the words in windows of three that stand
    twice or more in the text: windows are hashed to 64 bits, sorted with their places, and equal neighbours
    are compared in full. Other columns are not carried.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spaces = F.lit(SPACES)
    rows = rows.select("id", "text", F.btrim("text", spaces).alias("trimmed")).select(
        "id",
        F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", "[\\x20\\x09-\\x0D]+")).alias("words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda line: F.translate(line, SPACES, "") != "").alias("lines"),
    )
    rows = rows.select(
        "id", "word_chars", "n_symbols", F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("CASE WHEN size(words) < 3 THEN CAST(array() AS ARRAY<BIGINT>) ELSE transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) END").alias("hashes"),
    )
    # The place fills the low bits; more of them only for texts of over sixteen million words.
    bits = "CASE WHEN n_words < 16777216 THEN 24 ELSE 31 END"
    rows = rows.withColumn("bits", F.expr(bits))
    rows = rows.withColumn("sorted", F.expr("sort_array(transform(hashes, (h, i) -> shiftleft(shiftright(h, bits), bits) | CAST(i AS BIGINT)))"))
    rows = rows.withColumn("mask", F.expr("shiftleft(1L, bits) - 1"))
    # Two places to either side, so that a rare clash of the high bits does not hide an equal window.
    near = " OR ".join(f"hashes[CAST(v & mask AS INT)] = get(hashes, CAST(get(sorted, k + {d}) & mask AS INT))" for d in (-2, -1, 1, 2))
    rows = rows.withColumn("places", F.expr(f"sort_array(transform(filter(sorted, (v, k) -> coalesce({near.replace(' OR ', ', false) OR coalesce(')}, false)), v -> v & mask))"))
    covered = "aggregate(transform(places, (p, k) -> least(3L, coalesce(get(places, k + 1) - p, 3L))), 0L, (a, x) -> a + x)"
    return rows.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", F.expr(covered).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Term:
    """A measure above (or not above) a threshold; `place` is the threshold's rank among its measure's."""

    measure: str
    above: bool
    place: int
    threshold: float

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.threshold!r}"

    def column(self) -> Column:
        value = F.expr(MEASURES[self.measure])
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Term, ...]
#: Rank of each measure, whether the row is for pruning, rejected rows and kept rows.
Cell = tuple[tuple[int, ...], bool, int, int]


def holds(rule: Iterable[Term], ranks: tuple[int, ...]) -> bool:
    """A value of rank r is above the thresholds of places below r."""
    order = list(MEASURES)
    return all((ranks[order.index(t.measure)] > t.place) == t.above for t in rule)


def _covered(rule: Iterable[Term], cells: list[Cell]) -> tuple[int, int]:
    found = [c for c in cells if holds(rule, c[0])]
    return sum(c[2] for c in found), sum(c[3] for c in found)


def _grown(terms: list[Term], cells: list[Cell]) -> Rule:
    """Adds the term of the greatest information gain until none helps or no kept row is covered."""
    rule: Rule = ()
    inside = cells
    bad, good = _covered((), inside)
    while bad and good and len(rule) < MOST_TERMS:
        before = math.log2(bad / (bad + good))
        best = None
        for t in terms:
            b, g = _covered((t,), inside)
            gain = b * (math.log2(b / (b + g)) - before) if b else 0.0
            if gain > 1e-9 and (best is None or gain > best[0]):
                best = gain, t, b, g
        if best is None:
            break
        rule, bad, good = (*rule, best[1]), best[2], best[3]
        inside = [c for c in inside if holds((best[1],), c[0])]
    return rule


def _pruned(rule: Rule, cells: list[Cell]) -> Rule:
    """The shortest beginning of the rule that is most often right."""

    def worth(n: int) -> float:
        bad, good = _covered(rule[:n], cells)
        return (bad - good) / (bad + good) if bad + good else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda n: (worth(n), -n))] if rule else rule


def covering(terms: list[Term], cells: list[Cell]) -> list[Rule]:
    """Rules for rejection, in the order in which they were learned."""
    rules: list[Rule] = []
    while len(rules) < MOST_RULES:
        grow, prune = [c for c in cells if not c[1]], [c for c in cells if c[1]]
        rule = _pruned(_grown(terms, grow), prune)
        bad, good = _covered(rule, prune)
        if not rule or bad <= good:
            break
        rules.append(rule)
        cells = [c for c in cells if not holds(rule, c[0])]
    return rules


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> list[Rule]:
    """The decision list of all labelled rows that pass the base rules.

    Spark counts the labelled rows by the ranks of their measures; the driver gets the counts, at most
    4 * 10 ** 5 whatever the number of rows, and covers them. A row labelled twice has the lower label. Rows
    without an id or label are not learned from; without labels of both kinds the list is empty.
    """
    marks = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("marked")).agg((F.min(label_col) <= 0).alias("bad"))
    measured = stats.filter(~base_failed()).select(F.col(id_col).alias("marked"), *(F.expr(e).alias(m) for m, e in MEASURES.items())).join(marks, "marked")
    points = measured.groupBy("bad").agg(*(F.percentile_approx(m, POINTS, 10_000).alias(m) for m in MEASURES)).collect()
    if len(points) < 2:
        return []
    cuts = {}
    for m in MEASURES:
        values = sorted({v for row in points for v in row[m]})
        cuts[m] = [(a + b) / 2 for a, b in zip(values, values[1:])]
    ranks = [sum((F.when(F.col(m) > t, 1).otherwise(0) for t in cuts[m]), F.lit(0)).alias(m) for m in MEASURES]
    prune = (F.pmod(F.xxhash64("marked"), F.lit(3)) == 0).alias("prune")
    counts = measured.select(*ranks, prune, "bad").groupBy(*MEASURES, "prune").agg(
        F.count(F.when(F.col("bad"), 1)).alias("rejected"), F.count(F.when(~F.col("bad"), 1)).alias("kept_rows")
    ).orderBy(*MEASURES, "prune")
    cells = [(tuple(r[m] for m in MEASURES), r["prune"], r["rejected"], r["kept_rows"]) for r in counts.collect()]
    terms = [Term(m, above, place, t) for m in MEASURES for place, t in enumerate(cuts[m]) for above in (True, False)]
    return covering(terms, cells)


def verdict(rules: list[Rule]) -> Column:
    """False for what the first rule that holds rejects, true for what none holds for."""
    made = None
    for rule in rules:
        condition = F.lit(True)
        for term in rule:
            condition = condition & term.column()
        made = F.when(condition, False) if made is None else made.when(condition, False)
    return F.lit(True) if made is None else made.otherwise(True)


def op6_rules(spark, sf_dir: str) -> DataFrame:
    """Statistics of every document and whether the base rules and the learned list keep it."""
    stats = staged(statistics(table(spark, sf_dir, "documents")), "quality-statistics")
    rules = learn(stats, table(spark, sf_dir, "labels"))
    return stats.select("doc_id", *STATISTICS, base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))
