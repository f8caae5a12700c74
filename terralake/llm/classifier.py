"""A quality classifier from weak labels.

Overlapping heuristics vote for good or bad quality or abstain. Expectation-maximisation over the counts
of their vote patterns estimates how often each votes what on good and on bad texts, without any true
label. The posterior of a pattern is the training label of a linear scorer over hashed words and
word shapes, which then judges every text, also where the heuristics abstain.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralake.llm.common import id_and_text, map_texts, table

GOOD, BAD, ABSTAINS = 2, 1, 0
#: Frequent short words of some languages (fixed values).
COMMON = frozenset(
    b"the of and to in a is that for it on be with as at by this have from or "
    b"der die das und ist in den von zu mit sich des auf nicht ein eine im dem als "
    b"le la les de des et un une que en du dans qui est pour par sur au avec "
    b"el los las del una por con para no se su al lo como y es".split()
)
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
MARKS = b"#*$%&|<>{}[]\\~^=_@"
#: Letters become a, digits 0, marks #, and what else ASCII has a dot; other bytes count as letters.
SHAPE = bytes(
    ord("a") if b >= 0x80 or chr(b).isalpha() else ord("0") if chr(b).isdigit() else ord("#") if b in MARKS else ord(".") for b in range(256)
)
#: Weights of the scorer, and rows that it is fitted on: about so many, of the least hashes of their ids.
SLOTS, FITTED_ROWS = 1 << 16, 10_000
THRESHOLD = 0.75


def _judged(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else ABSTAINS


def votes(text: str) -> list[int]:
    """One vote of each heuristic."""
    data = text.encode("utf-8", "replace")
    words = data.lower().split()
    n = len(words)
    if not n:
        return [BAD] + [ABSTAINS] * (LABELLERS - 1)
    size = sum(map(len, words))
    letters = data.translate(SHAPE).count(b"a")
    marks = size - sum(map(len, data.translate(None, MARKS).split()))
    upper = size - sum(map(len, data.translate(None, CAPITALS).split()))
    lines = [x.strip() for x in data.split(b"\n") if x.strip()]
    ended = sum(x[-1:] in b".!?:\"'" for x in lines)
    common = sum(w in COMMON for w in words)
    distinct = len(set(words))
    again = sum(map(eq, words, islice(words, 1, None)))
    return [
        _judged(n < 2, n >= 60),
        _judged(size < 3 * n or size > 11 * n, 3.5 * n <= size <= 9 * n),
        _judged(marks > 0.1 * n, marks <= 0.01 * n),
        _judged(letters < 0.6 * size, letters >= 0.8 * size),
        _judged(len(lines) > 3 and len(set(lines)) < 0.7 * len(lines), len(lines) > 3 and len(set(lines)) == len(lines)),
        _judged(n >= 20 and common < 0.01 * n, common >= 0.06 * n),
        _judged(n >= 20 and ended < 0.2 * len(lines), 2 * ended >= len(lines)),
        _judged(n >= 20 and distinct < n**0.7, n >= 20 and distinct >= n**0.8),
        _judged(n >= 20 and upper > 0.4 * letters, upper <= 0.2 * letters),
        _judged(n >= 20 and again > 0.1 * n, n >= 20 and again <= 0.02 * n),
    ]


LABELLERS = 10
PATTERNS = 3**LABELLERS


def pattern(text: str) -> int:
    made = 0
    for v in votes(text):
        made = 3 * made + v
    return made


def posteriors(counts: dict[int, int], steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The probability of good quality for every pattern, and P(vote | quality, does not abstain) of each labeller.

    Starts from votes for bad being rare on good texts and missing on most bad ones, as each heuristic
    looks for one fault; this also fixes which class is the good one. Both votes of every labeller are counted once more in each class, so nothing is impossible. Who
    abstains says nothing.
    """
    all_votes = np.array(np.unravel_index(np.arange(PATTERNS), (3,) * LABELLERS)).T
    weight = np.zeros(PATTERNS)
    for p, n in counts.items():
        weight[p] = n
    table_ = np.tile(np.array([[1.0, 0.2, 0.8], [1.0, 0.005, 0.995]]), (LABELLERS, 1, 1))
    prior = np.array([0.5, 0.5])
    good = np.full(PATTERNS, 0.5)
    for _ in range(steps):
        logs = np.log(prior) + sum(np.log(table_[k][:, all_votes[:, k]]).T for k in range(LABELLERS))
        now = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
        moved, good = abs(now - good).max(), now
        if moved < 1e-9 or not weight.sum():
            break
        share = np.stack([(1 - good) * weight, good * weight])
        prior = (share.sum(axis=1) + 1) / (weight.sum() + 2)
        for k in range(LABELLERS):
            for c in (0, 1):
                seen = np.bincount(all_votes[:, k], weights=share[c], minlength=3) + 1
                table_[k, c, 1:] = seen[1:] / seen[1:].sum()
    return good, table_


def features(text: str) -> tuple[list[int], list[float]]:
    """Slots and values: distinct words of one length in all, the shares of word shapes, and those of words that repeat the last one or any before."""
    in_order = text.encode("utf-8", "replace").lower().split()
    words = Counter(in_order)
    if not words:
        return [], []
    crc, mask = zlib.crc32, SLOTS - 1
    shapes: Counter = Counter()
    for w, n in words.items():
        shapes[w.translate(SHAPE)[:12]] += n
    total = len(in_order)
    shapes[b" again"] = sum(map(eq, in_order, islice(in_order, 1, None)))
    shapes[b" known"] = total - len(words)
    one = len(words) ** -0.5
    slots = [crc(w) & mask for w in words] + [crc(s, 1) & mask for s in shapes]
    return slots, [one] * len(words) + [n / total for n in shapes.values()]


@dataclass
class Model:
    """Bounded tables: a posterior for each pattern, and SLOTS weights with an intercept."""

    posterior: np.ndarray
    weights: np.ndarray
    intercept: float

    def score(self, text: str) -> float:
        slots, values = features(text)
        z = self.intercept + float(self.weights[slots] @ np.array(values, dtype=np.float32)) if slots else self.intercept
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _fitted(slots: list[np.ndarray], values: list[np.ndarray], target: np.ndarray, steps: int = 150, rate: float = 0.5, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic weights for soft labels, by accelerated gradient steps over all rows with a scale for each slot."""
    weights, intercept = np.zeros(SLOTS), 0.0
    if not len(target):
        return weights, intercept
    share = float(np.clip(target.mean(), 1e-3, 1 - 1e-3))
    intercept = float(np.log(share / (1 - share)))
    flat, value = np.concatenate(slots), np.concatenate(values)
    row = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
    scale, scale_of_intercept = np.full(SLOTS, 1e-8), 1e-8
    for _ in range(steps):
        z = intercept + np.bincount(row, weights=weights[flat] * value, minlength=len(slots))
        wrong = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        slope = np.bincount(flat, weights=wrong[row] * value, minlength=SLOTS) / len(target) + ridge * weights
        scale += slope**2
        weights -= rate * slope / np.sqrt(scale)
        scale_of_intercept += wrong.mean() ** 2
        intercept -= 0.1 * rate * wrong.mean() / scale_of_intercept**0.5
    return weights, intercept


#: The largest hash; a row is fitted if its own is within the share of all rows that are to be.
HASHES = (1 << 63) - 1


def hash_bound(total: int) -> int:
    """About FITTED_ROWS of so many rows have a hash up to this, however many there are."""
    return HASHES if total <= FITTED_ROWS else HASHES * FITTED_ROWS // total


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Votes of all rows give the posteriors; about FITTED_ROWS of the rows fit the scorer.

    The driver gets the counts of at most PATTERNS patterns and the hashed features of the fitted rows.
    Repeated rows count as often as they stand there. An empty table gives a model that scores one half.
    """
    rows = id_and_text(df, id_col, text_col)

    def make():
        return lambda texts: [pa.array([pattern(t) for t in texts], pa.int32())]

    counts = {r["pattern"]: r["n"] for r in map_texts(rows, make, "pattern int").groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    good, _ = posteriors(counts)
    total = max(1, sum(counts.values()))

    def sampled():
        def of_texts(texts: list[str]) -> list[pa.Array]:
            made = [features(t) for t in texts]
            return [
                pa.array([s for s, _ in made], pa.list_(pa.int32())), pa.array([v for _, v in made], pa.list_(pa.float32())),
                pa.array([pattern(t) for t in texts], pa.int32()),
            ]

        return of_texts

    chosen = rows.filter(F.xxhash64("id", F.crc32("text")).bitwiseAND(F.lit(HASHES)) <= hash_bound(total))
    seen = map_texts(chosen, sampled, "slots array<int>, shares array<float>, pattern int").select("slots", "shares", "pattern").toArrow()
    lists = lambda name: [np.array(x.values) for c in seen.column(name).chunks for x in c]
    weights, intercept = _fitted(lists("slots"), lists("shares"), good[seen.column("pattern").to_numpy()] if len(seen) else np.zeros(0))
    return Model(good, weights.astype(np.float32), intercept)


def classify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, posterior, score) for each row: what the votes say, and what the scorer says, both from 0 to 1.

    NULL and empty texts have the scorer's intercept. Equal texts have equal scores. Other columns are not carried.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value
        return lambda texts: [pa.array([model.posterior[pattern(t)] for t in texts], pa.float64()), pa.array([model.score(t) for t in texts], pa.float64())]

    return map_texts(id_and_text(df, id_col, text_col), make, "posterior double, score double").withColumnRenamed("id", id_col)


def op1_classifier(spark, sf_dir: str) -> DataFrame:
    """Every document's posterior and score, and whether it is kept."""
    documents = table(spark, sf_dir, "documents")
    return classify(documents, fit(documents)).withColumn("kept", F.col("score") >= THRESHOLD)
