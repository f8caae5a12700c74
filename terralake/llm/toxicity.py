"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Two models, one of toxic and one of ordinary texts, give the probability of each letter of a word after all letters before
it. Both back off to the same distribution: how many words, of either class, go on with a letter after its last two, one
or none. So a rare expression takes the same probability in both but for what its own class has seen, and what no toxic
text begins is left to the shared counts altogether. A word is scored by the difference of its two log-likelihoods, a text by its highest
words and by the difference a letter over all of it; a logistic curve fitted on a fold that the models have not counted turns this into a
probability.

The models are tables that Spark makes and keeps in the shared folder, and they grow with the vocabulary. To score, blocks of texts send
each distinct word once to the range of beginnings it belongs to, and the scores come back to the block.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralake.llm.common import discard, in_steps, staged, table, unused

#: What is taken off every count for what has not been seen; near one, since what a single toxic text holds says little.
DISCOUNT = 0.95
#: Letters of the shared contexts.
SHARED = 2
#: Words longer than this go on as a piece of their own; marks of a word's start, of a later piece's, and of an end.
PIECE_LETTERS, START, FURTHER, END = 24, "^", "~", "$"
WORD = re.compile(r"[^\W_]+")
#: Remainders of ids: the curve is fitted on CURVE, HELD_OUT is never learned from, and the models count the others.
FOLDS, HELD_OUT, CURVE = 4, 2, 3
#: Counts that a task holds at once; beyond that it begins anew.
HELD_COUNTS = 300_000
#: Labelled rows that the curve is fitted on, those of the least hashes.
CURVE_ROWS = 20_000
#: Letters, the mark included, by which words are dealt out; beginnings that are shorter go everywhere. Entries of a range, about; words of a range that a task scores.
BEGINNING, RANGE_ENTRIES, SCORED_WORDS = 5, 200_000, 1 << 20
#: Letters and texts of a block.
BLOCK_CHARS, BLOCK_DOCS = 4_000_000, 1 << 16
FEATURES = ["f_first", "f_second", "f_four", "f_mean"]
THRESHOLD = 0.3
LEVEL, PACKED_LEVEL, WORDS_LEVEL = 1, 3, 9


def fold(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS


def pieces(text: str) -> Iterator[str]:
    """Words in lower case after their mark, long ones in pieces."""
    for word in WORD.findall(text.lower()):
        if len(word) <= PIECE_LETTERS:
            yield START + word
        else:
            for at in range(0, len(word), PIECE_LETTERS):
                yield (FURTHER if at else START) + word[at : at + PIECE_LETTERS]


def labelled(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, which: Column, few: bool = False) -> DataFrame:
    """(text, toxic) of the rows with a label in the folds if there are but few labels, else (pieces, toxic), each text's distinct pieces packed; a row
    labelled twice is toxic if any label says so."""
    marks = labels.filter(F.col(label_col).isNotNull() & which).groupBy(F.col(id_col).alias("marked")).agg((F.max(label_col) > 0).alias("toxic"))
    texts = df.filter(F.col(text_col).isNotNull() & which).select(F.col(id_col).alias("marked"), F.col(text_col).cast("string").alias("text"))
    # A sort-merge join at every size, as the labels grow with the texts; but for at most CURVE_ROWS labels the texts need not be shuffled.
    return texts.join(F.broadcast(marks), "marked") if few else _packed(texts).join(marks.hint("merge"), "marked")


def _packed(texts: DataFrame) -> DataFrame:
    """The rows with the distinct pieces of their text in place of it, in order and compressed."""
    others = [f for f in texts.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=PACKED_LEVEL).compress
        for step in in_steps(batches):
            packed = [pack("\n".join(sorted(set(pieces(text)))).encode("utf-8", "replace")) for text in step.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(step.column(f.name) for f in others), pa.array(packed, pa.binary())], names=[*(f.name for f in others), "pieces"])

    return texts.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in others), "pieces binary"]))


COUNTS = "gram string, toxic long, ordinary long"


def _counts(held: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
    """What is held, as rows; it begins anew."""
    for kind, found in enumerate(held):
        counts, none = pa.array(list(found.values()), pa.int64()), pa.array(np.zeros(len(found), dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), counts if kind else none, none if kind else counts], names=["gram", "toxic", "ordinary"])
        found.clear()


def _count_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each class that hold a piece, as a task meets them."""
    held: tuple[Counter, Counter] = (Counter(), Counter())
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for packed, y in zip(batch.column("pieces"), batch.column("toxic").to_pylist()):
            held[y].update(filter(None, unpack(packed.as_py()).decode().split("\n")))
            if len(held[0]) + len(held[1]) > HELD_COUNTS:
                yield from _counts(held)
    yield from _counts(held)


def _count_tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each letter stands after the SHARED letters before it (fewer at the start), over distinct pieces."""
    held: Counter = Counter()

    def made():
        batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["tail", "n"])
        held.clear()
        return batch

    for batch in batches:
        for piece in batch.column("gram").to_pylist():
            whole = piece + END
            held.update(whole[max(0, k - SHARED) : k + 1] for k in range(1, len(whole)))
        if len(held) > HELD_COUNTS:
            yield made()
    yield made()


def _count_edges(words: pa.Table) -> pa.Table:
    """Counts of beginnings, each a context and the letter after it, over the pieces of a range: short ones, and those whose context a toxic text has."""
    held: tuple[Counter, Counter] = (Counter(), Counter())
    rows = list(zip(*(words.column(c).to_pylist() for c in ("gram", "toxic", "ordinary"))))
    for piece, toxic, _ in rows:
        if toxic:
            whole = piece + END
            for k in range(2, len(whole) + 1):
                held[1][whole[:k]] += toxic
    known = {gram[:-1] for gram in held[1]}
    for piece, _, ordinary in rows:
        if ordinary:
            whole = piece + END
            for k in range(2, len(whole) + 1):
                if k > BEGINNING and whole[: k - 1] not in known:
                    break
                held[0][whole[:k]] += ordinary
    grams = list(held[0].keys() | held[1].keys())
    return pa.table({"gram": pa.array(grams, pa.string())} | {n: pa.array([held[y][g] for g in grams], pa.int64()) for n, y in (("toxic", 1), ("ordinary", 0))})


def shared_backoff(tails: DataFrame) -> DataFrame:
    """(tail, shared) from (tail, n): P(letter | the last SHARED letters of the context) for every tail of context and letter.

    Counts are of distinct words, of either class, that hold the tail, discounted, with the rest given to the tail that is a letter shorter; at
    the end stands one part for each letter there is. There are as many rows as sequences of three letters.
    """
    below = None
    for order in range(SHARED + 1):
        counts = tails.groupBy(F.right("tail", F.lit(order + 1)).alias("tail")).agg(F.sum("n").alias("n"))
        counts = counts.withColumn("context", F.expr("left(tail, char_length(tail) - 1)"))
        totals = counts.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        if below is None:
            counts = counts.join(totals, "context").withColumn("lower", 1 / F.col("kinds"))
        else:
            shorter = below.select(F.col("tail").alias("shorter"), F.col("shared").alias("lower"))
            counts = counts.join(totals, "context").withColumn("shorter", F.right("tail", F.lit(order))).join(shorter, "shorter")
        below = counts.select("tail", _interpolated(F.col("n"), F.col("total"), F.col("kinds"), F.col("lower")).alias("shared"))
    return below


def _interpolated(n: Column, total: Column, kinds: Column, lower: Column) -> Column:
    """A discounted count with the rest given to the lower order."""
    return (F.greatest(n - DISCOUNT, F.lit(0.0)) + DISCOUNT * kinds * lower) / total


def ratios(edges: DataFrame, tails: DataFrame) -> DataFrame:
    """(gram, score, leaving): after a context that toxic texts have, how much a letter speaks for them, and how much any letter that has not been seen there does.

    Rows with a score are contexts with their letter, rows with `leaving` are contexts. Log of P(toxic) over P(ordinary); a class that does not have
    the context takes the shared distribution.
    """
    edges = edges.withColumn("context", F.expr("left(gram, char_length(gram) - 1)")).withColumn("tail", F.right("gram", F.lit(SHARED + 1)))
    contexts = edges.groupBy("context").agg(
        F.sum("toxic").alias("t_total"), F.sum("ordinary").alias("o_total"), F.count_if(F.col("toxic") > 0).alias("t_kinds"), F.count_if(F.col("ordinary") > 0).alias("o_kinds")
    ).filter("t_total > 0")
    shared = F.col("shared")
    of = lambda c: _interpolated(F.col(c), F.col(f"{c[0]}_total"), F.col(f"{c[0]}_kinds"), shared)
    known = F.col("o_total") > 0
    scored = edges.join(contexts, "context").join(shared_backoff(tails), "tail")
    score = F.ln(of("toxic")) - F.when(known, F.ln(of("ordinary"))).otherwise(F.ln(shared))
    leaving = F.ln(DISCOUNT * F.col("t_kinds") / F.col("t_total")) - F.when(known, F.ln(DISCOUNT * F.col("o_kinds") / F.col("o_total"))).otherwise(0.0)
    none = F.lit(None).cast("float")
    return scored.select("gram", score.cast("float").alias("score"), none.alias("leaving")).union(contexts.select("context", none, leaving.cast("float")))


@dataclass
class Model:
    """The written table of entries, packed as `runs` of one range each, the number of ranges, and the weights of the curve."""

    runs: DataFrame
    ranges: int
    weights: list[float]

    @property
    def entries(self) -> DataFrame:
        """(range, gram, score, leaving), unpacked."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    grams, scores, leaving = unpacked_entries(batch.slice(k, 1))
                    columns = [pa.array([batch.column("range")[k].as_py()] * len(grams), pa.int32()), pa.array(grams, pa.string()), pa.array(scores, pa.float32()), pa.array(leaving, pa.float32())]
                    yield pa.RecordBatch.from_arrays(columns, names=["range", "gram", "score", "leaving"])

        return self.runs.mapInArrow(run, "range int, gram string, score float, leaving float")

    def score(self) -> Column:
        """The probability as a function of the columns FEATURES."""
        z = reduce(lambda a, b: a + b, (F.col(c) * float(w) for c, w in zip(FEATURES, self.weights[1:])), F.lit(float(self.weights[0])))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


RUNS = "range int, grams binary, scores binary, contexts binary, leavings binary"


def _packed_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries as runs of one range each, as a task meets them: letters with their scores, and contexts with what leaving them counts, both in ascending order."""
    pack = zstandard.ZstdCompressor(level=PACKED_LEVEL).compress

    def made() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).sort_by([("range", "ascending"), ("gram", "ascending")])
        ranges, grams = rows.column("range").to_numpy(), rows.column("gram").to_pylist()
        cuts = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(grams)] if grams else [0]
        packed: list[list[bytes]] = []
        for kind in ("score", "leaving"):
            known, values = rows.column(kind).is_valid().to_numpy(), rows.column(kind).to_numpy().astype("<f4")
            of = [np.arange(a, b)[known[a:b]] for a, b in zip(cuts, cuts[1:])]
            packed += [[pack("\n".join([grams[k] for k in own]).encode()) for own in of], [pack(planes(values[own])) for own in of]]
        columns = [pa.array(ranges[cuts[:-1]], pa.int32()), *(pa.array(c, pa.binary()) for c in packed)]
        return pa.RecordBatch.from_arrays(columns, names=["range", "grams", "scores", "contexts", "leavings"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) > HELD_COUNTS:
            yield made()
            held = []
    if held:
        yield made()


def unpacked_entries(runs: pa.Table | pa.RecordBatch) -> tuple[list[str], list[float | None], list[float | None]]:
    """The beginnings, scores and leavings of some runs."""
    unpack = zstandard.ZstdDecompressor().decompress
    grams: list[str] = []
    scores: list[float | None] = []
    leaving: list[float | None] = []
    for names, values, own, other in (("grams", "scores", scores, leaving), ("contexts", "leavings", leaving, scores)):
        for text, packed in zip(runs.column(names), runs.column(values)):
            found = of_planes(unpack(packed.as_py()), "<f4").tolist()
            grams += unpack(text.as_py()).decode().split("\n") if found else []
            own += found
            other += [None] * len(found)
    return grams, scores, leaving


class Scorer:
    """Sums the scores of a piece's letters, as far as toxic texts have begun like it."""

    def __init__(self, grams: Sequence[str], scores: Sequence[float | None], leaving: Sequence[float | None]):
        self.scores = {g: s for g, s in zip(grams, scores) if s is not None}
        self.leaving = {g: x for g, x in zip(grams, leaving) if x is not None}
        self.known: dict[str, float] = {}

    def of(self, piece: str) -> float:
        if piece not in self.known:
            if len(self.known) > HELD_COUNTS:
                self.known = {}
            whole, total = piece + END, 0.0
            for k in range(2, len(whole) + 1):
                step = self.scores.get(whole[:k])
                if step is None:
                    total += self.leaving.get(whole[: k - 1], 0.0)
                    break
                total += step
            self.known[piece] = total
        return self.known[piece]


def range_of(piece: str, ranges: int) -> int:
    return zlib.crc32((piece + END)[:BEGINNING].encode("utf-8", "replace")) % ranges


def planes(numbers: np.ndarray) -> bytes:
    """Numbers of four bytes, the lowest bytes of all of them first, then the next higher ones, so that like bytes lie together."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 4).T.tobytes()


def of_planes(packed: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, dtype=np.uint8).reshape(4, -1).T).view(kind).ravel()


def in_planes(places: np.ndarray, times: np.ndarray) -> bytes:
    """Distinct places in ascending order as steps from one to the next, and how often each is met."""
    order = np.argsort(places)
    return planes(np.concatenate([np.diff(places[order], prepend=np.uint32(0)), times[order]]).astype("<u4"))


def from_planes(packed: bytes) -> np.ndarray:
    """The places, ascending, and their times."""
    steps, times = of_planes(packed, "<u4").reshape(2, -1)
    return np.stack([np.cumsum(steps, dtype=np.uint32), times])


class _Block:
    """Texts of a task, one after another, with their distinct pieces."""

    def __init__(self, number: int):
        self.number, self.chars = number, 0
        self.places: dict[str, int] = {}
        self.docs: list[tuple[int, bytes]] = []

    def add(self, text: str, pack) -> None:
        found = Counter(pieces(text))
        at = np.array([self.places.setdefault(p, len(self.places)) for p in found], dtype="<u4")
        times = np.array(list(found.values()), dtype="<u4")
        letters = sum((len(p) - 1) * n for p, n in found.items())
        self.docs.append((letters, pack(in_planes(at, times))))
        self.chars += len(text)

    def full(self) -> bool:
        return self.chars >= BLOCK_CHARS or len(self.docs) >= BLOCK_DOCS

    def runs(self, ranges: int, pack) -> list[tuple[int, int, bytes, bytes]]:
        """(range, pieces, their texts, their places as steps) for each range; places ascend."""
        held: dict[int, tuple[list[str], list[int]]] = {}
        for piece, place in self.places.items():
            texts, places = held.setdefault(range_of(piece, ranges), ([], []))
            texts.append(piece)
            places.append(place)
        pack_words = zstandard.ZstdCompressor(level=WORDS_LEVEL).compress
        return [(r, len(t), pack_words("\n".join(t).encode("utf-8", "replace")), pack(planes(np.diff(np.array(p, dtype="<u4"), prepend=np.uint32(0))))) for r, (t, p) in held.items()]


def _coded(df: DataFrame, text_col: str, keep: Sequence[Column], ranges: int) -> DataFrame:
    """Texts as numbers of their pieces, and the pieces of each block by range; `range` is NULL for texts. A block's number is that of its first row."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")
    rows = df.select(text, F.struct(F.lit(0).alias("_"), *keep).alias("keep"), F.monotonically_increasing_id().alias("row"))
    kept = rows.schema["keep"].dataType.simpleString()
    fields = f"block long, keep {kept}, letters long, pieces binary, range int, n long, words binary, places binary"
    names = ["block", "keep", "letters", "pieces", "range", "n", "words", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        block: _Block | None = None
        kind = None

        def documents(docs: list, keep: pa.Array) -> pa.RecordBatch:
            n = len(docs)
            columns = [pa.array([block.number] * n, pa.int64()), keep, pa.array([x for x, _ in docs], pa.int64()), pa.array([p for _, p in docs], pa.binary())]
            return pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=names)

        def settled() -> pa.RecordBatch:
            found = block.runs(ranges, pack)
            n = len(found)
            columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))] or [pa.nulls(0, t) for t in (pa.int32(), pa.int64(), pa.binary(), pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([block.number] * n, pa.int64()), pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), *columns], names=names)

        for step in in_steps(batches):
            kind = step.column("keep").type
            numbers = step.column("row")
            start = 0
            for at, text in enumerate(step.column("text").to_pylist()):
                block = block or _Block(numbers[at].as_py())
                block.add(text, pack)
                if block.full():
                    yield documents(block.docs[start - at - 1 :], step.column("keep").slice(start, at + 1 - start))
                    yield settled()
                    block, start = None, at + 1
            if start < step.num_rows:
                yield documents(block.docs[start - step.num_rows :], step.column("keep").slice(start))
        if block:
            yield settled()

    return rows.mapInArrow(run, fields)


def _scored(runs: pa.Table, entries: pa.Table) -> pa.Table:
    """Scores of the pieces of some runs, by the packed entries of their range."""
    scorer = Scorer(*unpacked_entries(entries))
    unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=LEVEL).compress
    scores = [pack(planes(np.array([scorer.of(p) for p in unpack(w.as_py()).decode().split("\n")], dtype="<f4"))) for w in runs.column("words")]
    return pa.table({"block": runs.column("block"), "places": runs.column("places"), "scores": pa.array(scores, pa.binary())})


def _featured(docs: pa.Table, scores: pa.Table) -> pa.Table:
    """Features of the texts of a block."""
    unpack = zstandard.ZstdDecompressor().decompress
    runs = [(np.cumsum(of_planes(unpack(p.as_py()), "<u4"), dtype=np.uint32), of_planes(unpack(s.as_py()), "<f4")) for p, s in zip(scores.column("places"), scores.column("scores"))]
    score = np.zeros(sum(len(places) for places, _ in runs), dtype=np.float64)
    for places, values in runs:
        score[places] = values
    made = np.zeros((docs.num_rows, len(FEATURES)))
    for k, (letters, packed) in enumerate(zip(docs.column("letters").to_pylist(), docs.column("pieces"))):
        if letters:
            at, times = from_planes(unpack(packed.as_py()))
            own = score[at]
            top = np.zeros(4)
            best = np.sort(own)[-4:][::-1]
            top[: len(best)] = best
            made[k] = top[0], top[1], top.mean(), own @ times / letters
    return pa.table({"keep": docs.column("keep")} | {c: pa.array(made[:, k]) for k, c in enumerate(FEATURES)})


def features(df: DataFrame, model: Model, text_col: str = "text", keep: Sequence[Column] = ()) -> DataFrame:
    """(the columns in `keep`, FEATURES) of each row: the highest, the second and the mean of the four highest log-likelihood differences of
    distinct words, zero where there are fewer, and the difference a letter of the whole text. Empty texts have zeros.

    Texts are read once; blocks of them send their distinct words to the ranges of the model. Ranges with more words than a task takes are dealt out by block.
    """
    coded = staged(_coded(df, text_col, keep, model.ranges), "toxicity-coded")
    docs = coded.filter("range IS NULL").select("block", "keep", "letters", "pieces")
    runs = coded.filter("range IS NOT NULL").select("block", "range", "n", "words", "places")
    many = runs.groupBy("range").agg(F.ceil(F.sum("n") / SCORED_WORDS).cast("int").alias("parts"))
    dealt = runs.join(many, "range").withColumn("part", F.pmod(F.xxhash64("block"), F.col("parts")).cast("int")).select("block", "range", "part", "words", "places")
    copied = model.runs.join(many, "range").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    scored = dealt.groupBy("range", "part").cogroup(copied.groupBy("range", "part")).applyInArrow(_scored, "block long, places binary, scores binary")
    kept = docs.schema["keep"].dataType
    found = docs.groupBy("block").cogroup(scored.groupBy("block")).applyInArrow(
        _featured, f"keep {kept.simpleString()}, {', '.join(f'{c} double' for c in FEATURES)}"
    )
    return found.select(*(F.col(f"keep.{n}").alias(n) for n in kept.names if n != "_"), *FEATURES)


def fitted(features: np.ndarray, toxic: np.ndarray, ridge: float = 0.05, steps: int = 50) -> np.ndarray:
    """Weights of a logistic curve by Newton's method; a constant, the share of toxic rows, if one kind is missing."""
    share = toxic.mean() if len(toxic) else 0.0
    if share in (0.0, 1.0):
        return np.array([30.0 if share else -30.0])
    x = np.hstack([np.ones((len(features), 1)), features])
    weights, penalty = np.zeros(x.shape[1]), ridge * np.diag([0.0] + [1] * features.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (toxic - p) - penalty @ weights
        bend = (x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(x.shape[1])
        move = np.linalg.solve(bend, slope)
        weights += move
        if abs(move).max() < 1e-8:
            break
    return weights


def tables(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, toxic, ordinary) and (tail, n) over labelled texts, or their packed pieces, written: of beginnings of words, in how many of each class's texts words go on like them; and of letters
    after two others, in how many words they stand. Beginnings that go on where no toxic text does are left out, their letters are not scored."""
    sums = F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")
    packed = texts if "pieces" in texts.columns else _packed(texts)
    words = staged(packed.mapInArrow(_count_pieces, COUNTS).groupBy("gram").agg(*sums), "toxicity-words")
    tails = staged(words.mapInArrow(_count_tails, "tail string, n long").groupBy("tail").agg(F.sum("n").alias("n")), "toxicity-tails")
    ranges = max(16, -(-words.count() // RANGE_ENTRIES))
    # Words of one beginning, the end mark counted as in `range_of`, are in one range.
    dealt = words.withColumn("range", F.crc32(F.left(F.concat("gram", F.lit(END)), F.lit(BEGINNING))) % ranges)
    edges = staged(dealt.groupBy("range").applyInArrow(_count_edges, COUNTS).groupBy("gram").agg(*sums), "toxicity-edges")
    discard(words)
    return edges, tails


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model of the labelled rows outside the held-out fold.

    All labelled texts of the counted folds are counted, whole; very long ones like others, in steps. The driver gets counts of rows, and four numbers for each of at most CURVE_ROWS
    rows, on which the curve is fitted. A row labelled twice is toxic if any label says so. Repeated rows count as often as they stand there. Rows
    with NULL ids, texts or labels are not learned from. Without labels of both kinds, or without rows, every score is the share of toxic ones.
    """
    edges, tails = tables(labelled(df, labels, id_col, text_col, label_col, ~fold(id_col).isin(HELD_OUT, CURVE)))
    entries = staged(ratios(edges, tails), "toxicity-ratios")
    discard(edges, tails)
    ranges = max(16, -(-entries.count() // RANGE_ENTRIES))
    every = F.sequence(F.lit(0), F.lit(ranges - 1))
    where = F.when(F.char_length("gram") < BEGINNING, every).otherwise(F.array((F.crc32(F.left("gram", F.lit(BEGINNING))) % ranges).cast("int")))
    dealt = entries.select(F.explode(where).alias("range"), "gram", "score", "leaving")
    model = Model(staged(dealt.mapInArrow(_packed_entries, RUNS), "toxicity-runs"), ranges, [0.0])
    discard(entries)
    chosen = labels.filter(F.col(label_col).isNotNull() & (fold(id_col) == CURVE)).orderBy(F.xxhash64(id_col), id_col, label_col).limit(CURVE_ROWS)
    sample = labelled(df, chosen, id_col, text_col, label_col, fold(id_col) == CURVE, few=True)
    seen = features(sample, model, keep=[F.col("toxic").cast("int").alias("toxic")]).toArrow()
    columns = np.column_stack([seen.column(c).to_numpy() for c in FEATURES]) if len(seen) else np.zeros((0, len(FEATURES)))
    model.weights = fitted(columns, seen.column("toxic").to_numpy().astype(np.float64)).tolist()
    return model


def _keys(text_col: str) -> list[Column]:
    """Two hashes of a text; equal texts have equal scores, so these stand for rows."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("key_1"), F.xxhash64(F.lit("second"), text).alias("key_2")]


def score(df: DataFrame, model: Model, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """The rows with the probability that their text is toxic, from 0 to 1.

    Only the text counts; equal texts, repeated rows included, have equal scores. NULL and empty texts have the score of a text without evidence. Very long texts
    are scored whole. A column of that name is replaced; all others are kept. An empty table gives no rows.
    """
    scored = features(df, model, text_col, _keys(text_col)).select("key_1", "key_2", model.score().alias("score")).groupBy("key_1", "key_2").agg(F.max("score").alias("score"))
    rows = df.drop(out_col)
    one, two = (unused(rows, n) for n in ("key_1", "key_2"))
    keyed = rows.withColumns(dict(zip((one, two), _keys(text_col))))
    return keyed.join(scored.select(F.col("key_1").alias(one), F.col("key_2").alias(two), F.col("score").alias(out_col)), [one, two]).drop(one, two)


def without_toxic(df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores below the threshold, all columns as they are. Texts are not shuffled unless very many are rejected."""
    found = features(df, model, text_col, _keys(text_col)).filter(model.score() >= threshold)
    one, two = (unused(df, n) for n in ("key_1", "key_2"))
    rejected = staged(found.select(F.col("key_1").alias(one), F.col("key_2").alias(two)).distinct(), "toxicity-rejected")
    return df.withColumns(dict(zip((one, two), _keys(text_col)))).join(rejected, [one, two], "left_anti").drop(one, two)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's score, the held-out fold marked."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(documents, labels)
    found = features(documents, model, keep=[F.col("doc_id")]).select("doc_id", model.score().alias("score"))
    return found.select("doc_id", (fold("doc_id") == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
