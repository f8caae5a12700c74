"""Repeated passages over lines and pieces of lines, found by winnowing and deleted where they come later.

Lines are cut at line ends and after sentences, and sentences of more than LONG words into pieces at
words that their neighbours decide on: of every REACH words in a row the one of least hash begins a
piece. Two texts that share a passage therefore cut it alike but for its ends. A gram is a stretch
of pieces with at least NOISE words. Of the grams of every stretch with at least SURE words the one
with the least hash is selected, so two documents that share such a stretch select the same gram.
Selected grams are joined on their hash; a match with an earlier place is extended to both sides for
as long as the next gram also stands at an earlier place, in any document where a shared selected
gram stands first. What a run covers is deleted from the later document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralake.llm.common import map_texts, staged, table, unused, with_texts

#: Sentences of at most LONG words stay whole; longer ones are cut at least every REACH words.
LONG, REACH = 10, 6
#: Shorter repeats are never deleted; those of SURE words in whole pieces always are. A passage of 51 words loses
#: at most LONG (and 2 * REACH - 2) words at each end to pieces that it shares with the words around it.
NOISE, SURE = 20, 31
#: An odd number; hashes of stretches are polynomials in it, modulo 2 to the power 64.
BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))
#: The lower bits that hold a word's place beside the upper bits of its hash; more words than a task's memory holds.
PLACE = np.uint64((1 << 32) - 1)
#: Whether a byte ends a sentence.
MARKS = np.isin(np.arange(256), [ord(c) for c in ".!?"])


def _powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * BASE
    return x ^ (x >> np.uint64(29))


class Pieces:
    """Words and pieces of some texts, as flat arrays; words are parted by ASCII white space."""

    def __init__(self, texts: list[str]):
        encoded = [t.encode() for t in texts]
        data = b"\n".join([*encoded, b""])
        raw = np.frombuffer(data, dtype=np.uint8)
        space = np.concatenate([[True], (raw == 32) | ((raw >= 9) & (raw <= 13)), [True]])
        turns = np.flatnonzero(space[1:] != space[:-1])
        self.data = data
        #: Of each word, its first byte and the byte after its last.
        self.starts, self.ends = turns[::2], turns[1::2]
        #: Of each text, its bytes and where its words end.
        sizes = np.array([len(e) for e in encoded], dtype=np.int64)
        self.text_ends = np.cumsum(sizes + 1) - 1
        self.text_starts = self.text_ends - sizes
        self.word_ends = np.searchsorted(self.starts, self.text_ends)
        n = len(self.starts)
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, data.split()), dtype=np.uint64, count=n)
        #: Whether a word begins a line, or a sentence.
        self.new_line = np.zeros(n + 1, dtype=bool)
        self.new_line[np.searchsorted(self.starts, np.flatnonzero(raw == 10))] = True
        self.new_line[0] = True
        opens = self.new_line[:n].copy()
        opens[1:] |= MARKS[raw[self.ends[:-1] - 1]]
        #: The words that begin pieces.
        self.firsts = np.flatnonzero(opens | self._cuts(opens))

    def _cuts(self, opens: np.ndarray) -> np.ndarray:
        """Words that have the least hash of some REACH words in a row within their sentence, the last of equal ones."""
        n = len(opens)
        cuts = np.zeros(n, dtype=bool)
        if n < REACH:
            return cuts
        sentence = np.cumsum(opens, dtype=np.int32)
        long = np.diff(np.flatnonzero(opens), append=n) > LONG
        # The upper bits of the hash above the place, the last place lowest.
        least = self.hashes & ~PLACE | PLACE - np.arange(n, dtype=np.uint64)
        width = 1
        while width < REACH:
            step = min(width, REACH - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        inside = (sentence[: n - REACH + 1] == sentence[REACH - 1 :]) & long[sentence[: n - REACH + 1] - 1]
        cuts[(PLACE - (least[inside] & PLACE)).astype(np.int64)] = True
        return cuts

    def without(self, text: int, runs: list[tuple[int, int]]) -> str:
        """A text without runs of pieces, given by their first words and the words after them.

        A run from the beginning of a line takes the space after it along, any other the space before it.
        """
        at, made = int(self.text_starts[text]), []
        end_of_text, last = int(self.text_ends[text]), int(self.word_ends[text])
        for first, end in runs:
            whole = bool(self.new_line[first])
            made.append(self.data[at : int(self.starts[first] if whole else self.ends[first - 1])])
            at = int(self.ends[end - 1]) if not whole else int(self.starts[end]) if end < last else end_of_text
        made.append(self.data[at:end_of_text])
        return b"".join(made).decode()


class Grams:
    """Grams and selected grams of some texts, as flat arrays over their pieces."""

    def __init__(self, texts: list[str], noise: int, sure: int):
        self.pieces = Pieces(texts)
        n = len(self.pieces.firsts)
        #: Of each text, where its pieces end.
        self.text_ends = np.searchsorted(self.pieces.firsts, self.pieces.word_ends)
        n_words = len(self.pieces.starts)
        #: The words before each piece, and all words.
        self.so_far = so_far = np.concatenate([self.pieces.firsts, [n_words]])
        own_end = np.repeat(self.text_ends, np.diff(self.text_ends, prepend=0))
        mixed = _mixed(self.pieces.hashes)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed * _powers(BASE, n_words), dtype=np.uint64)])
        #: The gram from piece i covers the pieces i to end[i] - 1.
        self.end = np.searchsorted(so_far, so_far[:-1] + noise)
        self.valid = self.end <= own_end
        end = so_far[np.where(self.valid, self.end, n)]
        back = _powers(BACK, n_words + 1)[so_far[:-1]]
        self.hash = _mixed((sums[end] - sums[so_far[:-1]]) * back)
        self.selected = np.zeros(n, dtype=bool)
        sure_end = np.searchsorted(so_far, so_far[:-1] + sure)
        starts = np.flatnonzero(sure_end <= own_end)
        if len(starts):
            last = np.searchsorted(self.end, sure_end[starts], side="right") - 1
            self.selected[self._least(starts, last)] = True

    def _least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Where the least hash of each stretch of grams is, the last of equal ones."""
        better = lambda a, b: np.where(self.hash[b] <= self.hash[a], b, a)
        level = np.frexp(last - first + 1)[1] - 1
        best = np.arange(len(self.hash))
        found = np.empty(len(first), dtype=np.int64)
        for k in range(int(level.max()) + 1):
            here = level == k
            found[here] = better(best[first[here]], best[last[here] - (1 << k) + 1])
            if len(best) > 1 << k:
                best = better(best[: -(1 << k)], best[1 << k :])
        return found

    def spans(self):
        return zip([0, *self.text_ends[:-1].tolist()], self.text_ends.tolist())


def _marked(noise: int, sure: int):
    def make():
        def of_texts(texts: list[str]) -> list[pa.Array]:
            found = Grams(texts, noise, sure)
            grams, picked, own = [], [], []
            for a, b in found.spans():
                valid = found.hash[a:b][found.valid[a:b]]
                distinct = np.unique(valid)
                grams.append(distinct.view(np.int64))
                flags = np.zeros(len(distinct), dtype=bool)
                flags[np.searchsorted(distinct, found.hash[a:b][found.selected[a:b]])] = True
                picked.append(flags)
                own.append(len(distinct) < len(valid))
            return [pa.array(grams, pa.list_(pa.int64())), pa.array(picked, pa.list_(pa.bool_())), pa.array(own)]

        return of_texts

    return make


def _deleted(found: Grams, a: int, b: int, later: np.ndarray) -> list[tuple[int, int]]:
    """The runs of one text, as first and last pieces; a to b are its pieces."""
    at = a + np.flatnonzero(found.valid[a:b])
    hashes = found.hash[at]
    first = np.zeros(len(at), dtype=bool)
    first[np.unique(hashes, return_index=True)[1]] = True
    repeated = ~first | np.isin(hashes, later)
    seed = found.selected[at]
    gone: list[tuple[int, int]] = []
    start = end = -1
    seeded = False
    for i, s in zip(at[repeated].tolist(), seed[repeated].tolist()):
        if i > end:
            if seeded:
                gone.append((start, end))
            start, seeded = i, False
        end = max(end, int(found.end[i]))
        seeded |= s
    if seeded:
        gone.append((start, end))
    return gone


def _key(id_col: str, text_col: str) -> Column:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.coalesce(F.col(id_col).cast("long"), -1 - F.xxhash64(text).bitwiseAND(F.lit((1 << 63) - 1)))


def _repeats(rows: DataFrame) -> DataFrame:
    """(dk, g, first) of hashes that more than one row has."""
    firsts = rows.groupBy("g").agg(F.min("dk").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return rows.join(firsts, "g").select("dk", "g", "first")


def _packed():
    pack = zstandard.ZstdCompressor().compress
    return lambda texts: [pa.array([pack(t.encode()) for t in texts], pa.binary())]


def drop_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = NOISE, sure: int = SURE) -> DataFrame:
    """The rows with later repeats deleted from the text, and columns lines and removed_lines.

    Order is that of integer ids, then of the place in the text; repeats within a text count. A
    text that is wholly repeated becomes empty; NULL counts as empty and becomes empty. Rows of one id are
    never compared with each other, so repeated rows give equal results. Rows with a NULL id come
    first, told apart by their text. Very long texts are read whole, one at a time. All columns are kept;
    columns lines and removed_lines of the input are replaced. removed_lines counts pieces. An empty table gives no rows.
    """
    keyed = df.select(_key(id_col, text_col).alias("dk"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    marked = staged(map_texts(keyed, _marked(noise, sure), "grams array<long>, picked array<boolean>, own boolean"), "line-grams")
    hits = _repeats(marked.select("dk", F.inline(F.arrays_zip("grams", "picked")).alias("g", "picked")).filter("picked").drop("picked"))
    # Only documents with a selected gram that stands earlier ask for grams, and only those where one stands first answer.
    roles = hits.groupBy("dk").agg(F.max(F.col("dk") > F.col("first")).alias("seeded"), F.max(F.col("dk") == F.col("first")).alias("answers"))
    grams = marked.join(staged(roles, "line-roles").hint("merge"), "dk").select("dk", (F.col("own") | F.col("seeded")).alias("asks"), "answers", F.explode("grams").alias("g"))
    firsts = grams.filter("answers").groupBy("g").agg(F.min("dk").alias("first"))
    found = grams.filter("asks").join(firsts, "g").filter("dk > first").select("dk", "g").union(marked.filter("own").selectExpr("dk", "CAST(NULL AS BIGINT) AS g"))
    lists = found.groupBy("dk").agg(F.collect_set("g").alias("later"))
    plain = df.drop(*(n for n in ("lines", "removed_lines") if n != text_col))
    key, later_col = (unused(plain, n) for n in ("key", "later"))
    lists = lists.select(F.col("dk").alias(key), F.col("later").alias(later_col))
    # Texts meet their lists packed: they are the largest rows that are shuffled.
    packed = with_texts(plain.withColumn(key, _key(id_col, text_col)), text_col, _packed, f"`{text_col}` binary")
    joined = packed.join(lists, key, "left").drop(key)

    def make():
        unpack = zstandard.ZstdDecompressor().decompress

        def of_texts(given: list[bytes], later: pa.Array) -> list[pa.Array]:
            texts = [unpack(t).decode() for t in given]
            made, lines, removed = list(texts), [t.count("\n") + 1 if t else 0 for t in texts], [0] * len(texts)
            at = [i for i in range(len(texts)) if later[i].is_valid]
            found = Grams([texts[i] for i in at], noise, sure)
            as_hashes = lambda x: x.values.to_numpy(zero_copy_only=False).view(np.uint64)
            for k, (i, (a, b)) in enumerate(zip(at, found.spans())):
                gone = _deleted(found, a, b, as_hashes(later[i]))
                if gone:
                    made[i] = found.pieces.without(k, [(int(found.so_far[x]), int(found.so_far[y])) for x, y in gone])
                    removed[i] = sum(y - x for x, y in gone)
            return [pa.array(made, pa.string()), pa.array(lines, pa.int64()), pa.array(removed, pa.int64())]

        return of_texts

    return with_texts(joined, text_col, make, f"`{text_col}` string, lines long, removed_lines long", [later_col], as_given=True)


def op7_lines(spark, sf_dir: str) -> DataFrame:
    """Every document's text without later repeats."""
    return drop_repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "lines", "removed_lines")
