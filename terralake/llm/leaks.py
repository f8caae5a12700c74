"""Benchmark items inside documents within an edit budget, by the pigeonhole principle.

An item with a budget of e edits is cut into e + 1 pieces; whoever makes at most e edits
leaves a piece untouched. An automaton over all pieces finds their exact hits in a document, each
hit gives a window in which the item may stand, and Myers' bit-parallel distance decides.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import Any

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralake.llm.common import id_and_text, map_texts, table, unused, with_texts

#: Edits allowed for each character of an item.
RATE = 0.08
#: Items with fewer characters count only where they stand without edits and as whole words.
LEAST_CHARS = 24
#: Characters of items that one pass over the documents looks for; more items take more passes.
BLOCK_CHARS = 1_000_000


def plain(text: str) -> str:
    """Lower case, and single spaces for white space."""
    return " ".join(text.lower().split())


def spaced(c: str) -> bool:
    """Whether the character is of a word in a script that sets words apart by spaces."""
    dense = c >= "\u2e80" and not "\uac00" <= c <= "\ud7af" or "\u0e00" <= c <= "\u0eff" or "\u1000" <= c <= "\u109f" or "\u1780" <= c <= "\u17ff"
    return c.isalnum() and not dense


class Item:
    def __init__(self, key: Any, text: str, rate: float, least: int = 0):
        self.key, self.text = key, text
        self.short = len(text) < least
        self.budget = 0 if self.short else int(len(text) * rate)
        self.masks: dict[str, int] = defaultdict(int)
        for i, c in enumerate(text):
            self.masks[c] |= 1 << i

    def pieces(self) -> list[tuple[int, str]]:
        n = self.budget + 1
        cuts = [len(self.text) * i // n for i in range(n + 1)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:])]

    def may_start(self, text: str, at: int) -> bool:
        """Whether no word goes on beyond the ends of a short item there."""
        if not self.short:
            return True
        end = at + len(self.text)
        inside = at and spaced(text[at - 1]) and spaced(text[at]) or end < len(text) and spaced(text[end - 1]) and spaced(text[end])
        return not inside

    def nearest(self, text: str) -> tuple[int, int]:
        """The least number of edits between the item and a part of the text, and where that part ends."""
        size = len(self.text)
        ones, top = (1 << size) - 1, 1 << (size - 1)
        up, down, score = ones, 0, size
        least, end = size, 0
        masks = self.masks
        for at, c in enumerate(text, 1):
            equal = masks.get(c, 0)
            vertical = equal | down
            horizontal = (((equal & up) + up) ^ up) | equal
            plus = down | ~(horizontal | up) & ones
            minus = up & horizontal
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
            plus = plus << 1 & ones
            minus = minus << 1 & ones
            up = minus | ~(vertical | plus) & ones
            down = plus & vertical
            if score < least:
                least, end = score, at
        return least, end


class Finder:
    def __init__(self, items: list[tuple[Any, str]], rate: float, least: int = 0):
        self.items = [Item(key, text, rate, least) for key, text in items]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, item in enumerate(self.items):
            for offset, piece in item.pieces():
                places[piece].append((n, offset + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, found)
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(number of the item, edits, end in the plain text) for each item within its budget, nearest place each."""
        text = plain(text)
        starts: dict[int, set[int]] = defaultdict(set)
        for at, found in self.automaton.iter(text):
            for n, until in found:
                if self.items[n].may_start(text, at + 1 - until):
                    starts[n].add(at + 1 - until)
        hits = []
        for n in sorted(starts):
            item = self.items[n]
            best = None
            for low, high in windows(sorted(starts[n]), len(item.text), item.budget):
                low = max(0, low)
                edits, end = item.nearest(text[low:high])
                if edits <= item.budget and (best is None or edits < best[0]):
                    best = edits, low + end
            if best:
                hits.append((n, *best))
        return hits


def windows(starts: list[int], size: int, budget: int) -> Iterator[tuple[int, int]]:
    """Stretches of text around the expected starts, overlapping ones joined."""
    low = high = None
    for s in starts:
        if high is not None and s - budget <= high:
            high = s + size + budget
            continue
        if high is not None:
            yield low, high
        low, high = s - budget, s + size + budget
    if high is not None:
        yield low, high


def blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[Any, str]]]:
    """Distinct items in blocks of a bounded number of characters; the driver holds one block at a time."""
    block, held = [], 0
    for key, text in benchmark.select(item_col, text_col).distinct().toLocalIterator():
        text = plain(text or "")
        if not text:
            continue
        if block and held + len(text) > BLOCK_CHARS:
            yield block
            block, held = [], 0
        block.append((key, text))
        held += len(text)
    if block:
        yield block


def find_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = RATE, least: int = LEAST_CHARS) -> DataFrame:
    """(id, item id, edits, ends_at) for every document and item that it holds within the budget.

    Case and white space do not count. `ends_at` is the end, in characters of the plain text, of the
    nearest place, the first of equal ones. Items shorter than `least` characters match without edits and as whole words,
    those of scripts without spaces anywhere. Empty and NULL items match nothing; NULL and empty texts match nothing. Equal items with other ids are all
    given; repeated rows of documents give repeated results, repeated rows of items do not.
    Other columns are not carried. No shuffle; one pass for each block of items.
    """
    kind = benchmark.schema[item_col].dataType.simpleString()
    rows = id_and_text(df, id_col, text_col)
    found = None
    for block in blocks(benchmark, item_col, item_text):
        sent = df.sparkSession.sparkContext.broadcast(block)

        def make(sent=sent):
            finder = Finder(sent.value, rate, least)
            items = finder.items

            def of_texts(texts: list[str]) -> list[pa.Array]:
                hits = [[{"item": items[n].key, "edits": e, "ends_at": at} for n, e, at in finder.find(t)] for t in texts]
                return [pa.array(hits, pa.list_(pa.struct([("item", pa_type), ("edits", pa.int32()), ("ends_at", pa.int64())])))]

            return of_texts

        pa_type = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
        one = map_texts(rows, make, f"hits array<struct<item:{kind},edits:int,ends_at:bigint>>")
        one = one.select("id", F.explode("hits").alias("h")).select(F.col("id").alias(id_col), F.col("h.item").alias(item_col), "h.edits", "h.ends_at")
        found = one if found is None else found.union(one)
    if found is None:
        fields = [df.schema[id_col], benchmark.schema[item_col], T.StructField("edits", T.IntegerType()), T.StructField("ends_at", T.LongType())]
        found = df.sparkSession.createDataFrame([], T.StructType(fields))
    return found


def without_leaks(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = RATE, least: int = LEAST_CHARS) -> DataFrame:
    """The rows whose text holds no item within its budget, with all their columns; rows without text stay."""
    flag = unused(df, "holds_item")
    for block in blocks(benchmark, item_col, item_text):
        sent = df.sparkSession.sparkContext.broadcast(block)

        def make(sent=sent):
            finder = Finder(sent.value, rate, least)
            return lambda texts: [pa.array([bool(finder.find(t)) for t in texts])]

        df = with_texts(df, text_col, make, f"{flag} boolean").filter(~F.col(flag)).drop(flag)
    return df


def op10_leaks(spark, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
