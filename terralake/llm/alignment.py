"""Alignment of two tokenizers over the same bytes, and corpus-wide counts of the token pairs that overlap.

Both tokenizations cut a text's bytes; where both cut, groups end, and between neighbouring cuts of either lies one link,
an occurrence of a token of each side over the same bytes. Links are counted outside of memory: each block of
documents writes its pairs as runs, sorted by pair, dealt out by ranges of the right side's ids and
compressed. The runs of a range are merged, smallest pair first, and added up. In a second merge the counts stand in the order of the
right side's ids, so each id's largest count is known when its links come by, and what the links
of each document add up to goes back to its block.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralake.llm.common import id_and_text, staged, table

LEFT, RIGHT = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Characters of a text that are encoded at once where a longer one can be cut between words; bytes of texts that are aligned at once.
PIECE_CHARS, STEP_BYTES = 1 << 20, 1 << 20
#: Bits of the left side's ids within a pair; right ids of a range; records of a block before it is written; records of a range that a task merges.
LEFT_BITS, RANGE_IDS, BLOCK_RECORDS, MERGED_RECORDS = 16, 256, 1 << 20, 1 << 22
#: Documents of a block.
BLOCK_DOCS = 1 << 16
#: Records of a run that are unpacked at once.
FRAME = 1 << 14
LEVEL = 1


@dataclass
class Vocabularies:
    """What encodes, and the bytes that each id stands for."""

    left: tiktoken.Encoding
    right: object
    left_bytes: list[bytes]
    right_bytes: list[bytes]
    #: No token of the right side goes on over a space within it, so that texts can be cut before one.
    cuttable: bool

    @classmethod
    def load(cls, left: bytes, right: bytes, pattern: str) -> Vocabularies:
        import sentencepiece

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in left.splitlines() if line)}
        own = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            own[rank] = token
        model = sentencepiece.SentencePieceProcessor(model_proto=right)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        as_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        cuttable = not any("▁" in p.lstrip("▁") for p in pieces)
        return cls(tiktoken.Encoding("left", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), model, own, as_bytes, cuttable)

    def __post_init__(self):
        self.left_sizes, self.right_sizes = (np.array([len(b) for b in x], dtype=np.int64) for x in (self.left_bytes, self.right_bytes))
        # Decimal ids with what follows them, eight bytes each: a comma, or the end of a side of a group.
        self.left_text, self.right_text = (
            np.array([[f"{i}{end}".encode().ljust(8, b"\0") for i in range(len(x))] for end in ends], dtype="S8").view(np.uint64)
            for x, ends in ((self.left_bytes, ",|"), (self.right_bytes, ",;"))
        )
        assert len(self.left_bytes) <= 1 << LEFT_BITS

    def pieces(self, text: str) -> Iterator[tuple[str, str]]:
        """A text as it goes to each side; long ones cut where a letter is followed by a space and a letter."""
        start = 0
        while self.cuttable and len(text) - start > PIECE_CHARS:
            at = start + PIECE_CHARS
            while at + 1 < len(text) and not (text[at] == " " and text[at - 1].isalpha() and text[at + 1].isalpha()):
                at += 1
            if at + 1 >= len(text):
                break
            yield (" " if not start else "") + text[start:at], text[start + bool(start) : at]
            start = at
        yield (" " if not start else "") + text[start:], text[start + bool(start) :]

    def encoded(self, text: str) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Ids of both sides for each piece; None if a side's bytes are not the text's after a space."""
        made = []
        if not text:
            return None
        for left, right in self.pieces(text):
            a = self.left.encode_to_numpy(left, disallowed_special=())
            b = self.right.encode(right)
            whole = left.encode()
            if b"".join(map(self.right_bytes.__getitem__, b)) != whole or b"".join(map(self.left_bytes.__getitem__, a.tolist())) != whole:
                return None
            made.append((a.astype(np.uint16), np.array(b, dtype=np.uint16)))
        return made


@dataclass
class Aligned:
    """Of pieces laid end to end: where each ends among groups and links, the links' ids, and the groups as text."""

    groups: np.ndarray
    links: np.ndarray
    left: np.ndarray
    right: np.ndarray
    text: bytes
    text_ends: np.ndarray


def align(v: Vocabularies, pieces: list[tuple[np.ndarray, np.ndarray]]) -> Aligned:
    a, b = (np.concatenate([p[side] for p in pieces]).astype(np.int64) for side in (0, 1))
    a_ends, b_ends = np.cumsum(v.left_sizes[a]), np.cumsum(v.right_sizes[b])
    cut = np.zeros(int(a_ends[-1]) + 1, dtype=np.uint8)
    cut[a_ends] = 1
    cut[b_ends] |= 2
    at = np.flatnonzero(cut)
    kind = cut[at]
    is_a, is_b = (kind & 1).astype(np.int64), (kind >> 1).astype(np.int64)
    both = kind == 3
    left, right = a[np.cumsum(is_a) - is_a], b[np.cumsum(is_b) - is_b]
    # Tokens of each side up to the end of each group.
    a_upto, b_upto = np.cumsum(is_a)[both], np.cumsum(is_b)[both]
    n_groups = len(a_upto)
    a_group, b_group = (np.repeat(np.arange(n_groups), np.diff(upto, prepend=0)) for upto in (a_upto, b_upto))
    words = np.empty(len(a) + len(b), dtype=np.uint64)
    a_last, b_last = (np.zeros(len(x), dtype=np.int64) for x in (a, b))
    a_last[a_upto - 1] = b_last[b_upto - 1] = 1
    words[np.arange(len(a)) + np.concatenate([[0], b_upto[:-1]])[a_group]] = v.left_text[a_last, a]
    words[np.arange(len(b)) + a_upto[b_group]] = v.right_text[b_last, b]
    letters = words.view(np.uint8)
    text = letters[letters != 0]
    sizes = np.cumsum(np.count_nonzero(letters.reshape(-1, 8), axis=1))
    a_of, b_of = (np.cumsum([len(p[side]) for p in pieces]) for side in (0, 1))
    ends = a_ends[a_of - 1]
    links = np.searchsorted(at, ends, side="right")
    groups = np.searchsorted(a_upto, a_of, side="right")
    return Aligned(groups, links, left, right, text.tobytes(), sizes[a_of + b_of - 1])


def packed(pairs: np.ndarray, docs: np.ndarray, times: np.ndarray) -> bytes:
    """A run: frames of at most FRAME records, each compressed by itself, after their sizes and last pairs."""
    made, heads = [], []
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    for at in range(0, len(pairs), FRAME):
        part = slice(at, at + FRAME)
        steps = np.diff(pairs[part], prepend=pairs[at : at + 1])
        frame = pack(steps.astype("<u4").tobytes() + docs[part].astype("<u4").tobytes() + times[part].astype("<u4").tobytes())
        heads += [len(frame), int(pairs[at]), int(pairs[part][-1])]
        made.append(frame)
    return np.array([len(made), *heads], dtype="<u4").tobytes() + b"".join(made)


class Run:
    """The frames of a run, one unpacked at a time."""

    def __init__(self, data: bytes, block: int):
        self.data, self.block = data, block
        count = int.from_bytes(data[:4], "little")
        self.heads = np.frombuffer(data, dtype="<u4", count=3 * count, offset=4).reshape(-1, 3).astype(np.int64)
        self.at, self.offset = 0, 4 + 12 * count
        self.pairs = self.docs = self.times = np.zeros(0, dtype=np.int64)

    def load(self) -> bool:
        """Unpacks the next frame; False if there is none."""
        if self.at == len(self.heads):
            return False
        size, first, _ = self.heads[self.at].tolist()
        frame = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.data[self.offset : self.offset + size]), dtype="<u4").reshape(3, -1)
        self.at, self.offset = self.at + 1, self.offset + size
        self.pairs, self.docs, self.times = np.cumsum(frame[0].astype(np.int64)) + first, frame[1].astype(np.int64), frame[2].astype(np.int64)
        return True

    def upto(self, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Takes the unpacked records of pairs up to the bound."""
        n = int(np.searchsorted(self.pairs, bound, side="right"))
        taken = self.pairs[:n], self.docs[:n], self.times[:n]
        self.pairs, self.docs, self.times = self.pairs[n:], self.docs[n:], self.times[n:]
        return taken


def merged(runs: list[Run]) -> Iterator[list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """Records of all runs in the order of pairs, as lists of (run, pairs, docs, times).

    A heap holds the last unpacked pair of each run. Up to the least of them nothing can still come from a frame that is not
    unpacked, unless it begins with the same pair.
    """
    heap = [(int(run.pairs[-1]), k) for k, run in enumerate(runs) if run.load()]
    heapq.heapify(heap)
    while heap:
        bound = heap[0][0]
        out = []
        for k in sorted({k for last, k in heap if runs[k].pairs[0] <= bound}):
            out.append((k, *runs[k].upto(bound)))
        # What ended at the bound is used up; all of it goes before new frames come, which may end there too.
        spent = []
        while heap and heap[0][0] == bound:
            spent.append(heapq.heappop(heap)[1])
        for k in spent:
            if runs[k].load():
                heapq.heappush(heap, (int(runs[k].pairs[-1]), k))
        yield out


def _summed(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, where = np.unique(pairs, return_inverse=True)
    return distinct, np.bincount(where, weights=times, minlength=len(distinct)).astype(np.int64)


_LOADED: dict[tuple, Vocabularies] = {}


def shipped(spark, left: str | None = None, right: str | None = None, pattern: str | None = None) -> Callable[[], Vocabularies]:
    """What gives the vocabularies inside a task; their files, of a few MB, are read by the driver and broadcast."""
    left, right = left or str(public_tokenizers.path(LEFT)), right or str(public_tokenizers.path(RIGHT))
    pattern = pattern or public_tokenizers.PATTERN
    sent = spark.sparkContext.broadcast((Path(left).read_bytes(), Path(right).read_bytes()))

    def load() -> Vocabularies:
        if (left, right, pattern) not in _LOADED:
            _LOADED[left, right, pattern] = Vocabularies.load(*sent.value, pattern)
        return _LOADED[left, right, pattern]

    return load


DOC_FIELDS = ["n_a", "n_b", "n_groups", "n_links"]


class _Block:
    """Documents of a task, one after another, until their records are many enough to be written as runs."""

    def __init__(self, v: Vocabularies, number: int):
        self.v, self.number = v, number
        self.ids: list = []
        self.counts: list[list[int]] = []
        self.digests: list[str] = []
        self.records: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, ids: list, texts: list[str]) -> None:
        """Aligns texts in steps of bounded size; a long text goes through several."""
        open_: list[tuple[int, tuple[np.ndarray, np.ndarray]]] = []
        held, hashes = 0, {}
        for id_, text in zip(ids, texts):
            doc = len(self.ids)
            self.ids.append(id_)
            pieces = self.v.encoded(text)
            self.counts.append([0] * 4)
            self.digests.append("")
            if pieces is None:
                continue
            hashes[doc] = [hashlib.sha256(), len(pieces)]
            self.counts[doc][:2] = sum(len(p[0]) for p in pieces), sum(len(p[1]) for p in pieces)
            for piece in pieces:
                open_.append((doc, piece))
                held += len(piece[0]) + len(piece[1])
                if held * 3 >= STEP_BYTES:
                    self._settle(open_, hashes)
                    open_, held = [], 0
        self._settle(open_, hashes)

    def _settle(self, pieces: list[tuple[int, tuple[np.ndarray, np.ndarray]]], hashes: dict) -> None:
        if not pieces:
            return
        found = align(self.v, [p for _, p in pieces])
        docs = np.repeat(np.array([d for d, _ in pieces], dtype=np.int64), np.diff(found.links, prepend=0))
        keys = docs << 32 | found.right << LEFT_BITS | found.left
        distinct, times = np.unique(keys, return_counts=True)
        self.records.append((distinct, times))
        self.size += len(distinct)
        for (doc, _), groups, links, a, b in zip(
            pieces, np.diff(found.groups, prepend=0).tolist(), np.diff(found.links, prepend=0).tolist(), [0, *found.text_ends[:-1].tolist()], found.text_ends.tolist()
        ):
            self.counts[doc][2] += groups
            self.counts[doc][3] += links
            running = hashes[doc]
            running[1] -= 1
            # The last group of a text has nothing after it.
            running[0].update(found.text[a : b - (running[1] == 0)])
            if not running[1]:
                self.digests[doc] = running[0].hexdigest()

    def documents(self) -> list[pa.Array]:
        n = len(self.ids)
        columns = [pa.array([self.number] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(self.ids)]
        columns += [pa.array([c[k] for c in self.counts], pa.int64()) for k in range(4)]
        return [*columns, pa.array(self.digests, pa.string())]

    def runs(self) -> Iterator[tuple[int, int, bytes]]:
        """(range, records, run) of each range of right ids."""
        if not self.records:
            return
        keys, times = np.concatenate([k for k, _ in self.records]), np.concatenate([t for _, t in self.records])
        pairs = keys & ((1 << 32) - 1)
        order = np.argsort(pairs, kind="stable")
        pairs, docs, times = pairs[order], keys[order] >> 32, times[order]
        ranges = pairs >> LEFT_BITS
        ranges //= RANGE_IDS
        cuts = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(pairs)]
        for a, b in zip(cuts, cuts[1:]):
            yield int(ranges[a]), b - a, packed(pairs[a:b], docs[a:b], times[a:b])


def _encoded(df: DataFrame, id_col: str, text_col: str, load: Callable[[], Vocabularies]) -> DataFrame:
    """Documents and runs, told apart by `range`: NULL for documents. A block's number is that of its first row."""
    rows = id_and_text(df, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    kind = rows.schema["id"].dataType.simpleString()
    fields = f"block long, doc int, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, range int, records long, run binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, block, schema = load(), None, None

        def made(block: _Block) -> Iterator[pa.RecordBatch]:
            nothing = lambda n, kind: pa.nulls(n, kind)
            columns = block.documents()
            columns[2] = columns[2].cast(schema)
            n = len(block.ids)
            yield pa.RecordBatch.from_arrays([*columns, nothing(n, pa.int32()), nothing(n, pa.int64()), nothing(n, pa.binary())], names=names)
            # As records come to a few MB each, a handful go at a time.
            found = list(block.runs())
            n = len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block.number] * n, pa.int64()), nothing(n, pa.int32()), nothing(n, schema), *(nothing(n, pa.int64()) for _ in range(4)), nothing(n, pa.string()),
                 pa.array([r for r, _, _ in found], pa.int32()), pa.array([k for _, k, _ in found], pa.int64()), pa.array([x for _, _, x in found], pa.binary())],
                names=names,
            )

        for batch in batches:
            schema = batch.column("id").type
            texts = batch.column("text").to_pylist()
            sizes = [len(t) for t in texts]
            ids, numbers = batch.column("id").to_pylist(), batch.column("row").to_pylist()
            start = 0
            while start < len(ids):
                block = block or _Block(v, numbers[start])
                stop, chars = start, 0
                while stop < len(ids) and (stop == start or chars + sizes[stop] <= STEP_BYTES):
                    chars += sizes[stop]
                    stop += 1
                block.add(ids[start:stop], texts[start:stop])
                start = stop
                if block.size >= BLOCK_RECORDS or len(block.ids) >= BLOCK_DOCS:
                    yield from made(block)
                    block = None
        if block:
            yield from made(block)

    names = [f.split()[0] for f in fields.split(", ")]
    return rows.mapInArrow(run, fields)


def _counted(rows: pa.Table) -> pa.Table:
    """Counts of the pairs of some runs of a range."""
    runs = [Run(r.as_py(), 0) for r in rows.column("run")]
    pairs, times = [], []
    for part in merged(runs):
        found = _summed(np.concatenate([p for _, p, _, _ in part]), np.concatenate([t for *_, t in part]))
        # A pair that also begins the next part is added up with it below.
        pairs.append(found[0])
        times.append(found[1])
    found = _summed(np.concatenate(pairs), np.concatenate(times)) if pairs else (np.zeros(0), np.zeros(0))
    range_ = rows.column("range")[0].as_py()
    return pa.table({"range": pa.array([range_] * len(found[0]), pa.int32()), "pair": pa.array(found[0], pa.int64()), "count": pa.array(found[1], pa.int64())})


def _returned(rows: pa.Table, counts: pa.Table) -> pa.Table:
    """For each block of some runs, what their links add to its documents: the sum of their counts, and how many are the best of their right id."""
    pairs, count = counts.column("pair").to_numpy(), counts.column("count").to_numpy()
    order = np.argsort(pairs, kind="stable")
    pairs, count = pairs[order], count[order]
    rights = pairs >> LEFT_BITS
    starts = np.flatnonzero(np.diff(rights, prepend=-1))
    best = np.repeat(np.maximum.reduceat(count, starts), np.diff(np.append(starts, len(pairs)))) == count
    blocks = rows.column("block").to_pylist()
    runs = [Run(r.as_py(), b) for r, b in zip(rows.column("run"), blocks)]
    sums: list[np.ndarray] = [np.zeros((2, 0), dtype=np.int64) for _ in runs]
    for part in merged(runs):
        for k, p, docs, times in part:
            at = np.searchsorted(pairs, p)
            most = int(docs.max()) + 1
            if most > sums[k].shape[1]:
                sums[k] = np.pad(sums[k], ((0, 0), (0, most - sums[k].shape[1])))
            # Whole numbers all the way: a sum of counts may exceed what doubles hold.
            np.add.at(sums[k][0], docs, times * count[at])
            np.add.at(sums[k][1], docs, times * best[at])
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    return pa.table({"block": pa.array(blocks, pa.int64()), "sums": pa.array([pack(s.astype("<i8").tobytes()) for s in sums], pa.binary())})


def _added(docs: pa.Table, sums: pa.Table) -> pa.Table:
    total = np.zeros((2, docs.num_rows), dtype=np.int64)
    where = docs.column("doc").to_numpy()
    for packed_sums in sums.column("sums"):
        part = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed_sums.as_py()), dtype="<i8").reshape(2, -1)
        total[:, : part.shape[1]] += part
    columns = {n: docs.column(n) for n in ("id", *DOC_FIELDS, "groups_sha256")}
    return pa.table(columns | {"n_best": pa.array(total[1][where]), "count_sum": pa.array(total[0][where])})


def align_tokenizers(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", left: str | None = None, right: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) for each row.

    A space and the text are encoded by the left vocabulary (ranks) and the right one (a model that adds the space). NULL and empty texts, and
    those whose bytes either side changes, have no tokens: zeros, and no digest. Very long texts are encoded and aligned in pieces cut between words, and each
    still gives one row; only a stretch without such a place goes through in one. Ties count: every link whose count is the highest of its right id is a best one. Repeated rows and ids are rows of their own
    and all count. Other columns are not carried. An empty table gives no rows.
    """
    coded = staged(_encoded(df, id_col, text_col, shipped(df.sparkSession, left, right, pattern)), "align-coded")
    docs = coded.filter("range IS NULL").select("block", "doc", "id", *DOC_FIELDS, "groups_sha256")
    runs = coded.filter("range IS NOT NULL").select("block", "range", "records", "run")
    # Ranges with more records than a task merges are dealt out by block; the counts of the parts are added up.
    many = runs.groupBy("range").agg(F.ceil(F.sum("records") / MERGED_RECORDS).cast("int").alias("parts"))
    dealt = runs.join(F.broadcast(many), "range").withColumn("part", F.pmod(F.xxhash64("block"), F.col("parts")).cast("int")).select("block", "range", "part", "run")
    counted = dealt.groupBy("range", "part").applyInArrow(_counted, "range int, pair long, count long")
    counts = staged(counted.groupBy("range", "pair").agg(F.sum("count").alias("count")), "align-counts")
    copied = counts.join(F.broadcast(many), "range").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("range", "part", "pair", "count")
    back = dealt.groupBy("range", "part").cogroup(copied.groupBy("range", "part")).applyInArrow(_returned, "block long, sums binary")
    back = staged(back, "align-sums")
    kind = docs.schema["id"].dataType.simpleString()
    fields = f"id {kind}, {', '.join(f'{n} long' for n in DOC_FIELDS)}, groups_sha256 string, n_best long, count_sum long"
    return docs.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_added, fields).withColumnRenamed("id", id_col)


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    """Every document's tokens of both sides, groups, links and their counts."""
    return align_tokenizers(table(spark, sf_dir, "documents"))
