"""Byte-level BPE by backtracking over longest matches.

Bytes become Latin-1 characters, so that one Aho-Corasick pass finds the longest token at
every position. The encoder takes the longest token whose neighbour on the left is
compatible with it, falls back to its longest token prefix, and steps back where none is
left; positions from which no way leads on are marked and never tried twice, so the work is
linear. Two tokens are compatible if the merges would cut their joint bytes exactly there;
that is decided by undoing merges along the cut and is memoised. A sequence whose
neighbours are all compatible is the one the merges give.
"""

from __future__ import annotations

import array
import base64
from pathlib import Path

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralake.llm.common import id_and_text, map_texts, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pieces and pairs of tokens that a task remembers.
REMEMBERED_PIECES, REMEMBERED_PAIRS, LONGEST_REMEMBERED = 240_000, 500_000, 48
NO_LIMIT = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    ranks = {}
    for line in Path(path).read_bytes().splitlines():
        token, _, rank = line.partition(b" ")
        if token:
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


def halves(token: bytes, ranks: dict[bytes, int]) -> tuple[int, int] | None:
    """The two tokens whose merge makes this one; None for single bytes.

    ValueError if the merges cannot make it, or only from a token of a later rank.
    """
    if len(token) == 1:
        return None
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, NO_LIMIT), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == NO_LIMIT:
            raise ValueError(f"no merges lead to {token!r}")
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    left, right = ranks[parts[0]], ranks[parts[1]]
    if max(left, right) >= ranks[token]:
        raise ValueError(f"{token!r} is made of later tokens")
    return left, right


class Vocabulary:
    """Tables of a rank file, bounded by its size; made once on the driver and broadcast."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte must be a token")
        self.ranks, self.pattern = ranks, pattern
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.halves = {rank: halves(token, ranks) for token, rank in ranks.items()}
        self.shorter = {
            rank: next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), -1)
            for token, rank in ranks.items()
        }


class Encoder:
    """Encodes pieces of text; one per task."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        #: Ranks may have gaps; lists over them are faster than dicts.
        self.size = max(vocabulary.tokens) + 1
        self.length, self.shorter = [0] * self.size, [-1] * self.size
        for rank, token in vocabulary.tokens.items():
            self.length[rank], self.shorter[rank] = len(token), vocabulary.shorter[rank]
        self.automaton = ahocorasick.Automaton()
        for token, rank in vocabulary.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        pair = left * self.size + right
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= REMEMBERED_PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        """Undo merges on both sides of the cut, the latest first, and see whether an earlier one would cross it."""
        tokens, ranks, halves_of = self.v.tokens, self.v.ranks, self.v.halves
        # A merge across the cut wins if its rank is below the one that took the neighbour away; of equal ranks the left one comes first.
        limit = NO_LIMIT
        while True:
            if ranks.get(tokens[left] + tokens[right], NO_LIMIT) < limit:
                return False
            a, b = halves_of[left], halves_of[right]
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                limit, left = left, a[1]
            else:
                limit, right = right + 1, b[0]

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of one piece; a piece that is a token stays whole, as in the rank file's library."""
        whole = self.v.ranks.get(piece)
        if whole is not None:
            return [whole]
        length, shorter, known, size = self.length, self.shorter, self.pairs.get, self.size
        longest = [-1] * len(piece)
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - length[token]] = token
        closed: set[int] = set()
        made: list[int] = []
        at, last, token, stop = 0, -1, longest[0], len(piece)
        while True:
            while token >= 0:
                after = at + length[token]
                if after not in closed:
                    if last < 0:
                        break
                    fits = known(last * size + token)
                    if fits or fits is None and self.compatible(last, token):
                        break
                token = shorter[token]
            if token < 0:
                closed.add(at)
                token = made.pop()
                at -= length[token]
                last = made[-1] if made else -1
                continue
            made.append(token)
            if after == stop:
                return made
            at, last, token = after, token, longest[after]


class Pieces(dict):
    """Packed ids by piece; remembers a bounded number.

    When half of them are new, the half before is forgotten but for what has been asked for since.
    """

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder  # which does not know its pieces: without a cycle both go at once
        self.find = regex.compile(encoder.v.pattern).findall
        self.before: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = array.array("I", self.encoder.encode(piece.encode("utf-8"))).tobytes()
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED_PIECES // 2:
                self.before = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def packed(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, self.find(text)))


_VOCABULARIES: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    key = (path, pattern)
    if key not in _VOCABULARIES:
        _VOCABULARIES[key] = Vocabulary(read_ranks(path), pattern)
    return _VOCABULARIES[key]


def chosen(path: str | None, pattern: str | None) -> Vocabulary:
    return vocabulary(path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, packed: bool = False) -> DataFrame:
    """(id, ids, n_tokens) for each row; ids are array<int>, or packed little-endian 32-bit binary.

    Every match of the pattern is encoded by itself; special tokens do not exist. NULL is the
    empty text, which has no ids. Ties, repeated rows and repeated ids do not matter: each row
    is encoded for itself. Other columns are not carried. No shuffle.
    """
    sent = df.sparkSession.sparkContext.broadcast(chosen(path, pattern))

    def make():
        # A task's encoder goes with it: Python workers live on, and what each remembers is tens of MB.
        pack = Pieces(Encoder(sent.value)).packed

        def of_texts(texts: list[str]) -> list[pa.Array]:
            ids = [pack(t) for t in texts]
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            if packed:
                return [pa.array(ids, pa.binary()), counts]
            flat = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32)
            ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), counts]

        return of_texts

    rows = id_and_text(df, id_col, text_col)
    return map_texts(rows, make, f"ids {'binary' if packed else 'array<int>'}, n_tokens long").withColumnRenamed("id", id_col)


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds the bytes of the ids, which may be an array of integers or packed; NULL gives no bytes.

    An existing column of that name is replaced. An id outside the vocabulary fails the job.
    """
    sent = df.sparkSession.sparkContext.broadcast(chosen(path, pattern).tokens)
    rows = df.drop(out_col)
    schema = T.StructType([*rows.schema.fields, T.StructField(out_col, T.BinaryType())])

    def run(batches):
        tokens = sent.value
        for batch in batches:
            column = batch.column(ids_col)
            made = []
            for i in range(batch.num_rows):
                ids = column[i].as_py()
                if isinstance(ids, bytes):
                    ids = array.array("I", ids)
                made.append(b"".join(map(tokens.__getitem__, ids or ())))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def digests(df: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row: of its ids and of the bytes they decode to."""
    coded = decode(encode(df, packed=True))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of every document."""
    return digests(table(spark, sf_dir, "documents"))
