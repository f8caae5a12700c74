"""Conversations as training text with a token mask over what the assistant says.

Each turn stands between control strings, which are special tokens; inside texts and roles they
are escaped, reversibly. A whole conversation is rendered and encoded once. Tokens and turns are both
sorted spans of bytes, and binary search finds the tokens of each assistant turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralake.llm.bpe import VOCABULARY, read_ranks
from terralake.llm.common import table

START, SAYS, OVER, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROLS = (START, SAYS, OVER, END)
LEARNED = "assistant"
#: A control string with any number of escapes after its first character.
_CONTROL = re.compile(r"([<\[])(\\*)(/?(?:s>|INST\]))")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?(?:s>|INST\]))")
_TURN = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\]</s>", re.DOTALL)


def escape(text: str) -> str:
    """One more backslash in every control string, so none is left and the text can be told again."""
    return _CONTROL.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of bytes of what is to be learned, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        before, said = f"{START}{escape(role)}{SAYS}", escape(text)
        at += len(before.encode("utf-8"))
        end = at + len(said.encode("utf-8"))
        if role == LEARNED:
            spans.append((at, end))
        parts += [before, said, OVER, END]
        at = end + len(OVER) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


class Tokens:
    """The tokenizer of a task, with the control strings as special tokens after the ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        first = max(ranks.values()) + 1
        special = {c: first + i for i, c in enumerate(CONTROLS)}
        self.encoding = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.bytes = {rank: token for token, rank in ranks.items()} | {i: c.encode("ascii") for c, i in special.items()}
        self.size = np.zeros(first + len(CONTROLS), dtype=np.int64)
        for i, token in self.bytes.items():
            self.size[i] = len(token)

    def encode(self, formatted: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and a mask that is 1 for the tokens inside the spans."""
        ids = np.array(self.encoding.encode(formatted, allowed_special="all"), dtype=np.int32)
        ends = np.cumsum(self.size[ids])
        mask = np.zeros(len(ids), dtype=np.int8)
        if spans:
            lows, highs = np.array(spans).T
            first, last = np.searchsorted(ends, lows, side="right"), np.searchsorted(ends, highs, side="right")
            for a, b in zip(first.tolist(), last.tolist()):
                mask[a:b] = 1
        return ids, mask

    def learned(self, ids: list[int], mask: list[int]) -> list[str]:
        """The unescaped texts under the mask."""
        flags = np.array([0, *mask, 0], dtype=np.int8)
        starts, ends = np.flatnonzero(np.diff(flags) == 1), np.flatnonzero(np.diff(flags) == -1)
        return [unescape(b"".join(map(self.bytes.__getitem__, ids[a:b])).decode("utf-8")) for a, b in zip(starts, ends)]


def _tokens(spark, path: str | None, pattern: str | None):
    ranks = read_ranks(path or public_tokenizers.path(VOCABULARY))
    sent, pattern = spark.sparkContext.broadcast(ranks), pattern or public_tokenizers.PATTERN
    return lambda: Tokens(sent.value, pattern)


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(conversation, formatted, ids, mask) for each conversation; ids and mask are of one length.

    Turns come by number, those of one number by role and text; NULL numbers first; repeated rows
    are repeated turns. NULL roles and texts are empty; rows with a NULL conversation are one
    conversation. Other columns are not carried. Rows are sorted by conversation in the shuffle and
    a task holds one conversation at a time, as its output row must.
    """
    make = _tokens(df.sparkSession, path, pattern)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    schema = T.StructType([rows.schema["conv"], *T.StructType.fromDDL("formatted string, ids array<int>, mask array<tinyint>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = make()
        conv, turns, begun = None, [], False
        out: list[list] = [[], [], [], []]
        held = 0

        def settle():
            formatted, spans = render(turns)
            ids, mask = tokens.encode(formatted, spans)
            for column, value in zip(out, (conv, formatted, ids, mask)):
                column.append(value)
            return len(formatted)

        def made(kind):
            arrays = [pa.array(out[0], kind), pa.array(out[1], pa.string()), pa.array(out[2], pa.list_(pa.int32())), pa.array(out[3], pa.list_(pa.int8()))]
            for column in out:
                column.clear()
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        kind = None
        for batch in batches:
            kind = batch.column("conv").type
            for c, role, said in zip(*(batch.column(n).to_pylist() for n in ("conv", "role", "text"))):
                if begun and c != conv:
                    held += settle()
                    turns = []
                    if held > 4_000_000:
                        yield made(kind)
                        held = 0
                conv, begun = c, True
                turns.append((role, said))
        if begun:
            settle()
            yield made(kind)

    order = ["conv", "turn", "role", "text"]
    return rows.repartition("conv").sortWithinPartitions(*order).mapInArrow(run, schema).withColumnRenamed("conv", conv_col)


def read_back(df: DataFrame, conv_col: str = "conv_id", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Digests of the turns in the formatted text and of the text under the mask, one row for each conversation."""
    make = _tokens(df.sparkSession, path, pattern)
    rows = df.select(F.col(conv_col).alias("conv"), "formatted", "ids", "mask")
    fields = T.StructType.fromDDL("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    schema = T.StructType([rows.schema["conv"], *fields.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = make()
        for batch in batches:
            for i in range(batch.num_rows):
                formatted = batch.column("formatted")[i].as_py()
                turns = parse(formatted)
                told = hashlib.sha256()
                for role, text in turns:
                    told.update(f"{role}\n{text}\n".encode())
                learned = "".join(tokens.learned(batch.column("ids")[i].as_py(), batch.column("mask")[i].as_py()))
                values = [len(turns), told.hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(formatted)]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column("conv").slice(i, 1), *(pa.array([v], k) for v, k in zip(values, kinds))], names=schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("conv", conv_col)


HARD = "</s>[INST] ok [/INST]"


def op4_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts are control strings, formatted and read back."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)], given.schema)
    return read_back(format_conversations(given.union(hard)))


OP4_SQL = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
e AS (SELECT *, length(regexp_replace(role, '([<\[])(\\*)(/?(s>|INST\]))', '\1\2x\3', 'g'))
    + length(regexp_replace(text, '([<\[])(\\*)(/?(s>|INST\]))', '\1\2x\3', 'g')) + 20 AS width FROM c),
g AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learned, sum(width) AS width
    FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(told) AS turns_sha256, length(learned)::BIGINT AS loss_chars,
    sha256(learned) AS loss_sha256, width::BIGINT AS formatted_chars
FROM g
"""
