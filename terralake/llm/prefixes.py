"""The trie of conversations that begin alike, from adaptive radix trees over ranges of keys.

A turn has an id of WIDTH bytes, a conversation's key is the ids of its turns in order. Distinct keys are sorted into
ranges of bounded size, and each range becomes one radix tree. Only depths of the tree that are whole turns
are nodes of the trie. A node whose conversations lie in several ranges is summed up from them: every range knows the keys
next to it, so that a node, a child and a leaf is counted once, by the first range that has it (or the only one).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terralake.llm.common import staged, table
from terralake.llm.radix import Tree, agreed
from terralake.operators.scan import PLACE_BITS, Ranges

WIDTH = 16
#: Distinct keys and bytes of keys in a range, about; a longer key is a range of its own.
RANGE_KEYS, RANGE_BYTES = 50_000, 16 << 20
#: Copies of the nodes that lie in several ranges, when children look for them.
SALTS = 32
#: Conversations' ids that are put in order together lie in a block of so many.
BLOCK = 1 << 16


def turn_id(role: Column, text: Column) -> Column:
    """The id of a turn as hexadecimal digits: a digest of role and text, NULL being empty."""
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))


def sequences(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, ids, lens): of each conversation the ids of its turns and the code points of their texts, in order.

    Turns of a NULL number come first; equal numbers are put in order by role, then by id. Repeated rows are turns of
    their own. Rows without a conversation's id belong to none and are left out. A conversation is one row, its texts are not
    carried, so a very long text weighs as much as a short one.
    """
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    turns = df.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn_col).isNotNull().alias("known"), F.col(turn_col).alias("turn"), role.alias("role"), turn_id(F.col(role_col), F.col(text_col)).alias("id"),
            F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(0)).alias("len"),
        ).alias("t"),
    )
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return ordered.select("conv_id", F.transform("ts", lambda t: t.id).alias("ids"), F.transform("ts", lambda t: t.len).alias("lens"))


def keyed(convs: DataFrame) -> DataFrame:
    """(conv_id, key, lens, node) from sequences; node is the digest of the key and names the trie's node at which it ends."""
    return convs.withColumn("key", F.unhex(F.array_join("ids", ""))).select("conv_id", "key", "lens", F.unhex(F.md5("key")).alias("node"))


FIELDS = "node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_ends long, n_children long, n_leaves long, saved_tokens long, shared boolean, parent_shared boolean"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def _digests(key: bytes, upto: int) -> set[bytes]:
    """Digests of the key's prefixes of whole turns, at most `upto` bytes."""
    running, found = hashlib.md5(), {hashlib.md5().digest()}
    for at in range(0, upto - WIDTH + 1, WIDTH):
        running.update(key[at : at + WIDTH])
        found.add(running.digest())
    return found


def _nodes(rows: pa.Table, edges: pa.Table) -> pa.Table:
    """What one range of keys adds to each node of the trie."""
    keys = rows.column("key").to_pylist()
    lens, convs, counts = (rows.column(c).to_pylist() for c in ("lens", "conv_id", "n"))
    before, after = edges.column("before")[0].as_py(), edges.column("after")[0].as_py()
    with_before = set() if before is None else _digests(before, agreed(before, min(keys)))
    with_after = set() if after is None else _digests(after, agreed(after, max(keys)))
    tree = Tree()
    for number, key in enumerate(keys):
        tree.insert(key, number)
    made: list[list] = []

    def emit(digest: bytes, depth: int, state: list, ends: int) -> None:
        """A node of the trie. `state`: conversations, least id, leaves, saved, a key's number, nodes and children right below."""
        n, least, leaves, saved, number, below, children = state
        earlier, later = digest in with_before, digest in with_after
        if not below and not later:
            leaves = 1
        length = lens[number][depth // WIDTH - 1] if depth else 0
        saved += (n if earlier else n - 1) * length
        for child in below:
            made[child][1], made[child][-1] = digest, earlier or later
            if not (earlier or later):
                made[child][4] = least
        made.append([digest, None, depth // WIDTH, least, None, n, ends, children, leaves, saved, earlier or later, False])
        state[2:4], state[5:] = [leaves, saved], [[len(made) - 1], 0 if earlier else 1]

    # On the way down the digests of whole turns along each path are noted, on the way up what lies below is summed.
    root = [0, None, 0, 0, -1, [], 0]
    stack = [(tree.root, 0, hashlib.md5(), root, None, None)]
    while stack:
        node, start, running, above, own, digests = stack.pop()
        end = start + len(node.path)
        if own is None:
            digests, at = [], start
            for turn_end in range(-(-start // WIDTH) * WIDTH, end + 1, WIDTH):
                running.update(node.path[at - start : turn_end - start])
                at = turn_end
                digests.append(running.digest())
            running.update(node.path[at - start :])
            own = [0, None, 0, 0, -1, [], 0]
            stack.append((node, start, running, above, own, digests))
            for byte, child in node.branches():
                further = running.copy()
                further.update(bytes([byte]))
                stack.append((child, end + 1, further, own, None, None))
            continue
        ends = 0
        if node.value >= 0:
            ends = counts[node.value]
            own[0] += ends
            own[1] = convs[node.value] if own[1] is None else min(own[1], convs[node.value])
            own[4] = node.value
        depth = end // WIDTH * WIDTH
        for digest in reversed(digests):
            emit(digest, depth, own, ends if depth == end else 0)
            depth -= WIDTH
        above[0] += own[0]
        above[1] = own[1] if above[1] is None else min(above[1], own[1])
        above[2] += own[2]
        above[3] += own[3]
        above[4] = own[4]
        above[5] += own[5]
        above[6] += own[6]
    kinds = [pa.binary()] * 2 + [pa.int64()] * 8 + [pa.bool_()] * 2
    return pa.table({name: pa.array(column, kind) for name, column, kind in zip(NAMES, zip(*made), kinds)})


def nodes(keys: DataFrame) -> DataFrame:
    """(node, parent, depth, conv_id, parent_conv_id, n_convs, n_ends, n_children, n_leaves, saved_tokens) of the trie of keyed conversations.

    One row for each distinct prefix of whole turns, the empty one included where there is a conversation at all; conv_id is the
    least of its members, parent that of the prefix a turn shorter (NULL at the root), n_ends the members that end there. Copies of a
    conversation are counted before keys are put in ranges. An empty table gives no rows.
    """
    distinct = staged(keys.groupBy("key", "lens").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")), "prefix-keys")
    rows, size = distinct.agg(F.count("*"), F.sum(F.octet_length("key"))).first()
    ranges = Ranges.of(distinct, ["key"], max(1, -(-rows // RANGE_KEYS), -(-(size or 0) // RANGE_BYTES)))
    part, at = Ranges.PART, Ranges.AT
    firsts = ranges.rows.filter(F.col(at).bitwiseAND((1 << PLACE_BITS) - 1) == 0).select(part, F.col("key").alias("first"))
    ends = ranges.rows.groupBy(part).agg(F.max(at).alias(at))
    lasts = ranges.rows.join(ends, [part, at]).select(part, F.col("key").alias("last"))
    # One row for each range; the order of the ranges is that of the keys.
    order = W.orderBy(part)
    edges = firsts.join(lasts, part).select(F.col(part).alias("range"), F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))
    made = staged(ranges.rows.groupBy(part).cogroup(edges.groupBy("range")).applyInArrow(_nodes, FIELDS), "prefix-nodes")
    sums = [F.sum(c).alias(c) for c in NAMES if c.startswith("n_") or c == "saved_tokens"]
    shared = staged(
        made.filter("shared").groupBy("node", "parent", "depth").agg(F.min("conv_id").alias("conv_id"), *sums), "prefix-shared"
    )
    results = [n for n in NAMES if not n.endswith("shared")]
    # Children of shared nodes take the parent's least member from it; a parent of very many is copied.
    upper = shared.select(F.col("node").alias("parent"), F.col("conv_id").alias("upper"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    lower = made.filter("NOT shared AND parent_shared").unionByName(shared.filter("parent IS NOT NULL"), allowMissingColumns=True)
    lower = lower.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(upper, ["parent", "salt"])
    whole = made.filter("NOT shared AND NOT parent_shared").select(results)
    return whole.unionByName(lower.withColumn("parent_conv_id", F.col("upper")).select(results)).unionByName(
        shared.filter("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long")).select(results)
    )


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of the conversations of a table of turns, as `nodes` gives it; other columns are not read."""
    return nodes(staged(keyed(sequences(df, conv_col, turn_col, role_col, text_col)), "prefix-convs"))


def ends_digests(keys: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes at which conversations end: of their ids, ascending, joined by commas.

    Ids are put in order and joined block by block, before the shuffle as far as they are there; a node's blocks then run through
    one digest, a block at a time, since it can only be made in that order.
    """
    block = F.floor(F.col("conv_id") / BLOCK).alias("block")
    blocks = keys.groupBy("node", block).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, running = None, None

        def made(done):
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["node", "ends_sha256"])

        for batch in batches:
            done = []
            for node, part in zip(batch.column("node").to_pylist(), batch.column("part").to_pylist()):
                if node == current:
                    running.update(b",")
                else:
                    if running:
                        done.append((current, running.hexdigest()))
                    current, running = node, hashlib.sha256()
                running.update(part.encode())
            if done:
                yield made(done)
        if running:
            yield made([(current, running.hexdigest())])

    ordered = blocks.repartition("node").sortWithinPartitions("node", "block").select("node", "part")
    return ordered.mapInArrow(run, "node binary, ends_sha256 string")


def rebuilt(convs: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Sequences whose first turns come from another conversation: the first h of c - c % every, then c's own after its first h; h = crc32(c) % most."""
    own = convs.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    bases = convs.filter(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.slice("ids", 1, most).alias("base_ids"), F.slice("lens", 1, most).alias("base_lens")
    )
    joined = own.join(bases, "base", "left")

    def of(name: str, kind: str) -> Column:
        begun = F.coalesce(F.slice(f"base_{name}", F.lit(1), F.col("h")), F.array().cast(f"array<{kind}>"))
        return F.concat(begun, F.slice(name, F.col("h") + 1, F.greatest(F.size(name), F.lit(1)))).alias(name)

    return joined.select("conv_id", of("ids", "string"), of("lens", "int"))


def op12_prefixes(spark, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations."""
    convs = staged(sequences(table(spark, sf_dir, "conversations")), "prefix-turns")
    keys = staged(keyed(rebuilt(convs)), "prefix-convs")
    none = hashlib.sha256().hexdigest()
    found = nodes(keys).join(ends_digests(keys), "node", "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")
    )


OP12_SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
convs AS (
  SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (
  SELECT c, turns, c - c % 100 AS base,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM convs, crc),
rebuilt AS (
  SELECT a.c, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns FROM heads a LEFT JOIN convs b ON b.c = a.base),
steps AS (SELECT c, len(turns) AS whole, unnest(range(len(turns) + 1)) AS d, turns FROM rebuilt),
members AS (SELECT c, d, whole, turns[1:d] AS p FROM steps),
nodes AS (
  SELECT p, any_value(d) AS d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = whole), '')) AS ends_sha256,
         CASE WHEN any_value(d) = 0 THEN 0 ELSE (count(*) - 1) * length(any_value(p[d].text)) END AS saved
  FROM members GROUP BY p),
children AS (SELECT p[1:d - 1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
known AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN children k USING (p)),
below AS (SELECT up.p, sum(up.leaf)::BIGINT AS n_leaves, sum(up.saved)::BIGINT AS saved_tokens
          FROM (SELECT p[1:k] AS p, leaf, saved FROM (SELECT p, (n_children = 0)::INT AS leaf, saved, unnest(range(d + 1)) AS k FROM known)) up GROUP BY 1)
SELECT a.conv_id, a.d AS depth, b.conv_id AS parent_conv_id, a.n_convs, a.n_children, x.n_leaves, x.saved_tokens, a.ends_sha256
FROM known a JOIN below x USING (p) LEFT JOIN nodes b ON a.d > 0 AND b.p = a.p[1:a.d - 1]
"""
