"""Near-duplicate documents by SimHash fingerprints, linked with pigeonring filtering.

Fingerprints are cut into segments on a ring. Of two fingerprints within the distance, the ring
has a start from which every chain of segments stays within its share of the distance:
the first l segments differ in at most floor(l * distance / segments) bits. The start of such a
chain fixes some segments to be equal; these are the join key. Within a key the whole chain
is tested, and only pairs that pass it get the full Hamming test.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralake.llm.common import id_and_text, map_texts, staged, table
from terralake.llm.components import components

SEED, BITS = 42, 64
#: Hashes whose bits are counted at once.
COUNTED = 1 << 16
#: Fingerprints of one key that a task takes at once; larger keys are dealt out as pairs of blocks.
BLOCK = 50_000
#: One in so many fingerprints tells which keys are that large.
PART = 16


def fingerprint(text: str, shingle: int = 4) -> int:
    """Words are runs of anything but ASCII white space; a bit is set if over half the hashes have it."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[shingle - 1 :])]
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), COUNTED):
        part = np.array(hashes[at : at + COUNTED], dtype="<u8")
        bits = np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, BITS)
        counts += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, more: Sequence[Column] = ()) -> DataFrame:
    """(id, fp) for each row, fp the fingerprint as a signed 64-bit integer. NULL is the empty text, of fingerprint zero.

    Columns in `more` stand between them.
    """

    def make():
        def of_texts(texts: list[str]) -> list[pa.Array]:
            return [pa.array(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))]

        return of_texts

    return map_texts(id_and_text(df, id_col, text_col, *more), make, "fp long").withColumnRenamed("id", id_col)


def segments(count: int) -> list[int]:
    """Masks of the ring's segments, of widths as equal as can be."""
    cuts = [BITS * i // count for i in range(count + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]


def chain_keys(distance: int, count: int, equal: int) -> list[tuple[int, tuple[int, ...]]]:
    """Starts of chains, each with segments that its budgets leave equal: every chain that stays
    within its budgets has its start and one of the listed sets of `equal` segments in all."""

    def grow(chosen: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        if len(chosen) == equal:
            yield chosen
            return
        # With c segments equal so far, the next equal one comes before the budget allows l - c differing ones.
        last = next(length for length in range(len(chosen) + 1, count + 1) if length - len(chosen) > length * distance // count)
        for at in range(chosen[-1] + 1, last):
            yield from grow((*chosen, at))

    return [(start, tuple((start + i) % count for i in chosen)) for start in range(count) for chosen in grow((0,))]


def forest(fps: np.ndarray, start: int, distance: int, masks: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that connect what the pairs of these fingerprints connect, at most one for each fingerprint."""
    count = len(masks)
    budgets = [length * distance // count for length in range(1, count + 1)]
    from_start = np.roll(masks, -start)
    rest, a, b = fps, [], []
    while len(rest):
        reached = [rest[0]]
        rest = rest[1:]
        while reached and len(rest):
            one = reached.pop()
            differs = rest ^ one
            ok = np.ones(len(rest), dtype=bool)
            so_far = np.zeros(len(rest), dtype=np.uint8)
            for mask, budget in zip(from_start, budgets):
                so_far += np.bitwise_count(differs & mask)
                ok &= so_far <= budget
                if not ok.any():
                    break
            near = rest[ok]
            near = near[np.bitwise_count(near ^ one) <= distance]
            if len(near):
                a += [one] * len(near)
                b += near.tolist()
                reached += near.tolist()
                rest = rest[~np.isin(rest, near)]
    return a, b


def links(fps: DataFrame, distance: int = 4, count: int = 7, equal: int = 3) -> DataFrame:
    """Links (a, b) between the distinct values of column fp that connect all within the distance.

    Pairs within the distance share a key. Inside a key a spanning forest stands for its pairs,
    so a group of near copies gives as many links as it has fingerprints. Keys with more than
    BLOCK fingerprints are dealt out as all pairs of blocks.
    """
    ring = segments(count)
    keys = chain_keys(distance, count, equal)
    signed = lambda x: x - (1 << BITS) if x >> (BITS - 1) else x
    entries = [
        F.struct(F.lit(k).cast("short").alias("k"), F.col("fp").bitwiseAND(F.lit(signed(sum(ring[s] for s in held)))).alias("held"))
        for k, (_, held) in enumerate(keys)
    ]
    keyed = fps.select("fp").distinct().select("fp", F.explode(F.array(*entries)).alias("e")).select("e.k", "e.held", "fp")
    # What is held by very many is found from a part of the fingerprints: how a key is dealt out changes the work, not the links.
    # There are at most (fingerprints * keys / BLOCK) of them, by the estimate; the copy to each task spares the keys a shuffle of their own.
    part = keyed.filter(F.pmod(F.xxhash64(F.lit("part"), "fp"), F.lit(PART)) == 0).groupBy("k", "held").agg((F.count("*") * PART).alias("n")).filter(F.col("n") > BLOCK)
    dealt = (
        keyed.join(F.broadcast(part), ["k", "held"], "left")
        .withColumn("blocks", F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1).cast("long")))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("k", "held", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp")
    )
    group = ["k", "held", "x", "y"]
    masks = np.array(ring, dtype=np.uint64)
    starts = [start for start, _ in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        current = None
        a: list[int] = []
        b: list[int] = []

        def settle():
            if current is not None:
                whole = np.concatenate(held)
                if len(whole) > 1:
                    x, y = forest(whole, starts[current[0]], distance, masks)
                    a.extend(x)
                    b.extend(y)

        def made():
            pair = [pa.array(np.array(v, dtype=np.uint64).view(np.int64)) for v in (a, b)]
            return pa.RecordBatch.from_arrays(pair, names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(name).to_numpy(zero_copy_only=False) for name in group]
            fp = batch.column("fp").to_numpy().view(np.uint64)
            changes = np.zeros(batch.num_rows, dtype=bool)
            for c in columns:
                changes[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(changes).tolist(), batch.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                key = tuple(int(c[s]) for c in columns)
                if key != current:
                    settle()
                    current, held = key, []
                held.append(fp[s:e])
            if len(a) > 100_000:
                yield made()
                a, b = [], []
        settle()
        yield made()

    # A pair of blocks is counted where it is sorted, without a shuffle of its own; fingerprints that share nothing stay out of Python.
    shared = dealt.repartition(*group).selectExpr(*group, "fp", "count(*) OVER (PARTITION BY k, held, x, y) AS n").filter("n > 1").drop("n")
    return shared.sortWithinPartitions(*group).mapInArrow(run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, more: Sequence[Column] = ()) -> DataFrame:
    """(id, fp, component_id) and the columns in `more` for each row: component_id is the smallest id linked to it over any number of links.

    Fingerprints of words in lower-case ASCII; texts without words have fingerprint zero and
    are linked like any other; NULL is the empty text. Rows with a NULL id are kept and may take
    the component of others; a component of NULL ids only has a NULL component_id. Repeated
    rows and ids give one row each. Other columns are not carried. An empty table gives no rows.
    """
    marked = staged(fingerprints(df, id_col, text_col, shingle, more), "fingerprints")
    first = marked.groupBy("fp").agg(F.min(id_col).alias("first"))
    roots = components(links(first, distance))
    rooted = staged(
        first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots"
    )
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(lowest, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select(id_col, "fp", "component_id", *(c for c in marked.columns if c not in (id_col, "fp")))


#: Of texts of 0.8 similarity in five-word shingles, changed in scattered words, nine in ten lie so near in one of two fingerprints of their words.
WORD_SEEDS, WORD_DISTANCE, WORD_SEGMENTS, WORD_EQUAL = (42, 43), 6, 10, 3
#: Copies of a group's first text, so that a group of very many is compared with it in several tasks.
SALTS = 32


def word_fingerprints(text: str) -> list[int]:
    """One fingerprint for each of WORD_SEEDS, over the distinct words: an edit changes one word, but five shingles."""
    words = set(text.encode("utf-8").lower().split())
    made = []
    for seed in WORD_SEEDS:
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), dtype="<u8", count=len(words))
        counts = np.zeros(BITS, dtype=np.int64)
        for at in range(0, len(hashes), COUNTED):
            bits = np.unpackbits(hashes[at : at + COUNTED].view(np.uint8), bitorder="little").reshape(-1, BITS)
            counts += np.add.reduce(bits, axis=0, dtype=np.int64)
        made.append(int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0]))
    return made


def shingles(text: str, size: int = 5) -> np.ndarray:
    """Hashes of the distinct shingles; of fewer words the whole sequence, of none nothing."""
    words = text.encode("utf-8").lower().split()
    found = {b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in found), dtype="<u8", count=len(found)).view(np.int64))


def _jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def _near(nodes: DataFrame) -> DataFrame:
    """(node, root) of the texts that chains of near fingerprints connect: a superset of those that are similar."""
    found = None
    for k in range(len(WORD_SEEDS)):
        fp = F.col(f"fp_{k}").alias("fp")
        firsts = staged(nodes.groupBy(fp).agg(F.min("key").alias("rep")), "similar-fingerprints")
        same = nodes.select("key", fp).join(firsts, "fp").filter("key != rep").select(F.col("key").alias("a"), F.col("rep").alias("b"))
        near = links(firsts, WORD_DISTANCE, WORD_SEGMENTS, WORD_EQUAL)
        one, two = (firsts.select(F.col("fp").alias(c), F.col("rep").alias(f"rep_{c}")) for c in "ab")
        near = near.join(one, "a").join(two, "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
        found = same.union(near) if found is None else found.union(same).union(near)
    return components(found)


def similar_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, size: int = 5) -> DataFrame:
    """(id, of_text, component_id) for each row: component_id is the smallest id connected to it by texts whose distinct shingles of `size` words, in lower case, are similar.

    Candidates come from the pigeonring filter over two fingerprints of the texts' words; every link is confirmed on the shingles. In a group of candidates each text is
    compared with one of them, and those that are not similar to it with all near ones of the group, so a group of near copies costs as many comparisons as it has texts. of_text is the text's
    hash; equal texts are one. Texts without words are similar to each other. NULL is the empty text. Rows with a NULL id may take the component of others; one of NULL ids only has none.
    Repeated rows and ids give one row each; a very long text is read whole. Other columns are not carried. An empty table gives no rows.
    """
    key = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("key")

    def make():
        def of_texts(texts: list[str]) -> list[pa.Array]:
            made = np.array([word_fingerprints(t) for t in texts], dtype=np.uint64).view(np.int64).reshape(-1, len(WORD_SEEDS))
            return [pa.array(c) for c in made.T]

        return of_texts

    fields = ", ".join(f"fp_{k} long" for k in range(len(WORD_SEEDS)))
    texts = staged(map_texts(id_and_text(df, id_col, text_col, key), make, fields), "similar-words")
    nodes = staged(texts.groupBy("key").agg(F.min("id").alias("first"), *(F.min(f"fp_{k}").alias(f"fp_{k}") for k in range(len(WORD_SEEDS)))), "similar-texts")
    groups = staged(_near(nodes).withColumnRenamed("node", "key").join(nodes, "key"), "similar-groups")
    # Of each text that has a candidate, one row's text is read once more.
    wanted = groups.select("key", F.col("first").alias("wanted"))
    rows = id_and_text(df, id_col, text_col, key).join(wanted, "key").filter(F.col("id").eqNullSafe(F.col("wanted"))).select("text", "key").dropDuplicates(["key"])
    sets = map_texts(rows, lambda: lambda ts: [pa.array([shingles(t, size) for t in ts], pa.list_(pa.int64()))], "shingles array<long>")
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    members = staged(groups.join(sets, "key").withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")), "similar-members")
    heads = members.filter("key = root").select("root", F.col("shingles").alias("head"), salt)
    judged = staged(members.join(heads, ["root", "salt"]).withColumn("linked", _jaccard(F.col("shingles"), F.col("head")) >= similarity).drop("head"), "similar-judged")
    own = ["key", "shingles", "linked", *(f"fp_{k}" for k in range(len(WORD_SEEDS)))]
    others = judged.filter("NOT linked").select("root", salt, *(F.col(c).alias(f"own_{c}") for c in own))
    near = [F.bit_count(F.col(f"fp_{k}").bitwiseXOR(F.col(f"own_fp_{k}"))) <= WORD_DISTANCE for k in range(len(WORD_SEEDS))]
    pairs = others.alias("o").join(
        judged.alias("j"),
        (F.col("o.root") == F.col("j.root")) & (F.col("o.salt") == F.col("j.salt")) & (F.col("linked") | (F.col("key") < F.col("own_key"))) & (near[0] | near[1])
        & (_jaccard(F.col("shingles"), F.col("own_shingles")) >= similarity),
    )
    # Of the texts linked to the first one, any connects.
    found = pairs.groupBy("own_key", F.when(~F.col("linked"), F.col("key")).alias("to")).agg(F.min("key").alias("key")).select(F.col("own_key").alias("a"), F.col("key").alias("b"))
    whole = judged.filter("linked AND key != root").select(F.col("key").alias("a"), F.col("root").alias("b")).union(found)
    roots = components(whole).withColumnRenamed("node", "key")
    rooted = staged(nodes.join(roots, "key", "left").select("key", "first", F.coalesce("root", "key").alias("root")), "similar-roots")
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(lowest, "root").select("key", "component_id")
    return texts.join(classes, "key").select(F.col("id").alias(id_col), F.col("key").alias("of_text"), "component_id")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
