"""Shards of near-equal bytes as the leaves of a k-d tree, in DataFrame and SQL functions only.

Equal texts are one point of the tree, with the sum of their bytes as weight. A node that is to give
several shards is split at the weighted quantile of the dimension along which its points
spread widest. Quantiles are found digit by digit: each round sums the bytes of the nodes' points by the next
digit of their coordinate and keeps the digit in which the quantile lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from terralake.llm.common import staged, table

#: Coordinates have DIGITS digits of DIGIT bits: first the dimension's value, then bits of the text's hash that part ties.
DIGIT, DIGITS, VALUE_BITS = 8, 5, 16
BITS = DIGIT * DIGITS
#: A split may miss its aim by this share of a shard; else another dimension is taken if it does better.
SLACK = 0.02
#: A group of copies of more than this share of a shard is cut by id.
LARGEST_GROUP = 0.5
#: Rows numbered together.
NUMBERED = 50_000
DIMENSIONS = ["by_size", "by_age", "by_source"]


def size_of(text: str) -> Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1


def _coordinate(value: Column, low: Column, high: Column, tie: Column) -> Column:
    """Value scaled to VALUE_BITS bits within its range, then bits of the hash."""
    scaled = F.when(high > low, F.floor((value - low) * float((1 << VALUE_BITS) - 1) / (high - low))).otherwise(0).cast("long")
    return F.shiftleft(scaled, BITS - VALUE_BITS).bitwiseOR(F.shiftrightunsigned(tie, 64 - (BITS - VALUE_BITS)))


def _points(rows: DataFrame, target: float) -> DataFrame:
    """One row for each text (and piece of a very large group), with its bytes and coordinates."""
    whole = rows.groupBy("hash", "crc", "size").agg(
        F.sum("size").alias("bytes"), F.min("id").cast("double").alias("first"), F.min(F.xxhash64("source")).cast("double").alias("from")
    )
    pieces = F.greatest(F.lit(1), F.ceil(F.col("bytes") / (target * LARGEST_GROUP))).cast("long")
    whole = whole.withColumn("pieces", pieces).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    whole = whole.withColumn("weight", F.col("bytes") / F.col("pieces")).withColumn("log_size", F.log2(F.col("size").cast("double")))
    ends = whole.agg(*(f(c).alias(f"{n}_{c}") for c in ("log_size", "first", "from") for n, f in (("low", F.min), ("high", F.max)))).first()
    tie = F.xxhash64("hash", "crc", "size", "piece")
    made = []
    for name, c in zip(DIMENSIONS, ("log_size", "first", "from")):
        low, high = F.lit(ends[f"low_{c}"]).cast("double"), F.lit(ends[f"high_{c}"]).cast("double")
        made.append(_coordinate(F.coalesce(F.col(c), low), low, high, tie).alias(name))
    return whole.select("hash", "crc", "size", "piece", "pieces", "weight", *made)


def _cuts(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """(node, dim, cut, width, miss): where each dimension has the node's quantile, its spread, and by how many bytes the cut misses."""
    long = points.join(nodes, "node").select(
        "node", "weight", "aim", F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(c).alias("at")) for d, c in enumerate(DIMENSIONS)))).alias("c")
    ).select("node", "weight", "aim", "c.dim", "c.at")
    # What is known of each cut so far: the digits before it and the bytes below them.
    known = nodes.select("node", "aim", F.explode(F.sequence(F.lit(0), F.lit(len(DIMENSIONS) - 1))).alias("dim"), F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("below"))
    spread = long.groupBy("node", "dim").agg((F.max("at") - F.min("at")).alias("width"))
    order = W.partitionBy("node", "dim").orderBy("digit")
    for k in range(DIGITS):
        shift = BITS - DIGIT * (k + 1)
        inside = long.select("node", "dim", "weight", F.shiftright("at", shift).alias("upto")).join(known, ["node", "dim"])
        inside = inside.filter(F.shiftright("upto", DIGIT) == F.col("prefix"))
        sums = inside.groupBy("node", "dim", F.col("upto").bitwiseAND((1 << DIGIT) - 1).alias("digit")).agg(
            F.sum("weight").alias("bytes"), F.first("aim").alias("aim"), F.first("prefix").alias("prefix"), F.first("below").alias("below")
        )
        running = sums.withColumn("until", F.col("below") + F.sum("bytes").over(order))
        # The first digit that reaches the aim; the last one if rounding leaves none.
        reached = F.min(F.when(F.col("until") >= F.col("aim"), F.col("digit"))).over(W.partitionBy("node", "dim"))
        chosen = running.withColumn("chosen", F.coalesce(reached, F.max("digit").over(W.partitionBy("node", "dim")))).filter("digit = chosen")
        if k == DIGITS - 1:
            break
        known = staged(
            chosen.select("node", "aim", "dim", F.shiftleft("prefix", DIGIT).bitwiseOR(F.col("digit")).alias("prefix"), (F.col("until") - F.col("bytes")).alias("below")),
            "shard-cuts",
        )
    # Points up to the cut go left: with the last digit or without it, whichever comes nearer.
    upto = F.shiftleft("prefix", DIGIT).bitwiseOR(F.col("digit"))
    over, under = F.col("until") - F.col("aim"), F.col("aim") - (F.col("until") - F.col("bytes"))
    cut = chosen.select("node", "dim", F.when(over <= under, upto).otherwise(upto - 1).alias("cut"), F.least(over, under).alias("miss"))
    return cut.join(spread, ["node", "dim"])


def _leaves(points: DataFrame, many: int, target: float) -> DataFrame:
    """Points with the shard of their leaf. Nodes are known by their first shard; each split is a round over the points."""
    placed = staged(points.withColumn("node", F.lit(0)).withColumn("takes", F.lit(many)), "shard-points")
    most = many
    while most > 1:
        open_nodes = placed.filter("takes > 1").groupBy("node", "takes").agg(F.sum("weight").alias("bytes"))
        nodes = staged(
            open_nodes.select("node", "takes", (F.col("bytes") * F.floor(F.col("takes") / 2) / F.col("takes")).alias("aim")), "shard-nodes"
        )
        cuts = _cuts(nodes.select("node", "aim"), placed.filter("takes > 1").drop("takes"))
        good = F.col("miss") <= F.lit(SLACK * target)
        # The widest dimension that can be cut well; if none can, the one that misses least.
        first = F.row_number().over(W.partitionBy("node").orderBy(good.desc(), F.when(good, -F.col("width")).otherwise(F.col("miss").cast("double")), "dim"))
        best = staged(cuts.withColumn("place", first).filter("place = 1").select("node", "dim", "cut"), "shard-splits")
        at = F.element_at(F.array(*DIMENSIONS), F.col("dim") + 1)
        left = F.col("dim").isNull() | (at <= F.col("cut"))
        half = F.floor(F.col("takes") / 2).cast("int")
        placed = staged(
            placed.join(best, "node", "left").select(
                *(c for c in placed.columns if c not in ("node", "takes")),
                F.when(left, F.col("node")).otherwise(F.col("node") + half).alias("node"),
                F.when(F.col("dim").isNull(), F.col("takes")).when(at <= F.col("cut"), half).otherwise(F.col("takes") - half).alias("takes"),
            ),
            "shard-points",
        )
        most -= most // 2
    return placed.withColumn("shard", F.col("node"))


def numbered(rows: DataFrame, shard: str, order: str) -> DataFrame:
    """Adds slot, gapless from 0 within each shard; no task gets more than about NUMBERED rows of one shard."""
    parts = max(1, -(-rows.count() // NUMBERED))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(order, "crc"), F.lit(parts)))
    counts = dealt.groupBy(shard, "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy(shard).orderBy("part")) - F.col("n")).drop("n")
    inner = F.row_number().over(W.partitionBy(shard, "part").orderBy(order))
    return dealt.withColumn("inner", inner).join(before, [shard, "part"]).withColumn("slot", F.col("before") + F.col("inner") - 1).drop("part", "inner", "before")


def shards(df: DataFrame, count: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for each row; law is bytes, grown_shard NULL.

    Give the number of shards, or the bytes that a shard should have. Sizes are the text's UTF-8 bytes plus one,
    NULL counting as no text. Rows of equal texts stay together unless they make more than LARGEST_GROUP of a shard;
    then they are dealt out by id. Repeated rows are rows of their own. Dimensions are the size, the
    smallest id of the text and a hash of its source; an id that is no number counts as the lowest.
    An empty table gives no rows.
    """
    text = F.col(text_col).cast("string")
    rows = staged(
        df.select(
            F.col(id_col).alias("doc"), F.try_to_number(F.col(id_col).cast("string"), F.lit("S9999999999999999999")).cast("long").alias("id")
            if isinstance(df.schema[id_col].dataType, T.StringType) else F.col(id_col).cast("long").alias("id"),
            text.alias("text"), F.col(source_col).cast("string").alias("source"),
        ).select("doc", "id", "source", size_of("text").alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), F.crc32(F.coalesce("text", F.lit(""))).alias("crc")),
        "shard-rows",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    many = count or max(1, round(total / target_bytes))
    target = max(1.0, total / many)
    leaves = _leaves(_points(rows, target), many, target).select("hash", "crc", "size", "piece", "pieces", "shard")
    keys = ["hash", "crc", "size"]
    same = [rows[c] == leaves[c] for c in keys] + [F.pmod(F.xxhash64(rows["doc"]), leaves["pieces"]) == leaves["piece"]]
    placed = staged(rows.join(leaves, same).select(rows["doc"], rows["size"], rows["crc"], "shard"), "shard-placed")
    return numbered(placed, "shard", "doc").select(
        F.col("doc").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_shards(spark, sf_dir: str) -> DataFrame:
    """Every document in one of eight shards of near-equal bytes."""
    return shards(table(spark, sf_dir, "documents"), count=8)
