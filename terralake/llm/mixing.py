"""Mixing sources to target weights by systematic sampling, in DataFrame and SQL functions only.

Each source gets a target from its weight; what a source cannot give is shared among the others. Every
document of a source expects the same number of copies. Along one order of the source, by size, the expected
copies are summed up from a random offset, and a document is taken once for each whole number that its
part of the sum crosses. The sum is made range by range, so no task holds a source.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terralake.llm.common import staged, table, unused
from terralake.operators.scan import Ranges

#: Weights of the sources by rank, repeating; all words that the mix takes, as a share of all there are; words taken of a source at most, as a multiple of its own.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Copies are summed in whole numbers of this part of one; an offset is as many hex digits of a digest.
UNIT_DIGITS = 6
UNIT = 16**UNIT_DIGITS
WORD = "[^\\x20\\x09-\\x0D]+"


def words(text_col: str) -> Column:
    """Runs of anything but ASCII white space; NULL has none."""
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _weight(weights: Sequence[float] | Mapping[str | None, float]) -> Column:
    if isinstance(weights, Mapping):
        named = [x for k, v in weights.items() if k is not None for x in (F.lit("0" + k), F.lit(float(v)))]
        own = F.try_element_at(F.create_map(*named), F.col("key")) if named else F.lit(None)
        return F.coalesce(F.when(F.col("key") == "1", float(weights.get(None, 0.0))).otherwise(own), F.lit(0.0)).cast("double")
    return F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))


def targets(sizes: DataFrame, weights: Sequence[float] | Mapping[str | None, float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(key, source_size, weight, target) from (key, source_size), one row a source, written.

    Weights by rank go to the sources in the order of their keys and repeat; weights by name leave out sources that have none. The targets
    add up to `share` of all sizes, or to less if all sources are full. A source is full at `most` times its size. With the sources in the
    order of size over weight, those that are full come first: a source is full if its part of what the ones before it leave is too much for it.
    """
    ranked = Ranges.of(sizes, ["key"]).numbered("rank").done()
    room = F.col("source_size") * F.lit(float(most))
    weighed = staged(
        ranked.withColumn("weight", _weight(weights)).withColumn("room", room)
        .withColumn("need", F.when(F.col("weight") > 0, F.col("room") / F.col("weight")).otherwise(F.lit(float("inf")))),
        "mix-weights",
    )
    words_in_all, weight_in_all = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    wanted, weight_in_all = float(words_in_all or 0) * share, float(weight_in_all or 0)
    before = Ranges.of(weighed, ["need", "key"]).running("rooms", F.col("room")).running("weights", F.col("weight")).done()
    left, weight_left = F.lit(wanted) - (F.col("rooms") - F.col("room")), F.lit(weight_in_all) - (F.col("weights") - F.col("weight"))
    full = staged(before.withColumn("full", (F.col("weight") > 0) & (F.col("need") <= F.try_divide(left, weight_left))), "mix-full")
    taken, weight_taken = full.agg(F.sum(F.when(F.col("full"), F.col("room"))), F.sum(F.when(F.col("full"), F.col("weight")))).first()
    rest = F.try_divide(F.lit(wanted - (taken or 0.0)), F.lit(weight_in_all - (weight_taken or 0.0)))
    target = F.when(F.col("full"), F.col("room")).when(F.col("weight") > 0, F.col("weight") * rest).otherwise(0.0)
    return full.select("key", "source_size", "weight", target.alias("target"))


def offset(seed: str, key: Column) -> Column:
    """The random part of one copy at which a source's sum begins, in units."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key)), 1, UNIT_DIGITS), 16, 10).cast("long")


def mix(
    df: DataFrame, weights: Sequence[float] | Mapping[str | None, float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """(id, size, source, source_size, target, copies) for each row: how many copies of it the mix holds.

    Sizes are words; NULL and empty texts have none and may have copies, which weigh nothing; a very long text is one document like any
    other. NULL is a source, the last. The copies of a source's documents differ by one at most, and by the order along sizes its taken words
    miss the target by less than its longest document. Ties in size are put in order by a digest of id, then the text's hash; rows that are equal
    in all of these may swap their copies, nothing else. The same rows and seed give the same mix, however they are stored. Repeated rows and ids
    are rows of their own. An empty table gives no rows. Other columns are not carried.
    """
    source, text = F.col(source_col).cast("string"), F.col(text_col).cast("string")
    # Written first: ranges are found by a pass of their own, which is not to read the texts again.
    rows = staged(df.select(
        F.col(id_col).alias("id"), source.alias("source"), words(text_col).alias("size"),
        F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source)).alias("key"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("tie"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"),
    ), "mix-sizes")
    ranges = Ranges.of(rows, ["key", "size", "tie", "hash"])
    parts = staged(ranges.before(["key"], [F.count("*").alias("docs"), F.sum("size").alias("words")]), "mix-parts")
    shares = targets(parts.groupBy("key").agg(F.sum("words").alias("source_size")), weights, share, most)
    copies = F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)) * UNIT).cast("long")
    spans = parts.join(shares, "key").select(
        Ranges.PART, "key", "source_size", "target", copies.alias("expected"), (F.col("docs_before") * copies + offset(seed, F.col("key"))).alias("start")
    )
    upto = F.col("start") + F.sum("expected").over(W.partitionBy(Ranges.PART, "key").orderBy(Ranges.AT).rowsBetween(W.unboundedPreceding, W.currentRow))
    crossed = F.floor(F.col("upto") / UNIT) - F.floor((F.col("upto") - F.col("expected")) / UNIT)
    made = ranges.rows.join(spans, [Ranges.PART, "key"]).withColumn("upto", upto)
    return made.select(F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", crossed.cast("int").alias("copies"))


def mixed(df: DataFrame, weights: Sequence[float] | Mapping[str | None, float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix",
          id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", copy_col: str = "copy") -> DataFrame:
    """The mix itself: each row as often as it is taken, all columns kept, with the number of the copy from 1.

    A column of that name is replaced. As `mix` in all else.
    """
    row = unused(df, "row_number")
    numbered = staged(df.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    # Rows are matched by their own number; the id still decides ties.
    ids = F.struct(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(row).alias("row"))
    narrow = numbered.select(ids.alias("both"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{source_col}`").alias("source"))
    found = mix(narrow.withColumn("id", F.to_json("both")), weights, share, most, seed, "id", "text", "source").filter("copies > 0")
    taken = found.select(F.get_json_object("id", "$.row").cast("long").alias(row), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(copy_col))
    return numbered.drop(copy_col).join(taken, row).drop(row)


def op13_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    found = mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


OP13_SQL = f"""
WITH docs AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key, md5('mix' || coalesce(doc_id::VARCHAR, '')) AS tie,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (
  SELECT key, source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY key) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM (SELECT key, sum(size)::BIGINT AS source_size FROM docs GROUP BY key)),
needs AS (SELECT *, source_size * 2.0::DOUBLE AS room, source_size * 2.0::DOUBLE / weight AS need FROM sources),
wanted AS (SELECT sum(source_size)::DOUBLE * 1.5::DOUBLE AS words, sum(weight) AS weights FROM needs),
filled AS (
  SELECT key, source_size, weight, room,
         coalesce(need <= (words - coalesce(sum(room) OVER before, 0)) / nullif(weights - coalesce(sum(weight) OVER before, 0), 0), FALSE) AS is_full
  FROM needs, wanted WINDOW before AS (ORDER BY need, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rest AS (
  SELECT (max(words) - coalesce(sum(room) FILTER (is_full), 0)) / nullif(max(weights) - coalesce(sum(weight) FILTER (is_full), 0), 0) AS per_weight FROM filled, wanted),
shares AS (
  SELECT key, source_size, CASE WHEN is_full THEN room ELSE weight * per_weight END AS target FROM filled, rest),
summed AS (
  SELECT doc_id, size, source_size, target, coalesce(floor(target / nullif(source_size, 0) * {UNIT}), 0)::BIGINT AS expected,
         ('0x' || substr(md5('mix' || key), 1, {UNIT_DIGITS}))::BIGINT
         + row_number() OVER (PARTITION BY key ORDER BY size, tie) * coalesce(floor(target / nullif(source_size, 0) * {UNIT}), 0)::BIGINT AS upto
  FROM docs JOIN shares USING (key))
SELECT doc_id, size, source_size, target, (upto // {UNIT} - (upto - expected) // {UNIT}) * size AS taken FROM summed
"""
