"""Connected components of a graph of links, as rounds of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralake.llm.common import staged


def _least(links: DataFrame) -> DataFrame:
    """Each node with the smallest of itself and its neighbours."""
    return links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours are linked to the smallest node of the neighbourhood."""
    both = links.union(links.select("b", "a"))
    return both.join(_least(both), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Nodes and their smaller neighbours are linked to the smallest of them."""
    stars = links.join(_least(links), "a")
    return stars.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node it is connected to.

    `links` has two bigint columns a and b. Rows with a NULL and links of a node with itself count
    for nothing. Rounds of large-star and small-star until nothing changes, about the logarithm
    of the longest path; each is written, and only a count and a sum go to the driver.
    """
    now = staged(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = mark(now)
    while before[0]:
        now = staged(_small_star(_large_star(now)), "links")
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
