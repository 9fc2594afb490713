"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datasonde.functions.shared import kept

MAX_ROUNDS = 100


def _large_star(links: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least of its neighbourhood."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of those."""
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b")
    return others.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the least node of its component.

    Each round is checkpointed in the shared folder. The links stay as many as they were at
    most, and a node with many of them is folded before it is shuffled; the rounds grow with
    the logarithm of the longest path. Only a count and a checksum come to the driver.
    """
    links = kept(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(MAX_ROUNDS):
        links = kept(_small_star(_large_star(links)))
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            roots = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
            return roots.unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        seen = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
