"""Connected components of a links table by alternating large-star and small-star steps; nothing leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _large_star(links: DataFrame) -> DataFrame:
    """Every node sends its larger neighbours to the least of its neighbourhood."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    moved = both.filter(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("u"))
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node sends its smaller neighbours, and itself, to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _done(links: DataFrame) -> bool:
    """Whether every node points at one other, and that one at none: what a step would leave as it is."""
    ends = links.select(F.col("a").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(links.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).filter("out > 1 OR (out > 0 AND into > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of long ids -> (node, component): each linked node with the least id it reaches.

    links is read once. Defined cases: repeated links and links of a node with itself change nothing; an empty table gives an
    empty result; ids are not null.
    """
    now = stage(links.select("a", "b").filter("a <> b"), "links")
    while True:
        now = stage(_small_star(_large_star(now)), "stars")
        if _done(now):
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
