"""Connected components of links between ids, with stars that contract round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import stored


#: Links in a file of the tables written between rounds.
FILE_LINKS = 1_000_000


def components(links: DataFrame, about: int) -> DataFrame:
    """`(id, component_id)` for every id of `links` (`a, b`, any order): the smallest id it can reach.

    `about` is the number of links to expect; it only sets the number of files.

    Alternates large and small stars: every id hands its larger neighbours, then its smaller ones, over to
    the smallest it knows. Rounds grow with the logarithm of the longest path. Each round is written to the
    shared folder; only two sums per round reach the driver. A hub is a hot key of a join with a one-row-per-id
    side, which adaptive execution splits.
    """
    now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                 .distinct(), "links", 1 + about // FILE_LINKS)
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
                        ).first()
        if state == before or state["n"] == 0:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
        before = state
        now = stored(_small_star(_large_star(now)), "links", 1 + state["n"] // FILE_LINKS)


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).union(moved).distinct()
