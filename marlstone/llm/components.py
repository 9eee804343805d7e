"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.sources import scratch


def large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def mark(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame) -> DataFrame:
    """(id, label) for every end of a link (u, v): the smallest id that links reach; its own row too.

    Each round replaces links by links to smaller ids; it ends when a round changes
    nothing, after O(log n) rounds for usual graphs. Every round is written to the shared
    folder, so a lost executor costs one round.
    """
    links = scratch.table(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    seen = mark(links)
    while seen[0]:
        links = scratch.table(small_star(large_star(links)), "links")
        now = mark(links)
        if now == seen:
            break
        seen = now
    return links.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
