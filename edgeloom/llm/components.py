"""Connected components by alternating large-star and small-star steps, on tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm import storage

#: Any graph of this many rounds' depth would have more nodes than can exist.
MOST_ROUNDS = 60


def _least(links: DataFrame) -> DataFrame:
    """Each node's smallest neighbour or itself.

    Grouped with a hash of u, so that a join on u has an exchange of its own here, without which AQE splits no hub.
    """
    return links.groupBy(F.xxhash64("u").alias("hash"), "u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour of u links to the smallest one of u's neighbourhood."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_least(both).hint("merge"), "u").where("v > u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """u and its smaller neighbours link to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = down.join(_least(down).hint("merge"), "u")
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``links(u, v)`` with an edge to another.

    A hub's rows are pre-aggregated before each shuffle of minima; joins on a hub are split by AQE. No join is
    a broadcast, as files of links to few centres are small for their rows. Each round's links are a table in the shared
    folder, so an executor's loss costs one round at most.
    """
    spark = links.sparkSession
    with storage.Scratch(spark, "links") as scratch:
        links = scratch.cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        before = None
        for _ in range(MOST_ROUNDS):
            links = scratch.cut(_small_star(_large_star(links)))
            scratch.drop_before(1)
            # done when a round changes nothing: every node's only link then goes to its star's centre
            sums = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if sums == before:
                centres = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
                return storage.cut(links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres), "components")
            before = sums
    raise RuntimeError("components did not settle")
