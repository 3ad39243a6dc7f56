"""Cuthill-McKee order of bipartite graphs: both sides numbered in the order of a breadth-first search.

The search starts at the first side's vertex of the lowest degree, and again at the lowest one left when a component
is done; a vertex's new neighbours follow in the order of degree, then id. All components are searched at once, level
by level: a level's new vertices are ranked by the place of the first vertex that names them, then degree, then id, in
one sort by ranges, so no queue and no task holds a level. As many rounds as the deepest component has levels; the last
two levels are all that a round reads besides the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.canonical import numbered
from edgeloom.operators.components import components
from edgeloom.shared import cut, dropped_at_end, new_folder


def bandwidth(edges: DataFrame) -> int:
    """The largest distance of an edge from the diagonal, sides numbered each from 0."""
    return edges.agg(F.coalesce(F.max(F.abs(F.col("src") - F.col("dst"))), F.lit(0)).alias("b")).first().b


def cuthill_mckee(edges: DataFrame) -> DataFrame:
    """``side, old_id, new_id`` of a bipartite graph ``edges(src, dst)``, sides numbered each from 0: side 0 are sources."""
    spark = edges.sparkSession
    place = new_folder(spark, "cuthill-mckee")
    with dropped_at_end(spark):
        ends = edges.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("src").alias("old_id")), F.struct(F.lit(1).alias("side"), F.col("dst").alias("old_id")))).alias("e"))
        counts = ends.groupBy("e.side", "e.old_id").agg(F.count("*").alias("degree"))
        # the sides in one id space: even and odd
        vertices = cut(counts.withColumn("id", 2 * F.col("old_id") + F.col("side")), "vertices")
        links = cut(edges.select((2 * F.col("src")).alias("src"), (2 * F.col("dst") + 1).alias("dst")).distinct(), "links")
        both = cut(links.select(F.col("src").alias("id"), F.col("dst").alias("to")).unionByName(links.select(F.col("dst").alias("id"), F.col("src").alias("to"))), "both")
        starts = components(links).join(vertices.where("side = 0"), "id").groupBy("component").agg(F.min(F.struct("degree", "id")).alias("first"))
        level = numbered(starts.select("first.degree", "first.id"), "degree", "id", name="number")
        level = level.select("id", "number", F.col("number").alias("start"))
        levels: list[DataFrame] = []
        while not level.isEmpty():
            named = both.join(level, "id").groupBy(F.col("to").alias("id")).agg(F.min("number").alias("parent"), F.min("start").alias("start"))
            if levels:  # neighbours of a level are in the one before, if not new
                named = named.join(levels[-1].select("id"), "id", "left_anti")
            levels.append(level.withColumn("level", F.lit(len(levels))))
            ranked = numbered(named.join(vertices.select("id", "degree"), "id"), "parent", "degree", "id", name="number")
            level = ranked.select("id", "number", "start")  # stored where it was ranked
        if not levels:
            spark.createDataFrame([], "side int, old_id long, new_id long").write.parquet(place)
        else:
            found = levels[0]
            for other in levels[1:]:
                found = found.unionByName(other)
            found = cut(found.join(vertices.select("id", "side", "old_id"), "id").select("side", "old_id", "start", "level", "number"), "visited")
            ranked = numbered(found, "side", "start", "level", "number", name="place")
            first = found.where("side = 0").count()
            ranked.select("side", "old_id", (F.col("place") - F.when(F.col("side") == 1, first).otherwise(0)).alias("new_id")).write.parquet(place)
    return spark.read.parquet(place)
