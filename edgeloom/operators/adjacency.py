"""Degrees, adjacency and offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.operators.canonical import numbered


def degrees(edges: DataFrame) -> DataFrame:
    """``id, in_deg, out_deg`` of every vertex, zeros included; one aggregation over both ends."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.i").alias("in_deg"), F.sum("e.o").alias("out_deg"))


def max_degrees(edges: DataFrame) -> DataFrame:
    return degrees(edges).agg(F.max("in_deg").alias("max_in"), F.max("out_deg").alias("max_out"))


def top_hubs(edges: DataFrame, k: int, incoming: bool = False) -> DataFrame:
    """The ``k`` vertices of the highest degree, smaller ids first among equals."""
    end = "dst" if incoming else "src"
    counts = edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias("deg"))
    return counts.orderBy(F.desc("deg"), "id").limit(k)


def _sides(incoming: bool) -> tuple[str, str]:
    return ("dst", "src") if incoming else ("src", "dst")


def offsets(edges: DataFrame, incoming: bool = False) -> DataFrame:
    """``id, start, degree``: where each vertex's neighbours begin in the compressed layout.

    An edge's place in the sorted edges is known from ranges and their sizes, and a vertex starts at its first
    edge; so no task sees more than its range, unlike with a running sum over all vertices.
    """
    key, other = _sides(incoming)
    placed = numbered(edges.select(F.col(key).alias("id"), F.col(other).alias("neighbour")), "id", "neighbour", name="place")
    own = placed.groupBy("id").agg(F.min("place").alias("start"), F.count("*").alias("degree"))
    return own


def all_offsets(edges: DataFrame, incoming: bool = False) -> DataFrame:
    """``offsets`` with vertices that have no such edges, which start where the next one starts."""
    own = degrees(edges).select("id", F.col("in_deg" if incoming else "out_deg").alias("degree"))
    return running_total(own, "id", "degree", "start")


def running_total(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over all rows before in ``order``, by parts: sums of ranges, then sums inside."""
    marked = numbered(rows, order, name="_rank")
    part = F.floor(F.col("_rank") / 100_000)
    sums = marked.groupBy(part.alias("_p")).agg(F.sum(value).alias("_s"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each 100,000
    sums = sums.select("_p", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_p").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    joined = marked.withColumn("_p", part).join(sums, "_p")
    total = F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return joined.withColumn(name, total).select(*rows.columns, name)


def adjacency(edges: DataFrame, incoming: bool = False) -> DataFrame:
    """``id, neighbours`` in ascending order, with ``weights`` if the edges have them.

    A list is one value of the result; analytics here work on edge rows and never need it.
    """
    key, other = _sides(incoming)
    if "weight" not in edges.columns:
        return edges.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list(other)).alias("neighbours"))
    both = F.array_sort(F.collect_list(F.struct(F.col(other).alias("n"), F.col("weight").alias("w")))).alias("both")
    lists = edges.groupBy(F.col(key).alias("id")).agg(both)
    return lists.select("id", F.col("both.n").alias("neighbours"), F.col("both.w").alias("weights"))


def adjacency_chunks(edges: DataFrame, size: int = 100_000, incoming: bool = False) -> DataFrame:
    """``id, chunk, neighbours``: adjacency in lists of ``size`` neighbours at most, in ascending order, with ``weights`` if the edges have them.

    A neighbour's place in its list is its edge's place less the vertex's first, so a hub is never one task's or one row's.
    """
    key, other = _sides(incoming)
    weights = ["weight"] if "weight" in edges.columns else []
    placed = numbered(edges.select(F.col(key).alias("id"), F.col(other).alias("neighbour"), *weights), "id", "neighbour", name="place")
    first = placed.groupBy("id").agg(F.min("place").alias("start"))
    chunk = F.floor((F.col("place") - F.col("start")) / size).alias("chunk")
    both = F.array_sort(F.collect_list(F.struct("neighbour", *weights))).alias("both")
    lists = placed.join(first, "id").groupBy("id", chunk).agg(both)
    return lists.select("id", "chunk", F.col("both.neighbour").alias("neighbours"), *(F.col(f"both.{w}").alias("weights") for w in weights))


def read_write_distance(edges: DataFrame, n: int) -> DataFrame:
    """One row: edges per vertex turned over (n / m), and the mean gap of consecutive neighbours in lists.

    An edge meets the one before it by their places in the order of lists, so a hub's list is many tasks'.
    """
    placed = numbered(edges.select("src", "dst"), "src", "dst", name="place")
    before = placed.select((F.col("place") + 1).alias("place"), F.col("src").alias("_src"), F.col("dst").alias("_dst"))
    joined = placed.join(before, "place", "left")
    gaps = joined.select(F.when(F.col("src") == F.col("_src"), F.abs(F.col("dst") - F.col("_dst"))).otherwise(0).alias("gap"))
    return gaps.agg((F.lit(float(n)) / F.count("*")).alias("read_distance"), (F.sum("gap") / F.count("*")).alias("write_distance"))
