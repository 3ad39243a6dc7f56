"""Vertex orders: identity, by degree, by first visit; and orders of edges along a curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions.curves import hilbert_key, hilbert_key_batches
from edgeloom.operators.adjacency import degrees
from edgeloom.operators.canonical import numbered


def identity_order(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("old_id"), F.col("id").alias("new_id"))


def degree_order(edges: DataFrame) -> DataFrame:
    """``old_id, new_id`` by descending total degree, smaller ids first."""
    total = degrees(edges).select(F.col("id").alias("old_id"), (F.col("in_deg") + F.col("out_deg")).alias("_deg"))
    return numbered(total, F.desc("_deg"), F.col("old_id"), name="new_id").select("old_id", "new_id")


def bipartite_degree_order(edges: DataFrame) -> DataFrame:
    """``side, old_id, new_id``: sources by descending out-degree, then destinations by in-degree, in one id space."""
    ends = edges.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("src").alias("id")), F.struct(F.lit(1).alias("side"), F.col("dst").alias("id")))).alias("e"))
    counts = ends.groupBy("e.side", "e.id").agg(F.count("*").alias("_deg")).withColumnRenamed("id", "old_id")
    return numbered(counts, F.col("side"), F.desc("_deg"), F.col("old_id"), name="new_id").select("side", "old_id", "new_id")


def relabel_sides(edges: DataFrame, order: DataFrame) -> DataFrame:
    """Relabel a bipartite graph by ``bipartite_degree_order``; weights stay with their edges."""
    others = [c for c in edges.columns if c not in ("src", "dst")]
    source = order.where("side = 0").select(F.col("old_id").alias("src"), F.col("new_id").alias("_src"))
    target = order.where("side = 1").select(F.col("old_id").alias("dst"), F.col("new_id").alias("_dst"))
    return edges.join(source, "src").join(target, "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), *others)


def first_visit_order(edges: DataFrame) -> DataFrame:
    """``old_id, new_id`` of destinations in the order in which sources, ascending, first name them."""
    first = edges.groupBy(F.col("dst").alias("old_id")).agg(F.min("src").alias("_first"))
    return numbered(first, "_first", "old_id", name="new_id").select("old_id", "new_id")


def with_hilbert(edges: DataFrame, order: int, batches: bool = False) -> DataFrame:
    """Add ``h``, the edge's Hilbert index; ``batches`` computes it in Arrow batches instead of in SQL."""
    key = hilbert_key_batches(order)("src", "dst") if batches else hilbert_key("src", "dst", order)
    return edges.withColumn("h", key)


def hilbert_ranks(edges: DataFrame, order: int) -> DataFrame:
    """Edges with ``h`` and their place along the curve."""
    return numbered(with_hilbert(edges, order, batches=True), "h", name="rank")


def cluster_by_hilbert(edges: DataFrame, order: int, files: int) -> DataFrame:
    """Edges laid out along the curve: written so, Parquet's minima and maxima let box queries skip data."""
    return with_hilbert(edges, order, batches=True).repartitionByRange(files, "h").sortWithinPartitions("h")


def box(edges: DataFrame, src_from: int, src_to: int, dst_from: int, dst_to: int) -> DataFrame:
    """Edges in a half-open box; the four comparisons reach the scan."""
    return edges.where((F.col("src") >= src_from) & (F.col("src") < src_to) & (F.col("dst") >= dst_from) & (F.col("dst") < dst_to))
