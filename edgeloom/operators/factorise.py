"""Matrix factorisation by gradient descent: a vector of factors a vertex, fitted to the weights of edges.

In a round every edge's error, its weight less the product of its ends' vectors, pulls each end along the other end's
vector; all ends move at once by ``step`` times their sums. This is plain descent over all edges, not alternating
least squares. A stripe of sources and one of destinations are a cell, whose edges are stored once, in buckets, and
don't move again. A round sends a vertex's vector to each cell that has the vertex, once for all its edges there, and
gets one sum of pulls back from it. A cell that a hub makes too large is dealt to several, so no task has a hub's edges.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.canonical import endpoints
from edgeloom.shared import bucketed, cut, drop, dropped_at_end, new_folder, release_shuffles

RANK = 20
STEP = 3.5e-7
#: Vertices of a stripe and edges of a cell, about; a cell of over twice as many is dealt to several.
STRIPE = 65_536
CELL_EDGES = 2_000_000
#: A cell for each core is made only of so many edges or more.
FEW_EDGES = 16_384
BUCKET_EDGES = 1_000_000
#: Edges of a cell whose vectors are laid out at a time.
CHUNK = 1 << 17
_GRADIENTS = pa.schema([("id", pa.int64()), ("gradient", pa.list_(pa.float64()))])


def spread_start(vertices: DataFrame, rank: int = RANK) -> DataFrame:
    """``id, factors``: a start that depends on the id alone, evenly spread over (0, 1]."""
    numbers = F.sequence(F.lit(0), F.lit(rank - 1))
    return vertices.select("id", F.transform(numbers, lambda k: ((F.col("id") * 7919 + k * 104729) % 1000 + 1) / F.lit(1000.0)).alias("factors"))


def _product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def _errors(edges: DataFrame, factors: DataFrame) -> DataFrame:
    """Edges with both ends' vectors ``a, b`` and the ``error``."""
    joined = edges.join(factors.select(F.col("id").alias("src"), F.col("factors").alias("a")), "src")
    joined = joined.join(factors.select(F.col("id").alias("dst"), F.col("factors").alias("b")), "dst")
    return joined.select("src", "dst", "a", "b", (F.col("weight") - _product(F.col("a"), F.col("b"))).alias("error"))


def _stripes(m: int, sources: int, destinations: int, least: int) -> tuple[int, int]:
    """Stripes of sources and of destinations: ``least`` cells or more, of about CELL_EDGES edges and 2 * STRIPE vertices at most.

    Sources go to each of their cells, as many as there are stripes of destinations at most, and the other way round: the
    numbers are those that send the fewest vectors.
    """
    cells = max(-(-m // CELL_EDGES), min(least, m // FEW_EDGES), 1)
    rows, columns = (max(1, -(-n // STRIPE)) for n in (sources, destinations))

    def fitting(p: int) -> tuple[int, int]:
        return max(rows, p), max(columns, -(-cells // max(rows, p)))

    return min((fitting(2**i) for i in range(cells.bit_length() + 1)), key=lambda x: sources * x[1] + destinations * x[0])


def _layout(edges: DataFrame, store: Callable, least: int | None = None) -> DataFrame:
    """``edges(src, dst, weight)`` with their ``cell``, stored in buckets by it."""
    spark = edges.sparkSession
    edges = edges.where("src is not null and dst is not null and weight is not null")
    m, sources, destinations = edges.agg(F.count("*"), F.approx_count_distinct("src"), F.approx_count_distinct("dst")).first()
    p, q = _stripes(m, sources, destinations, spark.sparkContext.defaultParallelism if least is None else least)
    ends = F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")
    stripe = F.pmod(F.xxhash64(ends[0]), F.lit(p)) * q + F.pmod(F.xxhash64(ends[1]), F.lit(q))
    rows = edges.select(stripe.alias("stripe"), *ends, "weight", F.xxhash64(F.monotonically_increasing_id()).alias("mark"))
    # a hub's edges are dealt to several cells
    sizes = rows.groupBy("stripe").agg(F.ceil(F.count("*") / (2 * CELL_EDGES)).alias("salts"))
    rows = rows.join(sizes.where("salts > 1").hint("merge"), "stripe", "left") if not sizes.where("salts > 1").isEmpty() else rows.withColumn("salts", F.lit(1))
    cell = F.shiftleft("stripe", 20) + F.pmod("mark", F.coalesce("salts", F.lit(1)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, min(4 * p * q, max(parts, m // BUCKET_EDGES)))
    return store(rows.select(cell.alias("cell"), "src", "dst", "weight"), "factor_cells", buckets, "cell")


def _pulled(edges: pa.Table, factors: pa.Table) -> pa.Table:
    """``id, gradient``: what a cell's edges add to the gradients of its vertices, whose vectors ``factors`` has."""
    ids = np.asarray(factors.column("id"))
    if not len(ids) or not edges.num_rows:
        return _GRADIENTS.empty_table()
    order = np.argsort(ids)
    ids, lists = ids[order], factors.column("factors").combine_chunks()
    vectors = np.ascontiguousarray(np.asarray(lists.flatten()).reshape(len(ids), -1)[order].T)
    total = np.zeros_like(vectors)
    for at in range(0, edges.num_rows, CHUNK):
        some = edges.slice(at, CHUNK)
        src, dst, weight = (np.asarray(some.column(c)) for c in ("src", "dst", "weight"))
        s, d = (np.minimum(np.searchsorted(ids, x), len(ids) - 1) for x in (src, dst))
        own = (ids[s] == src) & (ids[d] == dst)  # a given start may lack vertices
        s, d, weight = s[own], d[own], weight[own]
        a, b = vectors[:, s], vectors[:, d]
        error = weight - np.einsum("ke,ke->e", a, b)
        for k in range(len(total)):
            total[k] += np.bincount(s, error * b[k], len(ids)) + np.bincount(d, error * a[k], len(ids))
    offsets = pa.array(np.arange(len(ids) + 1) * len(total), pa.int32())
    return pa.Table.from_arrays([pa.array(ids), pa.ListArray.from_arrays(offsets, pa.array(total.T.reshape(-1)))], schema=_GRADIENTS)


def factorise(edges: DataFrame, iterations: int, rank: int = RANK, step: float = STEP, start: DataFrame | None = None) -> DataFrame:
    """``id, factors`` after the rounds; ``edges(src, dst[, weight])``, a missing weight being 1."""
    spark = edges.sparkSession
    result = new_folder(spark, "factors")
    with dropped_at_end(spark), bucketed(spark) as store:
        weighted = edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))
        edges = cut(weighted.select("src", "dst", F.col("weight").cast("double").alias("weight")), "weighted")
        factors = spread_start(endpoints(edges), rank) if start is None else start.select("id", "factors")
        schema, place = factors.schema, result

        def stored(frame: DataFrame, last: bool) -> DataFrame:
            nonlocal place
            before, place = place, result if last else new_folder(spark, "factors")
            frame.write.parquet(place)
            if before != result:
                drop(spark, before)
            release_shuffles(spark)
            return spark.read.schema(schema).parquet(place)

        factors = stored(factors, not iterations)
        if iterations:
            cells = _layout(edges, store)
            asked = cut(cells.select("cell", F.explode(F.array("src", "dst")).alias("id")).distinct(), "asked")
        for done in range(1, iterations + 1):
            sent = asked.join(factors.select(F.col("id").cast("long").alias("id"), "factors").hint("merge"), "id").select("cell", "id", "factors")
            pulls = cells.groupBy("cell").cogroup(sent.groupBy("cell")).applyInArrow(_pulled, "id long, gradient array<double>")
            sums = [F.sum(F.col("gradient")[k]).alias(f"g{k}") for k in range(rank)]
            moves = pulls.groupBy("id").agg(*sums).select("id", F.array(*(F.col(f"g{k}") for k in range(rank))).alias("gradient"))
            new = F.when(F.col("gradient").isNull(), F.col("factors")).otherwise(F.zip_with("factors", "gradient", lambda x, g: x + F.lit(step) * g))
            moved = factors.join(moves.hint("merge"), "id", "left").select(F.col("id").cast(schema["id"].dataType).alias("id"), new.alias("factors"))
            factors = stored(moved, done == iterations)
    return factors


def squared_error(edges: DataFrame, factors: DataFrame) -> float:
    """The sum of squared errors over ``edges(src, dst, weight)``."""
    return _errors(edges, factors).agg(F.coalesce(F.sum(F.col("error") * F.col("error")), F.lit(0.0)).alias("s")).first().s
