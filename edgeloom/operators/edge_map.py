"""The edge map over Hilbert blocks: a product of the block-partitioned matrix with a vector.

Edges lie along the curve in their blocks, and consecutive blocks of about ``RUN_EDGES`` edges are a run. A run's edges
from one stripe of ``STRIPE`` sources are a cell, one row of the stored layout; so a vertex with most edges has many
cells, and none has more edges than a run. A round sends to each cell the values of its stripe, not its edges to
the values: cells are stored in buckets by their number, which the join keeps. A task adds up what its cells give to each
destination, so what is shuffled after it is a row for each destination that a batch of cells has met. The stripe of a
hub is asked for by many cells: these are dealt to salts of ``FAN`` cells each, and the stripe is repeated for each salt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.operators import blocking
from edgeloom.operators.canonical import order_of
from edgeloom.shared import cut

STRIPE = 4_096
RUN_EDGES = 16_384
FAN = 64
#: Edges of a bucket of the stored layout, about; at least as many buckets as there are shuffle partitions, if edges allow.
BUCKET_EDGES = 4_000_000
BLOCK_EDGES = 1_024
#: What all stripes' values may have to be broadcast, as a bound from the stripes' number; beyond it they are sent to cells.
BROADCAST_BYTES = 16 << 20


class Layout:
    """Edges as cells ``cell, stripe, sources, destinations``: sources are places in the stripe, destinations ascend.

    ``edges`` are read several times and should be stored. ``store`` keeps a table in buckets, as ``shared.bucketed`` gives it; the layout is good as long as those last.
    """

    def __init__(self, edges: DataFrame, store: Callable, most: int = BLOCK_EDGES, run_edges: int = RUN_EDGES, fan: int = FAN, buckets: int | None = None, broadcast_bytes: int = BROADCAST_BYTES):
        edges = edges.select("src", "dst")
        assigned, m = blocking.block_of_edges(edges, order_of(edges), most), edges.count()
        if buckets is None:
            parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            buckets = max(1, -(-m // BUCKET_EDGES), min(parts, m // run_edges))
        start = F.min("place").over(Window.partitionBy("depth", "prefix"))  # a block has fewer than ``most`` edges
        stripe = F.floor(F.col("src") / STRIPE)
        rows = assigned.select((F.col("src") % STRIPE).cast("int").alias("source"), "dst", F.floor(start / run_edges).alias("run"), stripe.alias("stripe"))
        pairs = F.array_sort(F.collect_list(F.struct("dst", "source"))).alias("pairs")
        cells = rows.groupBy("run", "stripe").agg(pairs)
        number = F.shiftleft("run", 20).bitwiseOR(F.col("stripe")).alias("cell")  # ids are below 2 ** 31: 2 ** 19 stripes
        cells = cells.select(number, "stripe", F.col("pairs.source").alias("sources"), F.col("pairs.dst").alias("destinations"))
        self.cells = store(cells, "cells", buckets, "cell")
        asked = self.cells.select("cell", "stripe")
        counts = cut(asked.groupBy("stripe").agg(F.ceil(F.count("*") / fan).alias("salts")), "stripes")
        self.asked = cut(asked.join(counts, "stripe").select("cell", "stripe", F.pmod(F.xxhash64("cell"), "salts").alias("salt")), "asked")
        self.salts, self.few = counts, counts.count() * STRIPE * 12 <= broadcast_bytes

    def sums(self, values: DataFrame) -> DataFrame:
        """``id, total``: over each destination's edges the sum of ``values(id, value)`` of their sources; a source without a value gives nothing."""
        rows = values.select(F.floor(F.col("id") / STRIPE).alias("stripe"), (F.col("id") % STRIPE).cast("int").alias("at"), F.col("value").cast("double").alias("value"))
        slices = rows.groupBy("stripe").agg(F.collect_list("at").alias("at"), F.collect_list("value").alias("value"))
        cells = self.cells.select("cell", "stripe", "sources", "destinations")
        if self.few:
            met = cells.join(F.broadcast(slices), "stripe")
        else:
            fanned = slices.join(self.salts, "stripe").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
            sent = self.asked.join(fanned, ["stripe", "salt"]).select("cell", "at", "value")
            met = cells.join(sent.hint("merge"), "cell")
        met = met.select("sources", "destinations", "at", "value")
        return met.mapInArrow(_add, "id long, total double").groupBy("id").agg(F.sum("total").alias("total"))


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values, one behind the other, and where each list ends."""
    return np.asarray(column.flatten()), np.cumsum(np.asarray(column.value_lengths(), dtype=np.int64))


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    dense = np.zeros(STRIPE)
    for batch in batches:
        (sources, ends), (destinations, _), (at, at_ends), (value, _) = (_lists(c) for c in batch.columns)
        given = np.empty(len(sources))
        for low, high, a, b in zip([0, *ends[:-1]], ends, [0, *at_ends[:-1]], at_ends):
            dense[:] = 0
            dense[at[a:b]] = value[a:b]
            given[low:high] = dense[sources[low:high]]
        ids, where = np.unique(destinations, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.bincount(where, given, len(ids)))], names=["id", "total"])
