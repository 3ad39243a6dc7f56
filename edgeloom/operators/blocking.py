"""Adaptive blocks of the adjacency matrix along the Hilbert curve.

The matrix is quartered until a square has fewer than ``most`` edges, at depth MIN_DEPTH at the earliest.
An aligned square is a prefix of the Hilbert index, and counts only shrink with depth, so an edge's block
is one deeper than the deepest crowded square over it. In the order of the curve a square's edges follow each
other, so a square is crowded if and only if the first and the last of some ``most`` consecutive edges are in it.
That turns the recursion into one sort and a sliding maximum: each edge is compared with the one ``most`` - 1
places on, and takes the deepest square that any such pair around it shares. Nothing is iterated or collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions.curves import hilbert_key, power_of_two
from edgeloom.operators.adjacency import running_total
from edgeloom.operators.canonical import numbered
from edgeloom.operators.ordering import with_hilbert
from edgeloom.shared import cut

MIN_DEPTH = 5
#: Places that one window partition has at least; it has eight times ``most`` if that is more.
PART = 50_000


def check_most_edges(m: int, most: int) -> None:
    """The limit that a program sets on ``most`` before blocking."""
    if most > power_of_two(m // 16):
        raise ValueError(f"at most {power_of_two(m // 16)} edges a block make sense for {m} edges")


def _prefix(order: int, depth: Column | int) -> Column:
    return F.call_function("shiftright", F.col("h"), (2 * (F.lit(order) - depth)).cast("int"))


def _common_depth(a: Column, b: Column, order: int) -> Column:
    """The depth of the smallest square that holds both indices."""
    differing = a.bitwiseXOR(b)
    bits = F.when(differing == 0, 0).otherwise(F.length(F.bin(differing)))
    return (F.lit(order) - F.floor((bits + 1) / 2)).cast("int")


def settle(keyed: DataFrame, order: int, most: int) -> DataFrame:
    """Edges with their ``place`` along the curve, and the ``depth`` and ``prefix`` of their block.

    Places are dealt into parts; a part also gets the ``most`` places before and behind it, as its windows reach there.
    """
    if most < 2:
        raise ValueError("blocks of fewer than one edge don't exist: most must be at least 2")
    size = -(-max(PART, 8 * most) // most) * most
    part = F.floor(F.col("place") / size)
    inside = F.col("place") - part * size
    beside = F.array_compact(F.array(part, F.when(inside < most, part - 1), F.when(inside >= size - most, part + 1)))
    rows = numbered(keyed, "h", name="place").withColumn("_own", part).withColumn("_part", F.explode(beside)).where("_part >= 0")
    rows = rows.withColumn("_group", F.floor(F.col("place") / most))
    along = Window.partitionBy("_part").orderBy("_group", "place")
    rows = rows.withColumn("_shared", _common_depth(F.col("h"), F.lead("h", most - 1).over(along), order))
    # the maximum over the last ``most`` places: to the end of the group in which they begin, and from the next one's start
    group = Window.partitionBy("_part", "_group")
    rows = rows.withColumn("_since", F.max("_shared").over(group.orderBy("place")))
    rows = rows.withColumn("_until", F.max("_shared").over(group.orderBy(F.desc("place"))))
    deepest = F.coalesce(F.greatest("_since", F.lag("_until", most - 1).over(along)), F.lit(-1))
    rows = rows.withColumn("depth", F.least(F.lit(order), F.greatest(F.lit(min(MIN_DEPTH, order)), deepest + 1)))
    rows = rows.where("_part = _own").withColumn("prefix", _prefix(order, F.col("depth")))
    return rows.select(*keyed.columns, "place", "depth", "prefix")


def block_of_edges(edges: DataFrame, order: int, most: int) -> DataFrame:
    """Edges with ``h``, their ``place`` along the curve, the ``depth`` of their block and its ``prefix``."""
    return settle(with_hilbert(edges, order, batches=True), order, most)


def blocks(assigned: DataFrame, order: int) -> DataFrame:
    """``idx, x, y, side_len, nnz`` of each block of ``assigned`` edges; idx is the index of its smallest corner."""
    shift = F.lit(order) - F.col("depth")
    side = F.call_function("shiftleft", F.lit(1).cast("long"), shift)
    groups = assigned.groupBy("depth", "prefix").agg(F.count("*").alias("nnz"), F.min("src").alias("s"), F.min("dst").alias("d"))
    corners = groups.select("nnz", side.alias("side_len"), (F.col("s") - F.pmod("s", side)).alias("x"), (F.col("d") - F.pmod("d", side)).alias("y"))
    return corners.select(hilbert_key("x", "y", order).alias("idx"), "x", "y", "side_len", "nnz")


def checked(found: dict[str, int], m: int) -> dict[str, int]:
    """``found``, numbers of ``blocks`` and of their ``edges``; raises unless those are all ``m``."""
    if found["edges"] != m:
        raise ValueError(f"{found['edges']} of {m} edges are in blocks")
    return found


def check_all_assigned(blocks_: DataFrame, m: int) -> dict[str, int]:
    """The same of a table of blocks."""
    return checked(blocks_.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("nnz"), F.lit(0)).alias("edges")).first().asDict(), m)


def block_edges(assigned: DataFrame) -> DataFrame:
    """``src, dst, h, place``: the flattened edges in block order, which is the order of h; weights stay."""
    return assigned.drop("depth", "prefix")


def block_index(blocks_: DataFrame) -> DataFrame:
    """``block, idx, end``: twice the running number of edges, block by block."""
    total = running_total(blocks_.select("idx", "nnz"), "idx", "nnz", "before")
    placed = total.select("idx", (2 * (F.col("before") + F.col("nnz"))).alias("end"))
    return numbered(placed, "idx", name="block").select("block", "idx", "end")


def block(edges: DataFrame, order: int, most: int) -> DataFrame:
    """Block metadata of a graph."""
    return blocks(block_of_edges(edges, order, most), order)


def merge_blocks(blocks_: DataFrame, most: int) -> DataFrame:
    """Neighbouring blocks merged greedily along the curve: ``segment, block, blocks, idx, nnz``.

    From the first block on, a segment takes blocks while their edges stay under ``most``; ``block`` and ``idx`` are its
    first block's. A block that alone has ``most`` edges or more is a segment. Where a segment that starts at a block would
    end, is known from the running sums for every block at once: the ends that are smaller than its own bound come before it
    in one sort. The starts that are really met from block 0 on are found by pointer doubling, so the rounds are
    logarithmic in the segments and nothing is scanned in one task.
    """
    total = running_total(blocks_.select("idx", "nnz"), "idx", "nnz", "before")
    placed = cut(numbered(total, "idx", name="block"), "blocks")
    # the number of ends under before + most: the rows before a bound's that are not bounds, of which there are ``block``;
    # at equal keys a bound comes first, as such an end is not under it
    ends = placed.select((F.col("before") + F.col("nnz")).alias("key"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("block"))
    bounds = placed.select((F.col("before") + most).alias("key"), F.lit(0).alias("kind"), "block")
    ranked = numbered(ends.unionByName(bounds), "key", "kind", "block", name="place").where("kind = 0")
    following = F.greatest(F.col("place") - F.col("block"), F.col("block") + 1)
    jumps = cut(ranked.select("block", following.alias("next")), "jumps")
    met, found = placed.where("block = 0").select("block"), 0
    while True:
        met = cut(met, "starts")
        now = met.count()
        if now == found:
            break
        found = now
        after = met.join(jumps, "block").select(F.col("next").alias("block")).join(placed.select("block"), "block", "left_semi")
        met = met.unionByName(after).distinct()
        further = jumps.select(F.col("block").alias("next"), F.col("next").alias("_next"))
        jumps = cut(jumps.join(further, "next").select("block", F.col("_next").alias("next")), "jumps")
    marks = met.select("block", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("idx"), F.lit(None).cast("long").alias("nnz"))
    rows = numbered(marks.unionByName(placed.select("block", F.lit(1).alias("kind"), "idx", "nnz")), "block", "kind", name="place").where("kind = 1")
    segment = (F.col("place") - F.col("block") - 1).alias("segment")
    return rows.groupBy(segment).agg(F.min("block").alias("block"), F.count("*").alias("blocks"), F.min("idx").alias("idx"), F.sum("nnz").alias("nnz"))
