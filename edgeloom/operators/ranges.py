"""Boxes as intervals of the Hilbert index, and counts in a box that stop at a cap.

A box is a union of aligned squares, O(side) of them, and each is one interval of the index. Squares are cut level by
level while no more than ``MOST_INTERVALS`` would have to be read; what the border squares that are left hold besides
the box is taken out by the four comparisons. So a read of edges that are stored along the curve takes the row groups
of some intervals, whatever the box's shape.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.curves import hilbert_index
from edgeloom.operators.ordering import box

MOST_INTERVALS = 64

Box = tuple[int, int, int, int]


def _merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open intervals in order, those that touch as one."""
    found: list[tuple[int, int]] = []
    for low, high in sorted(intervals):
        if found and low <= found[-1][1]:
            found[-1] = (found[-1][0], max(high, found[-1][1]))
        else:
            found.append((low, high))
    return found


def box_intervals(order: int, src_from: int, src_to: int, dst_from: int, dst_to: int, most: int = MOST_INTERVALS) -> list[tuple[int, int]]:
    """At most ``most`` half-open intervals of the index that hold every cell of the half-open box; cells beside the box only at its border."""
    side = 1 << order
    src_from, src_to, dst_from, dst_to = max(0, src_from), min(src_to, side), max(0, dst_from), min(dst_to, side)
    if src_from >= src_to or dst_from >= dst_to:
        return []
    inside: list[tuple[int, int]] = []
    border, before = [(0, 0)], []  # squares of the present depth that the box's border may cross
    for depth in range(order + 1):
        width, shift = side >> depth, 2 * (order - depth)
        crossed = []
        for x, y in border:
            a, b = x * width, y * width
            if a >= src_to or b >= dst_to or a + width <= src_from or b + width <= dst_from:
                continue
            if src_from <= a and a + width <= src_to and dst_from <= b and b + width <= dst_to:
                h = hilbert_index(x, y, depth)
                inside.append((h << shift, (h + 1) << shift))
            else:
                crossed.append((x, y))
        here = [hilbert_index(x, y, depth) for x, y in crossed]
        reached = _merged(inside + [(h << shift, (h + 1) << shift) for h in here])
        if depth and len(reached) > most:
            return before
        before, border = reached, [(2 * x + i, 2 * y + j) for x, y in crossed for i in (0, 1) for j in (0, 1)]
    return before


def in_intervals(h: Column, intervals: list[tuple[int, int]]) -> Column:
    """Whether ``h`` is in one of the intervals, as a shallow tree of comparisons that a scan can push down."""
    tests = [(h >= low) & (h < high) for low, high in intervals]
    while len(tests) > 1:
        tests = [reduce(lambda a, b: a | b, tests[i : i + 2]) for i in range(0, len(tests), 2)]
    return tests[0] if tests else F.lit(False)


def box_by_ranges(edges: DataFrame, order: int, bounds: Box, most: int = MOST_INTERVALS) -> DataFrame:
    """Edges of ``edges(src, dst, h)`` in a half-open box, read by intervals of ``h``."""
    return box(edges.where(in_intervals(F.col("h"), box_intervals(order, *bounds, most))), *bounds)


def capped_count(edges: DataFrame, cap: int) -> DataFrame:
    """``n``: the number of rows, or ``cap`` + 1 if there are more; no task counts further than that."""
    return edges.select(F.lit(1).alias("one")).limit(cap + 1).agg(F.count("*").alias("n"))
