"""From raw edges to a graph: duplicates, dense vertex numbers, relabelling, sizes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.curves import curve_order
from edgeloom.shared import cut

_ROW = (1 << 33) - 1


#: Operators whose work should not be done twice.
_DEAR = re.compile(r"Aggregate|Join|Python|Arrow|Pandas|Distinct|Window|Deduplicate|Intersect|Except")


def _stored(frame: DataFrame) -> DataFrame:
    """``frame``, stored if its plan has more than scans, projections, filters and unions: a sort by ranges reads its input twice."""
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    operators = (line.lstrip(" :+-").split(" ")[0].split("[")[0] for line in plan.splitlines())
    return cut(frame, "unranked") if any(_DEAR.search(o) for o in operators) else frame


def numbered(frame: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """Add each row's place, from 0, in the order of the columns ``order``.

    Rows are dealt out by ranges and sorted there; only the parts' sizes, a row a part, are summed up. The ranges come
    from a sample, which reads the input once more, so that is stored first where it is dear.
    """
    mark, frame = "_place", _stored(frame)
    sorted_ = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(sorted_.withColumn(mark, F.monotonically_increasing_id()), "numbered")
    part, row = F.shiftright(mark, 33), F.col(mark).bitwiseAND(F.lit(_ROW))
    sizes = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    offsets = frame.sparkSession.createDataFrame(starts, "_part long, _start long")
    joined = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return joined.withColumn(name, F.col("_start") + row).select(*frame.columns, name)


def distinct_edges(edges: DataFrame, drop_self_loops: bool = False) -> DataFrame:
    """``src, dst`` once each; self-loops stay unless told otherwise."""
    edges = edges.select("src", "dst").where("src is not null and dst is not null")
    return (edges.where("src <> dst") if drop_self_loops else edges).distinct()


def endpoints(edges: DataFrame) -> DataFrame:
    """Every id at either end, once."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def vertex_ranks(edges: DataFrame) -> DataFrame:
    """``old_id, new_id``: vertices numbered densely from 0 in ascending order of their ids."""
    return numbered(endpoints(edges).withColumnRenamed("id", "old_id"), "old_id", name="new_id")


def relabel(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Replace both ends by ``ids(old_id, new_id)``; other columns, such as a weight, stay with their edge."""
    others = [c for c in edges.columns if c not in ("src", "dst")]
    source = ids.select(F.col("old_id").alias("src"), F.col("new_id").alias("_src"))
    target = ids.select(F.col("old_id").alias("dst"), F.col("new_id").alias("_dst"))
    joined = edges.join(source, "src").join(target, "dst")
    return joined.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), *others)


def compress(edges: DataFrame, drop_self_loops: bool = False) -> tuple[DataFrame, DataFrame]:
    """Distinct, densely numbered edges, and the map that numbered them."""
    edges = cut(distinct_edges(edges, drop_self_loops), "edges")
    ids = vertex_ranks(edges)
    return relabel(edges, ids), ids


def check_permutation(ids: DataFrame) -> None:
    """Raise unless ``ids(old_id, new_id)`` maps 0..n-1 one to one onto itself."""
    x = ids.agg(F.count("*").alias("n"), F.countDistinct("old_id").alias("a"), F.countDistinct("new_id").alias("b"),
                F.min(F.least("old_id", "new_id")).alias("low"), F.max(F.greatest("old_id", "new_id")).alias("high")).first()
    if x.n and not (x.n == x.a == x.b and x.low == 0 and x.high == x.n - 1):
        raise ValueError("not a permutation of 0..n-1")


def stats(edges: DataFrame) -> DataFrame:
    """One row: vertices, edges, largest id, and the curve's order over ids up to it."""
    row = edges.agg(F.count("*").alias("m"), F.max(F.greatest("src", "dst")).alias("max_id"))
    n = endpoints(edges).agg(F.count("*").alias("n"))
    width = F.greatest(F.lit(1), F.length(F.bin("max_id"))).cast("long")
    return n.join(row).select("n", "m", "max_id", F.coalesce(width, F.lit(1)).alias("curve_order"))


def order_of(edges: DataFrame) -> int:
    """The curve's order for the edges' ids; one small aggregate."""
    most = edges.agg(F.max(F.greatest("src", "dst")).alias("m")).first().m
    return curve_order((most or 0) + 1)


def bipartite(edges: DataFrame, n1: int) -> DataFrame:
    """One id space for both sides: destinations follow the ``n1`` sources."""
    return edges.withColumn("dst", F.col("dst") + n1)
