"""Near-duplicate embeddings of equal label by dual traversal of cover trees: exact threshold pairs.

Equal vectors of a label are one point with a weight. A label of more than ``CELL`` points is split: points go to the
nearest of some of its points, chosen by hash, again and again until cells are small, so a label with most rows is
many tasks. Cells are the upper nodes: pairs of them are descended level by level as a table, dropped when their
centres are too far apart for their radii, and taken whole when near enough. Each cell's points get a cover tree, once
(``cover_tree``), and each pair of cells that is left is one task's dual traversal.

Neither pairs of points nor of copies leave a task: it gives a point's number of links and the set that it is
in. Links are summed by point, and sets that share points are joined by ``components``. All that a round makes is a
table in the shared folder.

Defined results: rows whose label or vector is null, whose vector is empty, zero, or holds null, NaN or infinite
components link with nothing, nor do vectors of different lengths; rows that repeat a vector link with each other;
a null id is nobody's component unless all its members' are null; an empty table gives no rows; other columns, of any
name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm import storage
from edgeloom.llm.components import components
from edgeloom.llm.cover_tree import MARGIN, Traversal, Tree, build, last_level, reach, units

COSINE = 0.93
#: Points that one tree has at most, and centres that a cell is split by at most; it has about twice as many as it would fill.
CELL = 8_192
CENTRES = 32
#: Splits of a cell; what is then still too large, such as countless multiples of one vector, is dealt by hash.
MOST_SPLITS = 6


def linkable(vector: Column) -> Column:
    """Whether a vector has a direction: components that are there and finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(vector: Column) -> Column:
    """The vector as doubles of length one."""
    def scaled(v: Column, by: Column) -> Column:
        return F.transform(v, lambda x: x.cast("double") / by)

    def of_length_one(v: Column) -> Column:
        return scaled(v, F.sqrt(F.aggregate(v, F.lit(0.0), lambda total, x: total + x * x)))

    largest = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    return F.transform(F.array(scaled(vector, largest)), of_length_one)[0]  # binds the value, which is used twice


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def _apart(dot: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot))


def _classes(vectors: DataFrame, cut) -> DataFrame:
    """``uid, label, e, n, first, node``: each label's different vectors, how many rows have them, and the smallest id."""
    rows = vectors.where(F.col("label").isNotNull() & linkable(F.col("e")))
    groups = rows.groupBy("label", "e").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    node = F.concat_ws("|", F.lit(""), F.size("e").cast("string"), F.col("label").cast("string"))
    return cut(groups.select(F.monotonically_increasing_id().alias("uid"), "label", "e", "n", "first", node.alias("node")))


def _bytes(*names: str) -> Column:
    return sum((F.octet_length(n) for n in names), F.lit(0)).cast("long")


def _to_centres(points: DataFrame, centres: DataFrame, broadcast_bytes: int) -> DataFrame:
    """``points`` with the number ``i`` of the nearest of their node's ``centres`` and ``apart``, its distance; null where there are none.

    Nodes' centres go to all tasks if they have ``broadcast_bytes`` at most; if not, they are joined and compared in the JVM.
    """
    size = 8 * F.size("centres") * F.size(F.get("centres", F.lit(0))) + _bytes("node")
    if (centres.agg(F.sum(size).alias("n")).first().n or 0) > broadcast_bytes:
        best = F.transform(F.array(_unit(F.col("e"))), lambda u: F.array_max(F.transform("centres", lambda c, i: F.struct(_dot(u, c).alias("dot"), (-i).alias("i")))))[0]
        rows = points.join(centres, "node", "left").withColumn("best", F.when(F.col("centres").isNotNull(), best))
        return rows.select(*points.columns, (-F.col("best.i")).alias("i"), _apart(F.col("best.dot")).alias("apart"))
    shared = points.sparkSession.sparkContext.broadcast({r.node: np.array(r.centres) for r in centres.collect()})  # within the bound above

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, distances = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            table, nodes = pa.table(batch), batch.column("node").dictionary_encode()
            for k, node in enumerate(nodes.dictionary.to_pylist()):
                if node in shared.value:
                    at = np.flatnonzero(np.asarray(nodes.indices) == k)
                    dots = _matrix(table.take(at)) @ shared.value[node].T
                    numbers[at] = dots.argmax(axis=1)
                    distances[at] = np.sqrt(np.maximum(0, 2 - 2 * dots.max(axis=1)))
            none = numbers < 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, mask=none), pa.array(distances, mask=none)], names=[*batch.schema.names, "i", "apart"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
    return points.mapInArrow(compare, f"{kinds}, i int, apart double")


def _split(points: DataFrame, cell: int, cut, broadcast_bytes: int) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """``points(uid, e, n, node)`` in cells; the splits ``node, child, centre, radius, points, weight, uid`` a round; and roots that were split."""
    splits, roots = [], None
    points = points.withColumn("settled", F.lit(False))
    for _ in range(MOST_SPLITS):
        large = cut(points.where(~F.col("settled")).groupBy("node").agg(F.count("*").alias("m")).where(F.col("m") > cell))
        if large.isEmpty():
            break
        roots = large.select("node") if roots is None else roots
        wanted = F.least(F.lit(CENTRES), F.ceil(2 * F.col("m") / cell))
        key = F.xxhash64(F.lit(len(splits)), "e")
        share = 2.0**64 * (2 * wanted + 8) / F.col("m")  # over twice as many as are needed
        some = points.join(storage.small(large, _bytes("node")), "node").where(key.cast("double") + 2.0**63 < share)
        place = F.row_number().over(Window.partitionBy("node").orderBy("key", "uid"))
        some = some.select("node", "e", "uid", "m", key.alias("key")).withColumn("place", place).where(F.col("place") <= wanted)
        centres = cut(some.groupBy("node").agg(F.collect_list(_unit(F.col("e"))).alias("centres")))
        child = F.when(F.col("i").isNotNull(), F.concat_ws("/", F.col("i").cast("string"), "node"))
        compared = _to_centres(points, centres, broadcast_bytes)
        rows = cut(compared.select("uid", "e", "n", F.coalesce(child, "node").alias("node"), F.col("i").isNull().alias("settled"), F.when(F.col("i").isNotNull(), F.col("node")).alias("above"), "i", "apart"))
        cells = rows.where("above is not null").groupBy(F.col("above").alias("node"), F.col("node").alias("child"), "i")
        cells = cells.agg(F.max("apart").alias("radius"), F.count("*").alias("points"), F.sum("n").alias("weight"), F.min("uid").alias("uid"))
        splits.append(cut(cells.join(centres, "node").withColumn("centre", F.get("centres", F.col("i"))).drop("centres", "i")))
        points = rows.select("uid", "e", "n", "node", "settled")
    return points.drop("settled"), splits, roots


def _descend(splits: list[DataFrame], roots: DataFrame, cosine: float, cut) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs of cells ``a, b, size_a, size_b`` that may hold links, and of each round the pairs ``a, b, uid_a, uid_b, weight_a, weight_b`` that are linked throughout."""
    far = reach(cosine)
    sides = [F.lit(None).cast(kind).alias(f"{name}_{side}") for side in "ab" for name, kind in (("centre", "array<double>"), ("radius", "double"), ("size", "long"), ("weight", "long"), ("uid", "long"))]
    pairs, whole = roots.select(F.col("node").alias("a"), F.col("node").alias("b"), *sides), []
    for split in splits:
        pairs = pairs.withColumn("one", F.col("a") == F.col("b"))  # of a cell's pairs with itself, each pair of children once
        for side in "ab":
            names = {"centre": "centre", "radius": "radius", "points": "size", "weight": "weight", "uid": "uid"}
            below = split.select(F.col("node").alias(side), F.col("child").alias(f"_{side}"), *(F.col(c).alias(f"_{n}_{side}") for c, n in names.items()))
            joined = pairs.join(below, side, "left")
            new = {side: F.coalesce(f"_{side}", side)} | {f"{n}_{side}": F.coalesce(f"_{n}_{side}", f"{n}_{side}") for n in names.values()}
            pairs = joined.select(*(new.get(c, F.col(c)).alias(c) for c in pairs.columns))
        under, apart = F.col("radius_a") + F.col("radius_b"), _apart(_dot(F.col("centre_a"), F.col("centre_b")))
        pairs = pairs.where("not one or a <= b").drop("one").withColumn("apart", apart).withColumn("under", under).where((F.col("a") == F.col("b")) | (F.col("apart") - F.col("under") <= far + MARGIN))
        near = (F.col("a") != F.col("b")) & (F.col("apart") + F.col("under") <= far - MARGIN)
        pairs = cut(pairs.withColumn("near", near))
        whole.append(pairs.where("near").select("a", "b", "uid_a", "uid_b", "weight_a", "weight_b"))
        pairs = pairs.where("not near").drop("apart", "under", "near")
    return pairs.select("a", "b", "size_a", "size_b"), whole


def _dealt(points: DataFrame, pairs: DataFrame, cell: int) -> tuple[DataFrame, DataFrame]:
    """Cells that no split made small enough are dealt to blocks: ``points`` with their block, and pairs of blocks."""
    sizes = pairs.where("a = b").select(F.col("a").alias("node"), F.ceil(F.col("size_a") / cell).alias("blocks")).where("blocks > 1")
    joined = points.join(storage.small(sizes, _bytes("node")), "node", "left")
    points = joined.withColumn("block", F.pmod(F.xxhash64("uid"), F.coalesce("blocks", F.lit(1))).cast("int")).drop("blocks")

    def each(side: str) -> Column:
        return F.explode(F.sequence(F.lit(0), (F.greatest(F.lit(1), F.ceil(F.coalesce(f"size_{side}", F.lit(1)) / cell)) - 1).cast("int"))).alias(f"block_{side}")

    pairs = pairs.select("*", each("a")).select("*", each("b")).where("a <> b or block_a <= block_b").select("a", "block_a", "b", "block_b")
    return points, pairs


def _planted(points: DataFrame, cosine: float) -> DataFrame:
    """Each block's points in the order of their cover tree: ``node, block, place, level, uid, e, n``."""
    last = last_level(cosine)

    def plant(table: pa.Table) -> pa.Table:
        order, level = build(_matrix(table), last)
        table = table.take(order)
        return pa.table([table["node"], table["block"], pa.array(np.arange(len(order), dtype=np.int32)), pa.array(level), table["uid"], table["e"], table["n"]], names=["node", "block", "place", "level", "uid", "e", "n"])

    kind = points.schema["e"].dataType.simpleString()
    return points.select("node", "block", "uid", "e", "n").groupBy("node", "block").applyInArrow(plant, f"node string, block int, place int, level tinyint, uid long, e {kind}, n long")


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table["e"].combine_chunks()
    return units(np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1))


def _linked(trees: DataFrame, pairs: DataFrame, cosine: float) -> DataFrame:
    """``uid, links, root``: of each pair of blocks the points with links, how many rows those reach, and the first point of their set."""
    last = last_level(cosine)

    def traverse(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("place", "ascending")])
        matrix, level = _matrix(table), np.asarray(table["level"])
        weights, uids = np.asarray(table["n"], dtype=np.int64), np.asarray(table["uid"])
        first = int((np.asarray(table["side"]) == 0).sum())
        trees = [Tree(matrix[at], level[at], last) for at in (slice(0, first), slice(first, None))]
        both = first < len(uids)
        done = Traversal(trees[0], weights[:first], trees[1] if both else None, weights[first:] if both else None, cosine)
        met = np.flatnonzero(done.counts)
        return pa.table([pa.array(uids[met]), pa.array(done.counts[met]), pa.array(uids[done.joined.parent[met]])], names=["uid", "links", "root"])

    few = storage.small(pairs, _bytes("a", "b"))
    columns = ("a", "block_a", "b", "block_b", "side", "place", "level", "uid", "e", "n")
    left = trees.join(few, (F.col("node") == F.col("a")) & (F.col("block") == F.col("block_a"))).withColumn("side", F.lit(0))
    other = few.where("a <> b or block_a <> block_b")
    right = trees.join(other, (F.col("node") == F.col("b")) & (F.col("block") == F.col("block_b"))).withColumn("side", F.lit(1))
    rows = left.select(*columns).unionByName(right.select(*columns))
    return rows.groupBy("a", "block_a", "b", "block_b").applyInArrow(traverse, "uid long, links long, root long")


def _throughout(whole: list[DataFrame], splits: list[DataFrame], points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of cells that are linked throughout: ``uid, links, root`` of their points, and links ``u, v`` between cells.

    A cell's points link to all of its partners', so also to one point of one partner; that, and the links between the
    cells' own first points, joins them all. What a cell has found goes down to the cells that it was split into.
    """
    totals = edges = None
    for pairs, split in zip(whole, splits):
        both = pairs.select(F.col("a").alias("node"), F.col("weight_b").alias("weight"), F.col("uid_b").alias("other"))
        both = both.unionByName(pairs.select(F.col("b").alias("node"), F.col("weight_a").alias("weight"), F.col("uid_a").alias("other")))
        new = both.groupBy("node").agg(F.sum("weight").alias("links"), F.min("other").alias("root"))
        if totals is not None:
            below = totals.join(split.select("node", "child"), "node", "left").select(F.coalesce("child", "node").alias("node"), "links", "root")
            new = new.unionByName(below)
        totals, own = new, pairs.select(F.col("uid_a").alias("u"), F.col("uid_b").alias("v"))
        edges = own if edges is None else edges.unionByName(own)
    return points.join(storage.small(totals, _bytes("node")), "node").select("uid", "links", "root"), edges


def near_vectors(vectors: DataFrame, cosine: float = COSINE, cell: int = CELL, broadcast_bytes: int = storage.BROADCAST_BYTES) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding, label)``."""
    if not 0 < cosine <= 1:
        raise ValueError("the cosine must be over 0, and 1 at most")
    vectors = vectors.select("vec_id", "label", F.col("embedding").alias("e"))
    with storage.Scratch(vectors.sparkSession, "vectors") as scratch:
        cut = scratch.cut
        classes = _classes(vectors, cut)
        points, splits, roots = _split(classes.select("uid", "e", "n", "node"), cell, cut, broadcast_bytes)
        sizes = points.groupBy("node").agg(F.count("*").alias("size"))
        alone = sizes.select(F.col("node").alias("a"), F.col("node").alias("b"), F.col("size").alias("size_a"), F.col("size").alias("size_b"))
        pairs, found, edges = alone, None, None
        if splits:
            descended, whole = _descend(splits, roots, cosine, cut)
            pairs = alone.unionByName(descended.where("a <> b"))
            found, edges = _throughout(whole, splits, points)
        blocks, pairs = _dealt(points, cut(pairs), cell)
        traversed = _linked(cut(_planted(blocks, cosine)), cut(pairs), cosine)
        found = cut(traversed if found is None else traversed.unionByName(found))
        links = found.groupBy("uid").agg(F.sum("links").alias("links"))
        joined = found.where("uid <> root").select(F.col("uid").alias("u"), F.col("root").alias("v"))
        sets = components(joined if edges is None else joined.unionByName(edges))
        named = classes.join(links, "uid", "left").join(sets.withColumnRenamed("node", "uid"), "uid", "left")
        named = cut(named.select("label", "e", "n", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "uid").alias("component")))
        least = named.groupBy("component").agg(F.min("first").alias("component_id"))
        named = cut(named.join(least, "component").select("label", "e", "n", "first", "n_links", "component_id"))
        single = named.where("n = 1").select(F.col("first").alias("vec_id"), "n_links", "component_id")
        repeated = storage.small(named.where("n > 1").select("label", "e", "n_links", "component_id"), 8 * F.size("e") + F.octet_length(F.col("label").cast("string")))
        usable = F.col("label").isNotNull() & linkable(F.col("e"))
        copies = vectors.where(usable).join(repeated, ["label", "e"]).select("vec_id", "n_links", "component_id")
        others = vectors.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        rows = single.unionByName(copies).unionByName(others)
        return storage.cut(rows.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), "near-vectors")
