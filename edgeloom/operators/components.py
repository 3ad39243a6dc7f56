"""Connected components by hooking and pointer jumping on tables, component sizes, and the comparison of two labellings.

In a round every vertex hooks to the first of its neighbourhood in an order drawn by hash for that round, which makes
trees of small depth; pointer jumping takes every vertex to its tree's root; and the edges between roots are the next
round's graph. In a random order at least half of the vertices with a neighbour are not the first of theirs, so rounds
are logarithmic in the vertices whatever the graph's shape, and each round's tables are half the last one's. Minima
are partial before the shuffle, so a hub is a row a task; joins on a hub are split by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.canonical import endpoints
from edgeloom.shared import cut, dropped_at_end, new_folder

#: More rounds than any graph needs; the loop ends when no edge is left.
MOST_ROUNDS = 200


def _hooked(edges: DataFrame, seed: int) -> DataFrame:
    """``id, root``: each vertex, and the first vertex by the round's order in its neighbourhood, itself included."""
    def ranked(name: str):
        return F.struct(F.xxhash64(F.lit(seed), name).alias("rank"), F.col(name).alias("id"))

    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), ranked("v").alias("to")), F.struct(F.col("v").alias("id"), ranked("u").alias("to")))).alias("e"))
    first = ends.groupBy("e.id").agg(F.min("e.to").alias("to"))
    return first.select("id", F.least(F.col("to"), ranked("id"))["id"].alias("root"))


def _jumped(parents: DataFrame) -> DataFrame:
    """Every vertex with the root of its tree: each step halves the way."""
    while True:
        above = parents.select(F.col("id").alias("root"), F.col("root").alias("next"))
        stepped = cut(parents.join(above, "root").select("id", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "parents")
        parents = stepped.select("id", "root")
        if stepped.where("moved").isEmpty():
            return parents


def _contracted(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges between roots, once each, the smaller first."""
    for end in ("u", "v"):
        edges = edges.join(roots.select(F.col("id").alias(end), F.col("root").alias(f"_{end}")), end)
    pairs = edges.select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v"))
    return pairs.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` of every end of ``edges(src, dst)``, read without direction: the smallest id that can be reached."""
    spark = edges.sparkSession
    place = new_folder(spark, "components")
    with dropped_at_end(spark):
        vertices = cut(endpoints(edges), "vertices")
        pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
        pairs, rounds = cut(pairs, "links"), []
        while not pairs.isEmpty():
            if len(rounds) == MOST_ROUNDS:
                raise RuntimeError("components did not settle")
            rounds.append(_jumped(_hooked(pairs, len(rounds))))
            pairs = cut(_contracted(pairs, rounds[-1]), "links")
        # from the last round back: where a round's roots ended up
        last = None
        for roots in reversed(rounds):
            if last is not None:
                after = last.select(F.col("id").alias("root"), F.col("root").alias("end"))
                roots = cut(roots.join(after, "root", "left").select("id", F.coalesce("end", "root").alias("root")), "roots")
            last = roots
        if last is None:
            vertices.select("id", F.col("id").alias("component")).write.parquet(place)
        else:
            named = cut(vertices.join(last, "id", "left").select("id", F.coalesce("root", "id").alias("root")), "named")
            least = named.groupBy("root").agg(F.min("id").alias("component"))
            named.join(least, "root").select("id", "component").write.parquet(place)
    return spark.read.parquet(place)


def value_counts(labels: DataFrame, label: str = "component") -> DataFrame:
    """How many rows each label has: ``<label>, n``."""
    return labels.groupBy(label).agg(F.count("*").alias("n"))


def size_counts(labels: DataFrame, label: str = "component") -> DataFrame:
    """How many labels have each size: ``size, labels``, which doesn't depend on names."""
    return value_counts(labels, label).groupBy(F.col("n").alias("size")).agg(F.count("*").alias("labels"))


def compared(found: DataFrame, truth: DataFrame, label: str = "component") -> DataFrame:
    """``size, found, truth``: of each size the number of labels in two labellings; as multisets they are equal if all rows agree."""
    a, b = size_counts(found, label).withColumnRenamed("labels", "found"), size_counts(truth, label).withColumnRenamed("labels", "truth")
    return a.join(b, "size", "full").select("size", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("found", "truth")))


def same_partition(found: DataFrame, truth: DataFrame, label: str = "component") -> bool:
    """Whether two labellings of the same ids part them alike, whatever their labels are called."""
    both = found.select("id", F.col(label).alias("a")).join(truth.select("id", F.col(label).alias("b")), "id", "full")
    if not both.where("a is null or b is null").isEmpty():
        return False
    pairs = cut(both.groupBy("a", "b").agg(F.count("*").alias("n")), "pairs")
    return all(pairs.groupBy(c).agg(F.count("*").alias("n")).where("n > 1").isEmpty() for c in "ab")
