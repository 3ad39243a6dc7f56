"""Clustering by integer centroids in JVM expressions.

Vectors become whole numbers, so a run is exact and the same on any cluster. Each round is one scan: the
distance to every centroid, a literal array, is ``aggregate`` over ``zip_with``; ``array_min`` of (distance, number)
chooses the cluster, the smaller number among equals; and sums of the components by cluster update the centroids.
Sums are partial in each task, so a cluster with most rows is one row a task in the shuffle. The driver sees one row a
cluster. The whole-number vectors are stored once; a lost executor costs its tasks of one scan.

Defined results: rows whose vector is null, has another length than ``dims``, or holds null, NaN, infinite or
immense components (``vectors.MOST_WHOLE``) are left out; equal rows each count; rows without an id can start no
cluster unless ids run out; fewer rows than clusters give as many clusters as rows, an empty table no rows; a cluster
that loses all its rows keeps its centroid; other columns, of any name, are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm import storage
from edgeloom.llm.vectors import usable, whole

CLUSTERS = 16
ROUNDS = 3
SCALE = 64
DIMS = 64


def _distance(vector: Column, centroid: list[int]) -> Column:
    literal = F.lit(centroid).cast("array<bigint>")
    return F.aggregate(F.zip_with(vector, literal, lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda total, x: total + x)


def nearest(vector: Column, centroids: list[list[int]]) -> Column:
    """A struct of the squared ``distance`` to the nearest centroid and its number, ``cluster``."""
    return F.array_min(F.array(*(F.struct(_distance(vector, c).alias("distance"), F.lit(k).alias("cluster")) for k, c in enumerate(centroids))))


def first_centroids(rows: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors whose ids, behind the seed, have the smallest hashes."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r.v) for r in rows.orderBy(order.asc_nulls_last(), "v").select("v").limit(clusters).collect()]


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid as the floored mean of its vectors; one without vectors stays."""
    dims = len(centroids[0])
    sums = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dims)]
    found = rows.select("v", nearest(F.col("v"), centroids)["cluster"].alias("cluster")).groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect()
    new = list(centroids)
    for r in found:  # a row a cluster
        new[r.cluster] = [r[f"s{i}"] // r.n for i in range(dims)]
    return new


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1, scale: int = SCALE, dims: int = DIMS) -> tuple[DataFrame, list[list[int]]]:
    """``vec_id, cluster, distance`` of ``vectors(vec_id, embedding)``, and the centroids as whole numbers."""
    source = vectors.select("vec_id", F.col("embedding").alias("e"))
    kept = source.where((F.size("e") == dims) & usable(F.col("e"), scale)).select("vec_id", whole(F.col("e"), scale).alias("v"))
    with storage.Scratch(vectors.sparkSession, "centroids") as scratch:
        rows = scratch.cut(kept)
        centroids = first_centroids(rows, clusters, seed)
        if not centroids:
            return rows.sparkSession.createDataFrame([], f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"), []
        for _ in range(rounds):
            centroids = moved(rows, centroids)
        best = rows.select("vec_id", nearest(F.col("v"), centroids).alias("best"))
        return storage.cut(best.select("vec_id", "best.cluster", "best.distance"), "clusters"), centroids


def clustered(vectors: DataFrame, **options) -> DataFrame:
    """``cluster`` with ``cluster_inertia``, ``inertia`` and ``centroid_sha256``: sums of distances, and the centroid's digest."""
    rows, centroids = cluster(vectors, **options)
    if not centroids:
        return rows.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in (("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    own = dict.fromkeys(range(len(centroids)), 0) | {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a cluster
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    inertias = F.lit([own[k] for k in range(len(centroids))]).cast("array<bigint>")
    return rows.select("*", F.get(inertias, F.col("cluster")).alias("cluster_inertia"), F.lit(sum(own.values())).cast("long").alias("inertia"),
                       F.get(F.lit(digests), F.col("cluster")).alias("centroid_sha256"))
