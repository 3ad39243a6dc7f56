"""PageRank by a fixed number of rounds: of join and aggregation on edges, or of the edge map over blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.edge_map import BLOCK_EDGES, Layout
from edgeloom.shared import bucketed, cut

DAMPING = 0.85
#: Rounds between cuts of the lineage.
CUT_EVERY = 3
#: Edges of one source, and edges of a bucket, that a task should have at most, about.
HUB_EDGES = 1_000_000
BUCKET_EDGES = 4_000_000


def _vertices(edges: DataFrame) -> DataFrame:
    """``id, out_deg`` of both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("out")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.out").alias("out_deg"))


def _rounds(vertices: DataFrame, iterations: int, damping: float, came) -> DataFrame:
    """``id, score`` after the rounds; ``came(given)`` is ``id, total`` of ``given(id, value)``, each source's share."""
    n = vertices.count()
    base = (1 - damping) / n if n and iterations > 0 else 0.0
    state = vertices.withColumn("score", F.lit(base))  # the first round: nothing has come yet
    for done in range(1, iterations if n else 1):
        given = state.where("out_deg > 0").select("id", (F.col("score") / F.col("out_deg")).alias("value"))
        score = F.lit(base) + F.lit(damping) * F.coalesce("total", F.lit(0.0))
        state = vertices.join(came(given), "id", "left").select("id", "out_deg", score.alias("score"))
        if done % CUT_EVERY == 0 and done < iterations - 1:
            state = cut(state, "scores")
    return cut(state.select("id", "score"), "scores")


def pagerank(edges: DataFrame, iterations: int, damping: float = DAMPING, hub_edges: int = HUB_EDGES) -> DataFrame:
    """``id, score``: no convergence test, no share for dangling vertices, no normalisation.

    A round: edges meet their source's contribution, sums go to destinations, and vertices without incoming
    edges get the base. Edges are stored in buckets by source, once, so that a round shuffles contributions, sums and
    vertices, never edges. A source of more than ``hub_edges`` is dealt to as many salts, each with its own copy of the
    contribution; sums are partial before the shuffle, so a vertex that a third of all edges enter is a row a task.
    """
    spark = edges.sparkSession
    edges = cut(edges.select("src", "dst"), "edges")
    vertices = cut(_vertices(edges), "vertices")
    salts = F.ceil(F.col("out_deg") / hub_edges)
    hubs = cut(vertices.where(F.col("out_deg") > hub_edges).select(F.col("id").alias("src"), salts.alias("salts")), "hubs")  # fewer than m / hub_edges
    salted = edges.join(hubs, "src", "left").select("src", "dst", F.pmod(F.xxhash64("dst"), F.coalesce("salts", F.lit(1))).alias("salt"))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-edges.count() // BUCKET_EDGES))
    with bucketed(spark) as store:
        edges = store(salted, "edges", buckets, "src", "salt")

        def came(given: DataFrame) -> DataFrame:
            copies = given.withColumnRenamed("id", "src").join(hubs, "src", "left")
            copies = copies.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1)))
            return edges.join(copies.select("src", "salt", "value"), ["src", "salt"]).groupBy(F.col("dst").alias("id")).agg(F.sum("value").alias("total"))

        return _rounds(vertices, iterations, damping, came)


def pagerank_blocks(edges: DataFrame, iterations: int, damping: float = DAMPING, most: int = BLOCK_EDGES, **layout) -> DataFrame:
    """The same scores by the edge map over Hilbert blocks of fewer than ``most`` edges (``edge_map.Layout``).

    A round sends slices of contributions to runs of blocks with equal numbers of edges, and sums to destinations.
    """
    edges = cut(edges.select("src", "dst"), "edges")
    vertices = cut(_vertices(edges), "vertices")
    if iterations < 2 or edges.isEmpty():
        return _rounds(vertices, min(iterations, 1), damping, None)
    with bucketed(edges.sparkSession) as store:
        return _rounds(vertices, iterations, damping, Layout(edges, store, most, **layout).sums)


def scores_differ(scores: DataFrame, ids: DataFrame, truth: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Vertices whose score, found under new ids, isn't that of ``truth`` under their old ids; none if all is well."""
    back = scores.join(ids, F.col("id") == F.col("new_id")).select(F.col("old_id").alias("id"), "score")
    both = back.join(truth.select("id", F.col("score").alias("true_score")), "id", "full")
    return both.where(F.coalesce(F.abs(F.col("score") - F.col("true_score")) >= tolerance, F.lit(True)))
