"""Whole runs from files to files: canonical graph, adjacency in both directions, blocks and PageRank.

Each run reads what the one before wrote, checks its parameters before it does any work, and returns the few
numbers that it found. Folders: ``edges`` and ``sizes`` (canonical graph), ``order`` (the vertex order that was
used), ``out`` and ``in`` (binary adjacency), ``blocks``, ``block-edges``, ``block-index``, ``results.csv``.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions.curves import check_block_width, curve_order
from edgeloom.operators import adjacency, blocking, canonical, ordering
from edgeloom.operators.components import components
from edgeloom.operators.factorise import factorise
from edgeloom.operators.pagerank import pagerank_blocks
from edgeloom.shared import cut
from edgeloom.sources import edges as text
from edgeloom.sources import formats

#: What a run may compute after blocking, each a function of the edges and a number of rounds.
ALGORITHMS = {"pr": pagerank_blocks, "cc": lambda edges, _: components(edges), "cf": factorise, "none": None}


def algorithm(name: str):
    """The function of an algorithm's name, or None where there is nothing to run."""
    if name not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {name!r}; known are {', '.join(sorted(ALGORITHMS))}")
    return ALGORITHMS[name]


def _observed(edges: DataFrame, label: str, **more) -> tuple[DataFrame, dict[str, int]]:
    """``edges`` stored, and what the write itself has seen: ``m`` rows, the largest id, and ``more``."""
    seen = Observation(label)
    largest = F.coalesce(F.max(F.greatest("src", "dst")), F.lit(-1).cast("long")).alias("most")
    stored = cut(edges.observe(seen, F.count(F.lit(1)).alias("m"), largest, *(c.alias(k) for k, c in more.items())), label)
    return stored, seen.get


def canonicalise(spark: SparkSession, source: str, folder: str, drop_self_loops: bool = False) -> dict[str, int]:
    """A text edge list becomes distinct edges with dense ids, sorted, and the sizes beside them; ``bad`` lines are left out and counted."""
    bad = text.bad_lines(spark, source).count()
    edges, seen = _observed(canonical.compress(text.read_edge_list(spark, source), drop_self_loops)[0], "edges")
    n, m = seen["most"] + 1, seen["m"]  # ids are dense
    text.write_edge_list(edges, f"{folder}/edges")
    formats.write_sizes(spark, f"{folder}/sizes", n, m)
    return {"n": n, "m": m, "bad": bad}


def translate(spark: SparkSession, folder: str, order: str | None = None, block_width: int | None = None) -> dict[str, int]:
    """The canonical graph under a vertex order (a file of old and new ids; None keeps the ids), as binary adjacency both ways."""
    edges = text.read_edge_list(spark, f"{folder}/edges")
    n, m = formats.read_sizes(spark, f"{folder}/sizes")
    if block_width is not None:
        check_block_width(n, block_width)
    if order is None:
        ids = ordering.identity_order(spark, n)
    else:
        ids = cut(formats.read_vertex_order(spark, order, n=n), "order")
        edges = canonical.relabel(edges, ids)
    edges = cut(edges, "edges")
    formats.write_vector(ids.select(F.col("old_id").alias("place"), F.col("new_id").alias("value")), f"{folder}/order")
    formats.write_csr(edges, f"{folder}/out")
    formats.write_csr(edges, f"{folder}/in", incoming=True)
    return {"n": n, "m": m, **adjacency.max_degrees(edges).first().asDict()}


def block_and_rank(spark: SparkSession, folder: str, most: int, name: str = "pr", iterations: int = 10, dumps: bool = False) -> tuple[dict[str, float], DataFrame | None]:
    """Blocks of the adjacency in ``folder``, then what ``name`` computes: numbers and times in seconds, and the scores if there are any."""
    run = algorithm(name)
    began = time.perf_counter()
    edges, seen = _observed(formats.read_csr(spark, f"{folder}/in", incoming=True), "edges")
    n, m = formats.csr_sizes(f"{folder}/in")
    if seen["m"] != m:
        raise ValueError(f"{seen['m']} of {m} edges were read")
    blocking.check_most_edges(m, most)
    read = time.perf_counter()
    order = curve_order(n)
    assigned = cut(blocking.block_of_edges(edges, order, most), "assigned")
    counted = Observation("blocks")
    blocks = cut(blocking.blocks(assigned, order).observe(counted, F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("nnz"), F.lit(0).cast("long")).alias("edges")), "blocks")
    found = blocking.checked(counted.get, m)
    blocked = time.perf_counter()
    if dumps:
        formats.write_blocks(blocks, f"{folder}/blocks")
        formats.write_block_edges(blocking.block_edges(assigned), blocking.block_index(blocks), f"{folder}/block-edges", f"{folder}/block-index")
    dumped = time.perf_counter()
    scores = cut(run(edges, iterations), "scores") if run else None
    numbers = {
        "n": n, "m": m, "most": most, "blocks": found["blocks"], "iterations": iterations if run else 0,
        "read_s": read - began, "blocking_s": blocked - read, "dumps_s": dumped - blocked, "algorithm_s": time.perf_counter() - dumped,
    }
    formats.append_result(f"{folder}/results.csv", {"algorithm": name, **numbers})
    return numbers, scores


def shown_info(name: str, numbers: dict[str, float]) -> str:
    """A run's numbers as lines: the number of blocks and the time of each phase."""
    lines = [f"graph: {name}", f"blocks: {numbers['blocks']:.0f}"]
    return "\n".join(lines + [f"{key[:-2]}: {value:.3f} s" for key, value in numbers.items() if key.endswith("_s")])


def bipartite_graph(edges: DataFrame) -> tuple[DataFrame, int, int]:
    """``edges(src, dst[, weight])`` of two sides that are numbered each for itself, in one id space: edges, n1, n2.

    The sides are numbered up to their largest id; the second follows the first.
    """
    sizes = edges.agg(F.coalesce(F.max("src") + 1, F.lit(0)).alias("n1"), F.coalesce(F.max("dst") + 1, F.lit(0)).alias("n2")).first()
    return canonical.bipartite(edges, sizes.n1), sizes.n1, sizes.n2


def bipartite_csrs(edges: DataFrame) -> dict[str, DataFrame]:
    """Degrees and the adjacency of both directions, in chunks and with weights if there are any, of a bipartite graph in one id space."""
    shifted = bipartite_graph(edges)[0]
    return {"edges": shifted, "degrees": adjacency.degrees(shifted), "out": adjacency.adjacency_chunks(shifted), "in": adjacency.adjacency_chunks(shifted, incoming=True)}
