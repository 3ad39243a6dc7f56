"""Small graphs worked out by hand, and properties of curves and blocks."""

import random

import pytest

from edgeloom.functions import curves
from edgeloom.operators import adjacency, blocking, canonical, ordering
from edgeloom.operators.pagerank import pagerank, scores_differ

RAW = [(10, 20), (10, 20), (20, 30), (30, 10), (30, 30), (40, 10), (40, 50), (50, 20), (10, 40)]
DENSE = [(0, 1), (0, 3), (1, 2), (2, 0), (2, 2), (3, 0), (3, 4), (4, 1)]


@pytest.fixture(scope="module")
def graph(spark):
    return spark.createDataFrame(DENSE, "src long, dst long").cache()


def rows(frame, *order):
    return [tuple(r) for r in frame.orderBy(*order).collect()]


def test_compress(spark):
    edges, ids = canonical.compress(spark.createDataFrame(RAW, "src long, dst long"))
    assert rows(ids, "old_id") == [(10, 0), (20, 1), (30, 2), (40, 3), (50, 4)]
    assert rows(edges, "src", "dst") == DENSE
    assert (2, 2) not in rows(canonical.compress(spark.createDataFrame(RAW, "src long, dst long"), True)[0], "src", "dst")


def test_empty_graph(spark):
    none = spark.createDataFrame([], "src long, dst long")
    edges, ids = canonical.compress(none)
    assert edges.count() == ids.count() == 0
    assert pagerank(none, 3).count() == 0
    assert blocking.block(none, 3, 4).count() == 0


def test_relabel_keeps_weights_and_checks_permutations(spark, graph):
    ids = spark.createDataFrame([(i, 4 - i) for i in range(5)], "old_id long, new_id long")
    canonical.check_permutation(ids)
    weighted = spark.createDataFrame([(0, 1, 2.5)], "src long, dst long, weight double")
    assert rows(canonical.relabel(weighted, ids), "src") == [(4, 3, 2.5)]
    with pytest.raises(ValueError):
        canonical.check_permutation(spark.createDataFrame([(0, 0), (1, 0)], "old_id long, new_id long"))


def test_adjacency(graph):
    assert rows(adjacency.degrees(graph), "id") == [(0, 2, 2), (1, 2, 1), (2, 2, 2), (3, 1, 2), (4, 1, 1)]
    assert [r[0] for r in rows(adjacency.top_hubs(graph, 5), "deg")] and [r.id for r in adjacency.top_hubs(graph, 5).collect()] == [0, 2, 3, 1, 4]
    assert [r[2] for r in rows(adjacency.all_offsets(graph), "id")] == [0, 2, 3, 5, 7]
    assert [r[2] for r in rows(adjacency.all_offsets(graph, incoming=True), "id")] == [0, 2, 4, 6, 7]
    assert sum((r[1] for r in rows(adjacency.adjacency(graph, incoming=True), "id")), []) == [2, 3, 0, 4, 1, 2, 0, 3]
    assert tuple(adjacency.read_write_distance(graph, 5).first()) == (0.625, 1.0)


def test_orders(spark, graph):
    visits = spark.createDataFrame([(0, 7), (1, 5), (0, 9), (1, 7)], "src long, dst long")
    assert rows(ordering.first_visit_order(visits), "new_id") == [(7, 0), (9, 1), (5, 2)]
    assert rows(ordering.bipartite_degree_order(visits), "new_id") == [(0, 0, 0), (0, 1, 1), (1, 7, 2), (1, 5, 3), (1, 9, 4)]
    assert rows(ordering.identity_order(spark, 2), "old_id") == [(0, 0), (1, 1)]


def test_hilbert_goldens(spark, graph):
    grid = {2: [[0, 3, 4, 5], [1, 2, 7, 6], [14, 13, 8, 9], [15, 12, 11, 10]]}
    grid[3] = [[0, 1, 14, 15, 16, 19, 20, 21], [3, 2, 13, 12, 17, 18, 23, 22], [4, 7, 8, 11, 30, 29, 24, 25], [5, 6, 9, 10, 31, 28, 27, 26],
               [58, 57, 54, 53, 32, 35, 36, 37], [59, 56, 55, 52, 33, 34, 39, 38], [60, 61, 50, 51, 46, 45, 40, 41], [63, 62, 49, 48, 47, 44, 43, 42]]
    for order, want in grid.items():
        cells = spark.createDataFrame([(x, y) for x in range(1 << order) for y in range(1 << order)], "src long, dst long")
        for found in (ordering.with_hilbert(cells, order), ordering.with_hilbert(cells, order, batches=True)):
            assert all(want[r.src][r.dst] == r.h for r in found.collect())
        classic = cells.withColumn("h", curves.hilbert_key_classic("src", "dst", order))
        assert all(want[r.src][r.dst] == r.h for r in classic.collect())
    assert [(r.h, r.src, r.dst) for r in ordering.hilbert_ranks(graph, 3).orderBy("rank").collect()] == [(1, 0, 1), (4, 2, 0), (5, 3, 0), (8, 2, 2), (13, 1, 2), (15, 0, 3), (31, 3, 4), (57, 4, 1)]


def test_hilbert_is_a_walk(spark):
    order = 5
    cells = spark.range(1 << order).selectExpr("id src").crossJoin(spark.range(1 << order).selectExpr("id dst"))
    walk = ordering.with_hilbert(cells, order).orderBy("h").collect()
    assert [r.h for r in walk] == list(range(1 << 2 * order))
    assert all(abs(a.src - b.src) + abs(a.dst - b.dst) == 1 for a, b in zip(walk, walk[1:]))


def test_hilbert_large_ids_agree(spark):
    pick = random.Random(3)
    cells = spark.createDataFrame([(pick.randrange(1 << 31), pick.randrange(1 << 31)) for _ in range(500)], "src long, dst long")
    both = cells.withColumn("a", curves.hilbert_key("src", "dst", 31)).withColumn("b", curves.hilbert_key_classic("src", "dst", 31))
    assert both.where("a <> b").count() == 0


def test_morton(spark):
    cells = spark.createDataFrame([(0, 0), (1, 0), (0, 1), (1, 1), (2, 1), (3, 3), (1 << 21, 0)], "src long, dst long")
    assert [r.m for r in cells.withColumn("m", curves.morton_key("src", "dst")).collect()] == [0, 1, 2, 3, 10, 27, None]


def test_sizes():
    assert [curves.power_of_two(n) for n in (0, 1, 2, 3, 4, 5, 64, 65)] == [2, 2, 2, 4, 4, 8, 64, 128]
    assert curves.curve_order(5) == 3 and curves.widest_block(64) == 4
    with pytest.raises(ValueError):
        curves.check_block_width(64, 9)
    with pytest.raises(ValueError):
        blocking.check_most_edges(32, 4)


CORNER = [(a, b) for a in range(3) for b in range(3)] + [(62, 63), (63, 0), (40, 41), (41, 40), (40, 40)]
BLOCKS = {
    5: [(0, 0, 0, 2, 4), (4, 0, 2, 2, 2), (8, 2, 2, 2, 1), (14, 2, 0, 2, 2), (2176, 40, 40, 2, 3), (2728, 62, 62, 2, 1), (4094, 62, 0, 2, 1)],
    4: [(0, 0, 0, 1, 1), (1, 1, 0, 1, 1), (2, 1, 1, 1, 1), (3, 0, 1, 1, 1), (4, 0, 2, 2, 2), (8, 2, 2, 2, 1), (14, 2, 0, 2, 2), (2176, 40, 40, 2, 3), (2728, 62, 62, 2, 1), (4094, 62, 0, 2, 1)],
}


@pytest.mark.parametrize("most", [5, 4])
def test_blocks(spark, most):
    edges = spark.createDataFrame(CORNER, "src long, dst long")
    assigned = blocking.block_of_edges(edges, 6, most)
    found = blocking.blocks(assigned, 6)
    assert rows(found, "idx") == BLOCKS[most]
    if most == 5:
        assert [r.end for r in blocking.block_index(found).orderBy("block").collect()] == [8, 12, 14, 18, 24, 26, 28]
    placed = blocking.block_edges(assigned).orderBy("place").collect()
    assert [r.h for r in placed] == sorted(r.h for r in placed) and len(placed) == 14


def test_blocks_of_one_edge_and_bad_limits(spark):
    edges = spark.createDataFrame(CORNER, "src long, dst long")
    assert blocking.block(edges, 6, 2).count() == 14
    with pytest.raises(ValueError):
        blocking.block(edges, 6, 1)


def test_pagerank(spark, graph):
    want = {0: [0.0] * 5, 1: [0.03] * 5, 2: [0.0555, 0.06825, 0.06825, 0.04275, 0.04275], 3: [0.077175, 0.089925, 0.11701875, 0.0535875, 0.04816875]}
    for k, scores in want.items():
        assert [r.score for r in pagerank(graph, k).orderBy("id").collect()] == pytest.approx(scores)
    ten = pagerank(graph, 10)
    assert ten.groupBy().sum("score").first()[0] == pytest.approx(1 - 0.85**10)
    ids = spark.createDataFrame([(i, (i + 2) % 5) for i in range(5)], "old_id long, new_id long")
    assert scores_differ(pagerank(canonical.relabel(graph, ids), 10), ids, ten).count() == 0
    assert scores_differ(pagerank(graph, 2), ids, ten).count() > 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("edgeloom")]
