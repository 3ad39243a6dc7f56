"""Whole runs over files, their guards, and blocks against a plain quadtree."""

import random

import pytest

from edgeloom.operators import adjacency, blocking, ordering
from edgeloom.operators.pagerank import scores_differ
from edgeloom.plans import flows
from edgeloom.sources import formats


def pairs(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.fixture
def folder(tmp_path):
    pick = random.Random(4)
    lines = [f"{10 * pick.randrange(60)} {10 * pick.randrange(60)}" for _ in range(900)]
    (tmp_path / "raw.net").write_text("# head\n" + "\n".join(lines) + "\nbad line\n")
    return tmp_path


def test_files_to_scores(spark, folder):
    sizes = flows.canonicalise(spark, str(folder / "raw.net"), str(folder))
    raw = {tuple(map(int, line.split())) for line in (folder / "raw.net").read_text().splitlines() if line[0] not in "#b"}
    assert sizes == {"n": len({x for e in raw for x in e}), "m": len(raw), "bad": 1}
    n = sizes["n"]
    found = flows.translate(spark, str(folder), block_width=n // 8)
    assert (found["n"], found["m"]) == (n, len(raw)) and found["max_out"] == max(sum(a == s for a, _ in raw) for s, _ in raw)
    plain = pairs(formats.read_csr(spark, str(folder / "out")))
    assert plain == pairs(formats.read_csr(spark, str(folder / "in"), incoming=True)) and len(plain) == len(raw)
    numbers, scores = flows.block_and_rank(spark, str(folder), 16, dumps=True)
    assert numbers["m"] == len(raw) and numbers["blocks"] > 10 and scores.count() == n
    assert "blocks: " in flows.shown_info("g", numbers) and "blocking: " in flows.shown_info("g", numbers)
    # under another order the scores are the same, mapped back
    ids = spark.createDataFrame([(i, n - 1 - i) for i in range(n)], "old_id long, new_id long")
    formats.write_vertex_order(ids, str(folder / "reversed"), n, len(raw))
    flows.canonicalise(spark, str(folder / "raw.net"), str(folder / "b"))
    flows.translate(spark, str(folder / "b"), order=str(folder / "reversed"))
    _, others = flows.block_and_rank(spark, str(folder / "b"), 16)
    assert scores_differ(others, ids, scores, 1e-9).count() == 0 and scores_differ(others, ids, others, 1e-9).count() > 0
    numbers, scores = flows.block_and_rank(spark, str(folder), 16, name="none")
    assert scores is None and len((folder / "results.csv").read_text().splitlines()) == 3


def test_guards(spark, folder):
    flows.canonicalise(spark, str(folder / "raw.net"), str(folder))
    with pytest.raises(ValueError, match="block width"):
        flows.translate(spark, str(folder), block_width=50)
    flows.translate(spark, str(folder))
    with pytest.raises(ValueError, match="edges a block"):
        flows.block_and_rank(spark, str(folder), 4096)
    with pytest.raises(ValueError, match="unknown algorithm"):
        flows.block_and_rank(spark, str(folder), 16, name="bfs")
    with pytest.raises(ValueError, match="densely"):
        formats.write_csr(spark.createDataFrame([(0, 5)], "src long, dst long"), str(folder / "gap"))
    with pytest.raises(ValueError, match="in blocks"):
        blocking.check_all_assigned(spark.createDataFrame([(0, 3)], "idx long, nnz long"), 4)
    formats.write_vertex_order(spark.createDataFrame([(0, 1), (1, 0)], "old_id long, new_id long"), str(folder / "short"), 3, 5)
    with pytest.raises(ValueError, match="its head says 3"):
        formats.read_vertex_order(spark, str(folder / "short"))
    formats.write_vertex_order(spark.createDataFrame([(0, 1), (1, 0)], "old_id long, new_id long"), str(folder / "two"), 2, 5)
    with pytest.raises(ValueError, match="the graph has 3"):
        formats.read_vertex_order(spark, str(folder / "two"), n=3)


def test_bipartite(spark):
    edges = spark.createDataFrame([(0, 0, 2.0), (0, 2, 1.0), (3, 0, 4.0)], "src long, dst long, weight double")
    found = flows.bipartite_csrs(edges)
    assert pairs(found["edges"]) == [(0, 4, 2.0), (0, 6, 1.0), (3, 4, 4.0)]
    assert pairs(found["degrees"]) == [(0, 0, 2), (3, 0, 1), (4, 2, 0), (6, 1, 0)]
    assert pairs(found["out"]) == [(0, 0, [4, 6], [2.0, 1.0]), (3, 0, [4], [4.0])] and pairs(found["in"]) == [(4, 0, [0, 3], [2.0, 4.0]), (6, 0, [0], [1.0])]
    assert flows.bipartite_graph(edges)[1:] == (4, 3)


def test_chunks_and_hilbert_lines(spark, tmp_path):
    edges = spark.createDataFrame([(1, i) for i in range(25)] + [(2, 7)], "src long, dst long")
    found = pairs(adjacency.adjacency_chunks(edges, 10))
    assert found == [(1, 0, list(range(10))), (1, 1, list(range(10, 20))), (1, 2, list(range(20, 25))), (2, 0, [7])]
    ranked = ordering.hilbert_ranks(spark.createDataFrame([(0, 1), (2, 0), (3, 3)], "src long, dst long"), 2)
    formats.write_hilbert_edges(ranked, str(tmp_path / "h"))
    lines = [line for p in sorted((tmp_path / "h").glob("part-*")) for line in p.read_text().splitlines()]
    assert lines == ["0 1 0", "3 3 1", "2 0 2"]


def plain_blocks(edges, order, most):
    out = []

    def quarter(x, y, depth, own):
        side = 1 << (order - depth)
        if depth >= min(5, order) and len(own) < most or side == 1:
            if own:
                out.append((x, y, side, len(own)))
            return
        for a in (x, x + side // 2):
            for b in (y, y + side // 2):
                inside = [(s, d) for s, d in own if a <= s < a + side // 2 and b <= d < b + side // 2]
                if inside:
                    quarter(a, b, depth + 1, inside)

    quarter(0, 0, 0, edges)
    return sorted(out)


@pytest.mark.parametrize("order, most, part", [(3, 2, 4), (7, 3, 50), (7, 16, 200), (9, 64, 300), (9, 7, 500_000)])
def test_blocks_are_the_quadtrees(spark, monkeypatch, order, most, part):
    monkeypatch.setattr(blocking, "PART", part)
    pick = random.Random(order * most)
    side = 1 << order
    edges = {(min(side - 1, int(pick.expovariate(8 / side))), pick.randrange(side)) for _ in range(min(1500, side * side // 2))}
    frame = spark.createDataFrame(list(edges), "src long, dst long").repartition(3)
    assigned = blocking.block_of_edges(frame, order, most).cache()
    found = sorted((r.x, r.y, r.side_len, r.nnz) for r in blocking.blocks(assigned, order).collect())
    assert found == plain_blocks(list(edges), order, most)
    assert sorted(r.place for r in assigned.collect()) == list(range(len(edges)))
