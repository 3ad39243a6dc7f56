"""The edge map over blocks, components, the bipartite order, merged blocks, boxes by intervals and factors, against plain versions."""

import random
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.functions import curves
from edgeloom.operators import bandwidth, blocking, canonical, components, edge_map, factorise, ordering, pagerank, ranges
from edgeloom.plans import flows
from edgeloom.shared import bucketed


def frame(spark, edges, schema="src long, dst long"):
    return spark.createDataFrame(edges, schema).repartition(3)


def some_edges(pick, n, m):
    return sorted({(pick.randrange(n), pick.randrange(n)) for _ in range(m)})


@pytest.mark.parametrize("broadcast", [0, 1 << 24])
def test_edge_map(spark, monkeypatch, broadcast):
    monkeypatch.setattr(edge_map, "STRIPE", 16)
    pick = random.Random(1)
    edges = some_edges(pick, 100, 900) + [(3, d) for d in range(100, 400)]
    edges = sorted(set(edges))
    values = {i: pick.random() for i in range(0, 400, 2)}
    wanted = defaultdict(float)
    for s, d in edges:
        wanted[d] += values.get(s, 0)
    with bucketed(spark) as store:
        layout = edge_map.Layout(frame(spark, edges), store, most=8, run_edges=20, fan=2, buckets=4, broadcast_bytes=broadcast)
        assert layout.few == bool(broadcast)
        found = {r.id: r.total for r in layout.sums(frame(spark, list(values.items()), "id long, value double")).collect()}
        cells = layout.cells.collect()
    assert set(found) == set(wanted) and all(abs(found[i] - wanted[i]) < 1e-9 for i in wanted)
    assert sorted((16 * c.stripe + s, d) for c in cells for s, d in zip(c.sources, c.destinations)) == edges
    assert max(len(c.sources) for c in cells) <= 28  # a run and a block


def test_no_task_has_a_hub(spark):
    """A vertex that a third of all edges leave: no task of the layout has over twice the median's edges."""
    pick = random.Random(2)
    edges = some_edges(pick, 3_000, 20_000)
    edges = sorted(set(edges) | {(5, d) for d in range(0, 10_000)})
    with bucketed(spark) as store:
        layout = edge_map.Layout(frame(spark, edges), store, most=32, run_edges=200, buckets=6)
        sizes = layout.cells.groupBy(F.spark_partition_id()).agg(F.sum(F.size("sources")).alias("n")).collect()
    sizes = sorted(r.n for r in sizes)
    assert sum(sizes) == len(edges) and sizes[-1] <= 2 * sizes[len(sizes) // 2]


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_pagerank_forms_agree(spark, rounds):
    own = some_edges(random.Random(3), 60, 300) + [(4, d) for d in range(60, 90)]
    a = {r.id: r.score for r in pagerank.pagerank(frame(spark, own), rounds, hub_edges=7).collect()}
    b = {r.id: r.score for r in pagerank.pagerank_blocks(frame(spark, own), rounds, most=4).collect()}
    assert set(a) == set(b) == {x for e in own for x in e}
    assert all(abs(a[i] - b[i]) < 1e-12 for i in a)
    empty = frame(spark, [(0, 1)]).limit(0)
    assert pagerank.pagerank(empty, rounds).count() == pagerank.pagerank_blocks(empty, rounds).count() == 0


def plain_components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def test_components(spark):
    pick = random.Random(4)
    for edges in (some_edges(pick, 300, 200) + [(i, 500) for i in range(100, 400)] + [(900, 901), (950, 950)], []):
        found = components.components(frame(spark, edges))
        assert {r.id: r.component for r in found.collect()} == plain_components(edges)


def test_components_of_a_long_chain(spark):
    names = list(range(10_000))
    random.Random(5).shuffle(names)
    found = components.components(frame(spark, list(zip(names, names[1:]))))
    assert [tuple(r) for r in components.value_counts(found).collect()] == [(0, 10_000)]


def test_labellings(spark):
    def labels(rows):
        return spark.createDataFrame(rows, "id long, component long")

    one = labels([(1, 1), (2, 1), (3, 3), (4, 4)])
    other = labels([(1, 9), (2, 9), (3, 8), (4, 7)])
    crossed = labels([(1, 1), (3, 1), (2, 2), (4, 4)])
    assert sorted(map(tuple, components.compared(one, other).collect())) == [(1, 2, 2), (2, 1, 1)]
    assert sorted(map(tuple, components.compared(one, labels([(1, 1), (2, 1), (3, 1)])).collect())) == [(1, 2, 0), (2, 1, 0), (3, 0, 1)]
    assert components.same_partition(one, other) and not components.same_partition(one, crossed)
    assert not components.same_partition(one, one.where("id < 4"))


def plain_order(edges):
    """The queue's order: from the lowest degree left, neighbours by degree and id."""
    near = defaultdict(set)
    for s, d in edges:
        near[0, s].add((1, d))
        near[1, d].add((0, s))
    order, seen = [], set()
    for start in sorted((v for v in near if v[0] == 0), key=lambda v: (len(near[v]), v)):
        queue = deque([] if start in seen else [start])
        seen.add(start)
        while queue:
            v = queue.popleft()
            order.append(v)
            new = sorted(near[v] - seen, key=lambda w: (len(near[w]), w))
            seen.update(new)
            queue.extend(new)
    sides = [[v for v in order if v[0] == side] for side in (0, 1)]
    return {v: i for own in sides for i, v in enumerate(own)}


def test_cuthill_mckee(spark):
    pick = random.Random(6)
    band = [(i, i + j) for i in range(5) for j in (0, 1)]
    rows, columns = list(range(5)), list(range(6))
    pick.shuffle(rows)
    pick.shuffle(columns)
    for edges in (some_edges(pick, 40, 60), []):
        found = bandwidth.cuthill_mckee(frame(spark, edges))
        assert {(r.side, r.old_id): r.new_id for r in found.collect()} == plain_order(edges)
    chain = frame(spark, [(rows[i], columns[j]) for i, j in band])
    order = bandwidth.cuthill_mckee(chain)
    assert bandwidth.bandwidth(chain) > 2 and bandwidth.bandwidth(ordering.relabel_sides(chain, order)) <= 1


@pytest.mark.parametrize("most", [7, 10**6])
def test_merged_blocks(spark, most):
    pick = random.Random(most)
    blocks = [(3 * i, pick.choice((1, 2, 5, 9))) for i in range(300)]
    wanted, start, total = [], 0, 0
    for i, (idx, nnz) in enumerate(blocks):
        if i > start and total + nnz >= most:
            wanted.append((len(wanted), start, i - start, blocks[start][0], total))
            start, total = i, 0
        total += nnz
    wanted.append((len(wanted), start, len(blocks) - start, blocks[start][0], total))
    found = blocking.merge_blocks(frame(spark, blocks, "idx long, nnz long"), most).collect()
    assert sorted(map(tuple, found)) == wanted
    assert blocking.merge_blocks(frame(spark, blocks, "idx long, nnz long").limit(0), most).count() == 0


def test_intervals(spark):
    pick = random.Random(7)
    for _ in range(200):
        order = pick.randrange(1, 7)
        (a, b), (c, d) = (sorted(pick.choices(range((1 << order) + 1), k=2)) for _ in "xy")
        cells = {curves.hilbert_index(x, y, order) for x in range(a, b) for y in range(c, d)}
        for most in (1, 5, 10**9):
            found = ranges.box_intervals(order, a, b, c, d, most)
            covered = {h for low, high in found for h in range(low, high)}
            assert cells <= covered and len(found) <= most
            assert most < 10**9 or cells == covered
    assert len(ranges.box_intervals(31, 5, 2**30, 17, 2**30 + 3)) <= ranges.MOST_INTERVALS
    edges = some_edges(pick, 64, 1_500)
    keyed = ordering.with_hilbert(frame(spark, edges), 6)
    box = (10, 33, 5, 61)
    inside = [(s, d) for s, d in edges if 10 <= s < 33 and 5 <= d < 61]
    by_ranges = ranges.box_by_ranges(keyed, 6, box, most=9)
    assert sorted((r.src, r.dst) for r in by_ranges.collect()) == inside
    assert [r.n for cap in (0, 10, 10**6) for r in ranges.capped_count(by_ranges, cap).collect()] == [1, 11, len(inside)]
    assert ranges.box_by_ranges(keyed, 6, (3, 3, 0, 9)).count() == 0
    assert ordering.with_hilbert(frame(spark, edges), 6).where(F.col("h") != F.udf(lambda x, y: curves.hilbert_index(x, y, 6), "long")("src", "dst")).count() == 0


def test_factors(spark):
    pick = np.random.default_rng(8)
    edges = [(int(s), int(d), float(pick.random() * 5)) for s, d in some_edges(random.Random(8), 40, 200)] + [(0, 60 + i, 1.0) for i in range(50)]
    ids = sorted({x for e in edges for x in e[:2]})
    start = {i: pick.random(20) for i in ids}
    now = {i: v.copy() for i, v in start.items()}
    for _ in range(5):
        gradient = {i: np.zeros(20) for i in ids}
        for s, d, w in edges:
            error = w - float(now[s] @ now[d])
            gradient[s] += error * now[d]
            gradient[d] += error * now[s]
        now = {i: now[i] + 1e-3 * gradient[i] for i in ids}
    graph = frame(spark, edges, "src long, dst long, weight double")
    begun = spark.createDataFrame([(i, v.tolist()) for i, v in start.items()], "id long, factors array<double>")
    found = factorise.factorise(graph, 5, step=1e-3, start=begun)
    rows = {r.id: np.array(r.factors) for r in found.collect()}
    assert set(rows) == set(ids) and max(np.abs(rows[i] - now[i]).max() for i in ids) < 1e-9
    assert factorise.squared_error(graph, found) < factorise.squared_error(graph, begun)
    assert factorise.factorise(graph.drop("weight"), 0, rank=3).count() == len(ids)


def test_factors_move_once_a_cell(spark, monkeypatch):
    # sources and destinations share no id; a hub has a third of all edges, some ends or weights are null, and repeated edges pull twice
    pick = random.Random(5)
    edges = [(pick.randrange(50), 100 + pick.randrange(8), float(pick.randrange(1, 9))) for _ in range(400)] + [(3, 100 + i % 8, 2.0) for i in range(200)]
    graph = frame(spark, [*edges, (None, 101, 1.0), (1, None, 1.0), (1, 102, None)], "src long, dst long, weight double").repartition(5)
    wanted = factorise.factorise(graph.where("src is not null and dst is not null"), 2, step=1e-4)
    wanted = {r.id: r.factors for r in wanted.collect()}
    for name, n in (("STRIPE", 16), ("CELL_EDGES", 40), ("FEW_EDGES", 10), ("CHUNK", 7)):
        monkeypatch.setattr(factorise, name, n)
    sizes = []
    layout = factorise._layout

    def told(*args):
        cells = layout(*args)
        sizes.extend(r["count"] for r in cells.groupBy("cell").count().collect())
        return cells

    monkeypatch.setattr(factorise, "_layout", told)
    found = {r.id: r.factors for r in factorise.factorise(graph.where("src is not null and dst is not null"), 2, step=1e-4).collect()}
    assert set(found) == set(wanted) and max(abs(x - y) for i in found for x, y in zip(found[i], wanted[i])) < 1e-9
    assert sum(sizes) == 600 and max(sizes) < 150 and len(sizes) > 8


def test_factors_send_few_vectors():
    p, q = factorise._stripes(36_000_000, 1_200_000, 60_000, 6)
    assert p * q >= 18 and 1_200_000 * q + 60_000 * p < 36_000_000 / 10
    assert factorise._stripes(0, 0, 0, 8) == (1, 1)


def test_ids_beyond_32_bits_and_bad_lines_through_a_run(spark, tmp_path):
    (tmp_path / "raw.net").write_text("3000000000 5\n5 9223372036854775807\n7 7\nno\n3000000000 5\n")
    sizes = flows.canonicalise(spark, str(tmp_path / "raw.net"), str(tmp_path / "g"))
    assert sizes == {"n": 4, "m": 3, "bad": 1}
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "g" / "edges")).collect())
    assert lines == ["0 3", "1 1", "2 0"]


def jobs(spark, run):
    group = f"g{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setJobGroup("", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_algorithms_of_a_run(spark, tmp_path):
    pick = random.Random(9)
    edges = some_edges(pick, 64, 600)
    (tmp_path / "raw.net").write_text("".join(f"{s} {d}\n" for s, d in edges))
    folder = str(tmp_path / "g")
    flows.canonicalise(spark, str(tmp_path / "raw.net"), folder)
    flows.translate(spark, folder)
    dense = {v: i for i, v in enumerate(sorted({x for e in edges for x in e}))}
    numbers, labels = flows.block_and_rank(spark, folder, 16, "cc")
    assert numbers["m"] == len(edges) and numbers["n"] == len(dense)
    assert {r.id: r.component for r in labels.collect()} == plain_components([(dense[s], dense[d]) for s, d in edges])
    _, factors = flows.block_and_rank(spark, folder, 16, "cf", iterations=1)
    assert factors.count() == len(dense) and len(factors.first().factors) == factorise.RANK
    with pytest.raises(ValueError):
        flows.algorithm("bfs")
    # numbers come from the writes: no job counts the edges or blocks again
    observed = jobs(spark, lambda: flows.block_and_rank(spark, folder, 16, "none"))
    assert observed <= 24, observed


def test_command_line(spark, tmp_path, capsys):
    from edgeloom.__main__ import main

    pick, folder = random.Random(10), str(tmp_path / "g")
    (tmp_path / "raw.net").write_text("".join(f"{s} {d}\n" for s, d in some_edges(pick, 64, 500)))
    main(["compress", str(tmp_path / "raw.net"), folder])
    main(["translate", folder])
    main(["run", folder, "-m", "16", "-i", "2", "-e", "2", "-s", str(tmp_path / "scores")])
    said = capsys.readouterr().out
    assert said.count("blocks: ") == 2 and spark.read.parquet(str(tmp_path / "scores")).count() == 64
    assert len((tmp_path / "g" / "results.csv").read_text().splitlines()) == 3  # a head and a row an experiment
    with pytest.raises(SystemExit):
        main(["run", folder, "-m", "16", "-a", "bfs"])


def test_hubs_lists_and_gaps(spark):
    from edgeloom.operators import adjacency

    edges = sorted({(0, d) for d in range(0, 60, 3)} | set(some_edges(random.Random(11), 20, 80)))
    weighted = frame(spark, [(s, d, s + d / 100) for s, d in edges], "src long, dst long, weight double")
    lists = adjacency.adjacency_chunks(weighted, 7).collect()
    assert max(len(r.neighbours) for r in lists) == 7
    assert sorted((r.id, n, w) for r in lists for n, w in zip(r.neighbours, r.weights)) == [(s, d, s + d / 100) for s, d in edges]
    gaps = [abs(b[1] - a[1]) for a, b in zip(edges, edges[1:]) if a[0] == b[0]]
    found = adjacency.read_write_distance(frame(spark, edges), 60).first()
    assert abs(found.read_distance - 60 / len(edges)) < 1e-12 and abs(found.write_distance - sum(gaps) / len(edges)) < 1e-12


def test_dear_input_is_stored_before_it_is_ranked(spark):
    rows = frame(spark, [(i % 7, i) for i in range(50)])
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    dear = canonical.numbered(rows.mapInArrow(counted, "src long, dst long"), "src", "dst")
    assert sorted((r.rank, r.src, r.dst) for r in dear.collect()) == [(k, s, d) for k, (s, d) in enumerate(sorted((i % 7, i) for i in range(50)))]
    assert seen.value == 50
