"""The operators on vectors against plain versions, on fixtures with nulls, odd numbers, repeats, ties and clashing names."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.llm import centroids, cover_tree, embedding_dedup, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def odd_vectors(dims, pick):
    nan, inf = float("nan"), float("inf")
    good = [pick.uniform(-1, 1) for _ in range(dims)]
    return [None, [], [None] + good[1:], [nan] + good[1:], good[1:] + [-inf], [0.0] * dims, good[1:], good + good, [3e38] + good[1:]]


def frame(spark, rows, parts=3):
    made = spark.createDataFrame(rows, SCHEMA)
    clashing = {c: made.label for c in ("e", "v", "n", "uid", "node", "best", "far", "own", "error", "cluster", "level", "root", "links")}
    return made.withColumns(clashing).repartition(parts)


@pytest.fixture(scope="session")
def vectors(spark):
    pick = random.Random(3)
    rows = [(i, [pick.choice((pick.uniform(-1, 1), 0.25, -0.5)) for _ in range(64)], pick.choice((0, 0, 0, 1, None))) for i in range(200)]
    rows += [(300 + i, v, 0) for i, v in enumerate(odd_vectors(64, pick))]
    rows += [(400 + i, rows[7][1], 1) for i in range(20)] + [rows[9], rows[9], (None, rows[3][1], None), (None, rows[4][1], 2)]
    return frame(spark, rows)


def plain_rows(vectors, scale, dims):
    kept = []
    for r in vectors.collect():
        if r.embedding is not None and len(r.embedding) == dims and all(x is not None and math.isfinite(x) and abs(x) < (1 << 24) / scale for x in r.embedding):
            kept.append((r.vec_id, [math.floor(Fraction(x) * scale) for x in r.embedding], r.label))
    return kept


def nearest(v, entries):
    return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(entries))


def plain_round(vectors, entries):
    groups = defaultdict(list)
    for v in vectors:
        groups[nearest(v, entries)[1]].append(v)
    return [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else e for k, e in enumerate(entries)]


def digest(numbers):
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


@pytest.mark.parametrize("clusters", [1, 5, 16, 500])
def test_centroids(vectors, clusters):
    rows = plain_rows(vectors, 64, 64)
    order = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    own = [r[1] for r in order[:clusters]]
    rounds = 3 if clusters < 100 else 1
    for _ in range(rounds):
        own = plain_round([r[1] for r in rows], own)
    best = [(i, *nearest(v, own)) for i, v, _ in rows]
    by = Counter()
    for _, d, k in best:
        by[k] += d
    wanted = [(i, k, d, by[k], sum(by.values()), digest(own[k])) for i, d, k in best]
    found = [(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.clustered(vectors, clusters=clusters, rounds=rounds).collect()]
    assert sorted(found, key=str) == sorted(wanted, key=str)


def test_no_vectors(spark, vectors):
    none = vectors.limit(0)
    assert centroids.clustered(none).collect() == [] and vector_codes.compress(none).collect() == [] and embedding_dedup.near_vectors(none).collect() == []
    alone = frame(spark, [(1, None, 0), (2, [], 0)])
    assert centroids.clustered(alone).collect() == [] and vector_codes.compress(alone).collect() == []
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(alone).orderBy("vec_id").collect()] == [(1, 0, 1, True), (2, 0, 2, True)]
    assert centroids.clustered(vectors).columns == centroids.clustered(none).columns and vector_codes.compress(vectors).columns == vector_codes.compress(none).columns


@pytest.mark.parametrize("parts,entries", [(16, 64), (4, 7), (64, 256)])
def test_codes(vectors, parts, entries):
    rows = sorted(plain_rows(vectors, 256, 64), key=lambda r: (r[0] is None, r[0], r[1]) if r[0] is not None else (True, 0, r[1]))
    width = 64 // parts
    books = [[r[1][p * width : (p + 1) * width] for r in rows[:entries]] for p in range(parts)]
    for _ in range(2):
        books = [plain_round([r[1][p * width : (p + 1) * width] for r in rows], books[p]) for p in range(parts)]
    coded, by = [], Counter()
    for i, v, label in rows:
        best = [nearest(v[p * width : (p + 1) * width], books[p]) for p in range(parts)]
        coded.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label))
        by[label] += coded[-1][2]
    sha = digest(x for book in books for entry in book for x in entry)
    found = [tuple(r) for r in vector_codes.compress(vectors, parts=parts, entries=entries).collect()]
    assert sorted(found, key=str) == sorted(((i, code, error, by[label], sha) for i, code, error, label in coded), key=str)


def test_first_vector_decides_the_length(spark):
    rows = frame(spark, [(1, [1.0] * 5, 0), (2, [0.5, 1.0, 2.0, 3.0], 0), (3, [0.5] * 8, 0), (4, [1.0] * 4, 0)])
    assert {r.vec_id for r in vector_codes.compress(rows, parts=2).collect()} == {2, 4}
    with pytest.raises(ValueError):
        vector_codes.compress(rows, entries=257)


def test_pivots_prune_and_change_nothing():
    pick = np.random.default_rng(5)
    entries = pick.integers(-200, 200, (64, 4))
    parts = np.concatenate([entries[pick.integers(0, 64, 3000)] + pick.integers(-9, 9, (3000, 4)), entries, entries[:5]])
    entries[40] = entries[3]  # a tie
    fixed = vector_codes.pivots(entries)
    far, between = (np.sqrt(vector_codes._distances(x, fixed)) for x in (parts, entries))
    which, best, evaluated = vector_codes.nearest(parts, far.astype(np.float32), entries, between)
    every = vector_codes._distances(parts, entries)
    assert (which == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert evaluated < 0.2 * every.size


# near-duplicates


def clustered_vectors(pick, n, dims, groups, spread, labels):
    bases = [[pick.gauss(0, 1) for _ in range(dims)] for _ in range(groups)]
    return [(i, [pick.choice((1.0, 1.0, 0.5)) * (x + pick.gauss(0, spread)) for x in pick.choice(bases)], pick.choice(labels)) for i in range(n)]


def plain_links(rows, cosine):
    links, parent = Counter(), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def direction(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, float) / max(map(abs, v))
        return v / math.sqrt(float(v @ v))

    units = [direction(r[1]) for r in rows]
    for i, (_, _, label) in enumerate(rows):
        for j in range(i):
            if label is not None and label == rows[j][2] and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= cosine:
                links[i] += 1
                links[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(r[0], least.get(root(i), r[0]))
    return [(r[0], links[i], least.get(root(i)), r[0] == least.get(root(i))) for i, r in enumerate(rows)]


@pytest.mark.parametrize("cell,broadcast,dims,groups,spread", [(4_096, 0, 3, 6, 0.15), (12, 1 << 24, 8, 4, 0.01), (12, 0, 3, 6, 0.15)])
def test_near_vectors(spark, cell, broadcast, dims, groups, spread):
    pick = random.Random(dims)
    rows = clustered_vectors(pick, 260, dims, groups, spread, (1, 1, 1, 2, None))
    rows += [(500 + i, v, 1) for i, v in enumerate(odd_vectors(dims, pick))]
    rows += [(600 + i, rows[2][1], 1) for i in range(30)] + [rows[5], rows[5], (None, rows[6][1], 2), (None, [9.0] * dims, 7)]
    pick.shuffle(rows)
    found = embedding_dedup.near_vectors(frame(spark, rows), cell=cell, broadcast_bytes=broadcast).collect()
    assert sorted(map(tuple, found), key=str) == sorted(plain_links(rows, 0.93), key=str)


def test_multiples_of_one_vector_are_dealt_by_hash(spark):
    rows = [(i, [float(1 + i), 2.0 * (1 + i), 0.0], 1) for i in range(100)] + [(100, [0.0, 0.0, 1.0], 1)]
    found = embedding_dedup.near_vectors(frame(spark, rows), cell=20).collect()
    assert sorted(map(tuple, found)) == [(i, 99, 0, i == 0) for i in range(100)] + [(100, 0, 100, True)]


def test_traversal_prunes():
    pick = np.random.default_rng(2)
    bases = pick.normal(size=(50, 32))
    points = cover_tree.units(np.repeat(bases, 40, axis=0) + 0.02 * pick.normal(size=(2000, 32)))
    last = cover_tree.last_level(0.93)
    order, level = cover_tree.build(points, last)
    done = cover_tree.Traversal(cover_tree.Tree(points[order], level, last), np.ones(2000, int), None, None, 0.93)
    assert (done.counts == ((points[order] @ points[order].T) >= 0.93).sum(axis=1) - 1).all()
    assert done.evaluated < 0.02 * 2000**2


def test_tree_invariants():
    pick = np.random.default_rng(4)
    points = cover_tree.units(pick.normal(size=(400, 5)))
    last = cover_tree.last_level(0.93)
    order, level = cover_tree.build(points, last)
    points, tree = points[order], cover_tree.Tree(points[order], level, last)
    assert sorted(order) == list(range(400))
    for depth in range(1, last + 1):
        for start, end, far in zip(tree.starts[depth], tree.ends[depth], tree.radii[depth]):
            assert far <= cover_tree.radius(depth)
            assert np.linalg.norm(points[start:end] - points[start], axis=1).max() <= far + 1e-7
        assert set(tree.starts[depth - 1]) <= set(tree.starts[depth])  # nested
        for a, b in zip(tree.child[depth - 1], tree.child[depth - 1][1:]):  # siblings are separated
            own = points[tree.starts[depth][a:b]]
            apart = np.linalg.norm(own[:, None] - own[None], axis=2) + 9 * np.eye(len(own))
            assert apart.min(initial=9) > cover_tree.radius(depth) - 1e-5
