"""Cover trees over unit vectors, and the dual traversal that finds all pairs within a cosine.

A tree's level l has nodes of radius 2 ** (1 - l): every point under a node is that near to the node's centre, and
centres of a node's children are farther apart than the children's radius. Levels are nested: a centre is one at all
deeper levels. Points are kept in depth-first order, so a node is a range of places, and a tree is no more than
that order and the level at which each point first is a centre.

The traversal descends in two trees at once. With d the distance of two centres and a, b the largest distances
under them, a pair of nodes is dropped if d - a - b is over the threshold's distance, and taken whole, without a look at
its points, if d + a + b is under it; both by a margin that is wider than rounding. What is left at the last level
is decided by the cosines themselves.
"""

from __future__ import annotations

import math

import numpy as np

#: Wider than the rounding of distances; pairs in between are decided by their cosine.
MARGIN = 1e-6
#: Cells of a distance matrix that are computed at a time.
TILE = 1 << 20


def radius(level: int) -> float:
    return 2.0 ** (1 - level)


def reach(cosine: float) -> float:
    """The distance of unit vectors with that cosine."""
    return math.sqrt(max(0.0, 2 - 2 * cosine))


def last_level(cosine: float) -> int:
    """The level whose radius is an eighth of the threshold's distance, from which on descending saves nothing."""
    level = 1
    while radius(level) > max(reach(cosine), 1e-3) / 8:
        level += 1
    return level


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; rows are scaled first, so that no square overflows or vanishes."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def build(points: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``points``, unit vectors, and the level at which each, so ordered, first is a centre."""
    order, level = [], np.zeros(len(points), np.int8)
    todo = [(0, 0, np.arange(len(points)))]  # a node: its level, that at which its centre became one, and its points, the centre first
    while todo:
        depth, since, own = todo.pop()
        if len(own) == 1 or depth == last:
            level[len(order)] = since
            level[len(order) + 1 : len(order) + len(own)] = last + 1  # under a node of the last level
            order.extend(own.tolist())
            continue
        children, rest, near = [], own, radius(depth + 1) - MARGIN
        while len(rest):
            dots = points[rest] @ points[rest[0]]
            inside = 2 - 2 * dots <= near * near
            inside[0] = True
            children.append(rest[inside])
            rest = rest[~inside]
        todo.extend((depth + 1, depth + 1 if k else since, child) for k, child in reversed(list(enumerate(children))))
    return np.array(order, np.int64), level


class Tree:
    """A tree of unit vectors in the order of ``build``: at each level the nodes' starts, ends, radii and children."""

    def __init__(self, points: np.ndarray, level: np.ndarray, last: int):
        self.points, self.last = points, last
        self.starts, self.ends, self.radii = [], [], []
        for depth in range(last + 1):
            starts = np.flatnonzero(level <= depth)
            sizes = np.diff(starts, append=len(level))
            dots = np.einsum("ij,ij->i", points, points[np.repeat(starts, sizes)])
            far = np.sqrt(np.maximum(0, 2 - 2 * np.minimum.reduceat(dots, starts))) if len(starts) else np.zeros(0)
            self.starts.append(starts)
            self.ends.append(starts + sizes)
            self.radii.append(np.where(sizes == 1, 0.0, far))
        self.child = [np.append(np.searchsorted(below, above), len(below)) for above, below in zip(self.starts, self.starts[1:])]


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range behind the other."""
    sizes = ends - starts
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class _Joined:
    """Sets of places, joined by links; a set's name is its smallest place."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        while True:
            a, b = self.parent[u], self.parent[v]
            open_ = a != b
            if not open_.any():
                return
            u, v, a, b = u[open_], v[open_], a[open_], b[open_]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            while (self.parent[self.parent] != self.parent).any():
                self.parent = self.parent[self.parent]


class Traversal:
    """Links between the points of two trees, or of one tree if ``b`` is None: ``counts`` of partners' weights, and ``joined`` sets.

    Places of the second tree follow those of the first.
    """

    def __init__(self, a: Tree, weights_a: np.ndarray, b: Tree | None, weights_b: np.ndarray | None, cosine: float):
        self.same, self.cosine, self.reach = b is None, cosine, reach(cosine)
        self.a, self.b = a, a if b is None else b
        self.shift = 0 if self.same else len(a.points)
        weights = weights_a if self.same else np.concatenate([weights_a, weights_b])
        self.weights, self.before = weights, np.concatenate([[0], np.cumsum(weights)])
        self.counts, self.steps = np.zeros(len(weights), np.int64), np.zeros(len(weights) + 1, np.int64)
        self.joined, self.evaluated = _Joined(len(weights)), 0
        if len(a.points) and len(self.b.points):
            self._visit(0, 0, np.zeros(1, np.int64))
        self.counts += np.cumsum(self.steps)[:-1]

    def _visit(self, depth: int, node: int, others: np.ndarray) -> None:
        """What a node of the first tree has in common with some nodes of the second, at one level."""
        a, b = self.a, self.b
        if depth == a.last:
            self._compare(np.arange(a.starts[depth][node], a.ends[depth][node]), _ranges(b.starts[depth][others], b.ends[depth][others]))
            return
        own = np.arange(a.child[depth][node], a.child[depth][node + 1])
        theirs = _ranges(b.child[depth][others], b.child[depth][others + 1])
        depth += 1
        high = max(1, TILE // max(1, len(theirs)))
        for at in range(0, len(own), high):
            some = own[at : at + high]
            dots = a.points[a.starts[depth][some]] @ b.points[b.starts[depth][theirs]].T
            self.evaluated += dots.size
            apart = np.sqrt(np.maximum(0, 2 - 2 * dots))
            under = a.radii[depth][some][:, None] + b.radii[depth][theirs][None, :]
            open_ = apart - under <= self.reach + MARGIN
            if self.same:
                open_ &= theirs[None, :] >= some[:, None]
            whole = open_ & (apart + under <= self.reach - MARGIN)
            i, j = np.nonzero(whole)
            if len(i):
                self._take(depth, some[i], theirs[j])
            open_ &= ~whole
            for k in np.flatnonzero(open_.any(axis=1)):
                self._visit(depth, some[k], theirs[open_[k]])

    def _take(self, depth: int, i: np.ndarray, j: np.ndarray) -> None:
        """All points under nodes i link to all under nodes j."""
        ai, ae = self.a.starts[depth][i], self.a.ends[depth][i]
        bi, be = self.b.starts[depth][j] + self.shift, self.b.ends[depth][j] + self.shift
        own = (ai == bi) if self.same else np.zeros(len(i), bool)
        for start, end, amount in ((ai, ae, self.before[be] - self.before[bi]), (bi[~own], be[~own], (self.before[ae] - self.before[ai])[~own])):
            np.add.at(self.steps, start, amount)
            np.add.at(self.steps, end, -amount)
        inside = _ranges(ai[own], ae[own])
        self.counts[inside] -= self.weights[inside]
        self.joined.join(np.concatenate([np.repeat(ai, be - bi), np.repeat(bi, ae - ai)]), np.concatenate([_ranges(bi, be), _ranges(ai, ae)]))

    def _compare(self, i: np.ndarray, j: np.ndarray) -> None:
        high = max(1, TILE // max(1, len(j)))
        for at in range(0, len(i), high):
            some = i[at : at + high]
            linked = self.a.points[some] @ self.b.points[j].T >= self.cosine
            self.evaluated += linked.size
            if self.same:
                linked &= j[None, :] > some[:, None]
            self.counts[some] += linked @ self.weights[j + self.shift]
            np.add.at(self.counts, j + self.shift, self.weights[some] @ linked)
            u, v = np.nonzero(linked)
            if len(u):
                self.joined.join(some[u], j[v] + self.shift)
