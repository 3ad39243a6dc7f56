"""Packing of documents into sequences by a configuration linear program.

A document's tokens, ended by ``end_id``, are one piece, or pieces of ``capacity`` tokens if there are more,
the first of them shorter. How many pieces of each length there are decides everything: with ``capacity``
lengths at most, that histogram is the only thing the driver sees. A configuration is a multiset of
lengths that fits a sequence. The linear program - fewest sequences that hold all pieces - is solved by
multiplicative weights: each round prices lengths by how little of them is covered so far, and a knapsack
dynamic program finds the configuration of the largest price. Rounded down, the solution's configurations
are filled; what is left gets programs of its own, and the last few pieces are put best-fit, largest first. Pieces
then find their sequence by their rank among pieces of the same length.

Defined results: a null text is empty and still a piece of one token; repeated rows are packed one by one; a
null ``doc_id`` is kept; an empty table gives no rows; a text of any length is cut into pieces in one task, which holds
its ids; other columns, of any name, are ignored.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm import storage, tokens

CAPACITY = 1024
END_ID = 2
ROUNDS = 40
#: Roundings that are tried: the share of the first solution, and how often what is left gets a program of its own.
ROUNDINGS = ((1.0, 3), (0.9, 3), (0.75, 3), (0.5, 3), (0.75, 0), (0.5, 0), (0.25, 0))
#: How fast a covered length gets cheaper.
STEP = 0.05
#: How far from full price a configuration may be.
SLACK = 0.02
#: Rows (task, length) of rank offsets that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("task", pa.int32()), ("rank", pa.int64()), ("ids", pa.binary())])


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens; only the first may be shorter."""
    return ([n % capacity] if n % capacity else []) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Every piece with its ids (narrowed), and its rank among the task's pieces of its length."""
    end = struct.pack("<I", end_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, ranks = tokens.encoder(tokenizer).encode_all, TaskContext.get().partitionId(), Counter()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, some in tokens.in_bytes(texts):
                rows = []
                for doc_id, one in zip(ids[first:], encode(some), strict=False):
                    one, at = one + end, 0
                    for piece, n in enumerate(cut_lengths(len(one) // 4, capacity)):
                        rows.append((doc_id, piece, at, n, task, ranks[n], narrow(one[4 * at : 4 * (at + n)])))
                        ranks[n] += 1
                        at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return docs.select("doc_id", "text").mapInArrow(storage.frugal(cut, partial(tokens.forget, tokenizer)), "doc_id long, piece int, start long, length int, task int, rank long, ids binary")


class Knapsack:
    """The dynamic program: for each room, the largest total price and the length to take for it.

    Of equal prices the longest length is taken, so short ones stay for what nothing else fills.
    """

    def __init__(self, prices: np.ndarray, lengths: np.ndarray, capacity: int):
        self.prices, self.lengths, self.capacity = prices, lengths, capacity
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        backward, down = prices[::-1], lengths[::-1]
        for room in range(int(lengths[0]), capacity + 1):
            skip = len(lengths) - int(np.searchsorted(lengths, room, "right"))
            gain = best[room - down[skip:]] + backward[skip:]
            i = int(gain.argmax())
            if gain[i] > best[room - 1]:
                best[room], pick[room] = gain[i], len(lengths) - 1 - skip - i
            else:
                best[room] = best[room - 1]
        self.best, self.pick = best, pick

    def with_length(self, i: int) -> tuple[Counter, float]:
        """The dearest configuration (index -> how many) that has length ``i``, and its price."""
        config, room = Counter([i]), self.capacity - int(self.lengths[i])
        price = self.prices[i] + self.best[room]
        while room > 0:
            if self.pick[room] < 0:
                room -= 1
            else:
                config[int(self.pick[room])] += 1
                room -= int(self.lengths[self.pick[room]])
        return config, float(price)


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int) -> list[tuple[Counter, float]]:
    """Configurations and how often each is used: multiplicative weights for the covering program.

    A length's weight starts at its total size, so that a full sequence is worth most, and shrinks by a factor for
    each share of it that gets covered. A round solves one knapsack and uses, for each length, the dearest
    configuration with it, if that is within SLACK of the dearest of all, up to what is uncovered of its bottleneck.
    """
    weights, left, used = lengths * counts.astype(float), counts.astype(float), []
    for _ in range(rounds):
        program = Knapsack(weights / counts, lengths, capacity)
        before = left.copy()
        for i in range(len(lengths) - 1, -1, -1):
            if left[i] <= 0:
                continue
            config, price = program.with_length(i)
            often = min(left[j] / n for j, n in config.items())
            if price < (1 - SLACK) * program.best[capacity] or often <= 0:
                continue
            for j, n in config.items():
                left[j] -= often * n
            used.append((config, often))
        weights *= np.exp(-STEP * (before - left) / counts)
        if (left <= 0).all() or (before - left).sum() < counts.sum() * 1e-4:
            break
    return used


def rounded(used: list[tuple[Counter, float]], left: np.ndarray, share: float) -> list[tuple[Counter, int]]:
    """Whole numbers of configurations, of ``share`` of the solution; never more of a length than is left, which is lowered."""
    merged: Counter = Counter()
    for config, often in used:
        merged[tuple(sorted(config.items()))] += often
    plan = []
    for config, often in sorted(merged.items(), key=lambda x: (-x[1], x[0])):
        n = min(int(share * often), *(int(left[i]) // k for i, k in config))
        if n:
            plan.append((Counter(dict(config)), n))
            for i, k in config:
                left[i] -= n * k
    return plan


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[Counter, int]]:
    """Best fit of the longest first; equal sequences are handled together, so counts may be of any size."""
    open_: dict[int, dict[tuple, int]] = {}  # room -> contents -> sequences

    def put(room: int, contents: tuple, n: int) -> None:
        if n:
            own = open_.setdefault(room, {})
            own[contents] = own.get(contents, 0) + n

    for i in range(len(lengths) - 1, -1, -1):
        size, todo = int(lengths[i]), int(counts[i])
        while todo:
            room = min((r for r in open_ if r >= size), default=None)
            if room is None:
                each, contents, have = capacity // size, (), -(-todo // (capacity // size))
                room = capacity
            else:
                each, (contents, have) = room // size, open_[room].popitem()
                if not open_[room]:
                    del open_[room]
            full = min(have, todo // each)
            put(room - each * size, (*contents, (i, each)), full)
            todo -= full * each
            if full < have:
                if todo:
                    put(room - todo * size, (*contents, (i, todo)), 1)
                    full, todo = full + 1, 0
                if contents:
                    put(room, contents, have - full)
    plan: Counter = Counter()
    for own in open_.values():
        for contents, n in own.items():
            plan[contents] += n
    return [(Counter(dict(contents)), n) for contents, n in plan.items()]


def _packed(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, share: float, programs: int, first: list[tuple[Counter, float]]) -> tuple[list[tuple[Counter, int]], list[tuple[Counter, int]]]:
    """What the programs fill and what best fit adds: ``share`` of the first solution, then ``programs`` whole solutions of what is left."""
    left, plan, used, index = counts.copy(), [], first, np.arange(len(lengths))
    for n_left in range(programs, -1, -1):
        own = left[index]
        placed = rounded(used, own, share)
        plan += [(Counter({int(index[i]): k for i, k in config.items()}), n) for config, n in placed]
        left[index] = own
        index = np.flatnonzero(left)
        if not n_left or not len(index) or not placed and share == 1.0:
            break
        used, share = fractional(lengths[index], left[index], capacity, rounds), 1.0
    return plan, best_fit(lengths, left, capacity)


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """The packing: (length -> how many, sequences with these contents).

    The fractional solution is rounded down, and what is left is solved and rounded again; best fit takes the rest,
    which are few pieces, less than a sequence for each length. How much of the first solution is used, and so how
    many short pieces remain for the rest, is chosen by the number of sequences that come out.
    """
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[n] for n in lengths.tolist()], np.int64)
    if not len(lengths):
        return []
    first, best = fractional(lengths, counts, capacity, rounds), None
    bound = -(-int(lengths @ counts) // capacity)
    for share, programs in ROUNDINGS:
        plan = [x for part in _packed(lengths, counts, capacity, rounds, share, programs, first) for x in part]
        if best is None or sum(n for _, n in plan) < sum(n for _, n in best):
            best = plan
        if sum(n for _, n in best) == bound:  # no packing has fewer
            break
    return [({int(lengths[i]): k for i, k in c.items()}, n) for c, n in best]


def places(plan: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank, first sequence and offset of each slot. A slot is a place in all sequences of a kind."""
    slots: dict[int, list[list[int]]] = {}
    given, sequence = Counter(), 0
    for config, n in plan:
        offset = 0
        for length in sorted(config, reverse=True):
            for _ in range(config[length]):
                slots.setdefault(length, []).append([given[length], sequence, offset])
                given[length] += n
                offset += length
        sequence += n
    return {length: tuple(np.array(x, np.int64).T) for length, x in slots.items()}


def pack(docs: DataFrame, tokenizer: str = tokens.DEFAULT_TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, sequence_id, offset, ids`` (little-endian uint32) for every piece."""
    found = storage.cut(pieces(docs, tokenizer, capacity, end_id), "pieces")
    counts = storage.cut(found.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {x.length: x.n for x in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    where = places(solve(histogram, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    base = F.broadcast(base) if counts.count() <= BROADCAST_ROWS else base.hint("merge")
    rows = found.join(base, ["task", "length"]).select("doc_id", "piece", "start", "length", (F.col("rank") + F.col("base")).alias("rank"), "ids")
    schema = pa.schema([*list(_PIECES)[:4], ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = np.asarray(batch.column(3)), np.asarray(batch.column(4))
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for length in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == length)
                first, start, at = where[length]
                slot = np.searchsorted(first, ranks[own], "right") - 1
                sequence[own], offset[own] = start[slot] + ranks[own] - first[slot], at[slot]
            ids = [wide(x) for x in batch.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sequence), pa.array(offset), pa.array(ids, pa.binary())], schema=schema)

    return rows.mapInArrow(storage.frugal(assign), "doc_id long, piece int, start long, length int, sequence_id long, offset long, ids binary")


def narrow(ids: bytes) -> bytes:
    """Ids in two bytes each where that holds them, behind a byte that tells the width."""
    values = np.frombuffer(ids, "<u4")
    return b"\2" + values.astype("<u2").tobytes() if not len(values) or values.max() < 65_536 else b"\4" + ids


def wide(ids: bytes) -> bytes:
    return np.frombuffer(ids, f"<u{ids[0]}", offset=1).astype("<u4").tobytes()
