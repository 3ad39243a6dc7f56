"""Vector codes: each of a vector's parts is replaced by the number of the nearest entry of that part's codebook.

Nearest entries are found with LAESA pivots. A few entries of the first codebook are a part position's fixed
pivots, and every part's distances to them are computed once and stored. In a round, the distances from the pivots to
the present entries give, by the triangle inequality, a lower bound for each part and entry: the largest difference of
their distances to a pivot. Entries are tried in the order of these bounds, exact integer distances decide, and
a part is done when its next bound is over the best distance found. Bounds are lowered by more than the rounding of
floats, so pruning never changes a result.

The rounds run in Arrow batches on the stored table; a task gives one row a codebook cell that it has met, and the
driver gets one row a cell. Labels' errors are summed before they meet the rows again.

Defined results: rows whose vector is null or holds null, NaN, infinite or immense components (``vectors.MOST_WHOLE``)
are left out, and so are vectors that can't be cut like the first one (of those that ``parts`` divides, the one of
the smallest id): those of another length. Null ids come last, equal ids are ordered by their vectors; equal rows
each count; fewer rows than entries give smaller codebooks; an empty table gives no rows; a sum of errors over what a
long holds is null; other columns, of any name, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm import storage
from edgeloom.llm.vectors import usable, whole

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
PIVOTS = 4
#: What a bound is lowered by, as a share of the distances that it comes from; single precision needs 6e-8.
SLACK = 1e-6
#: Rows that are ordered at a time.
ROWS = 4_096


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``a`` and ``b``, whole numbers."""
    return ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)


def pivots(codebook: np.ndarray, number: int = PIVOTS) -> np.ndarray:
    """Entries far from each other: the first, then always the one farthest from those that are chosen."""
    chosen, far = [0], _distances(codebook, codebook[:1])[:, 0]
    while len(chosen) < min(number, len(codebook)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(codebook, codebook[chosen[-1:]])[:, 0])
    return codebook[chosen]


def nearest(parts: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivot_entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each part's nearest entry, the lower number among equals, and how many distances it took."""
    low = np.zeros((len(parts), len(entries)))
    for p in range(to_pivots.shape[1]):
        a, b = to_pivots[:, p, None].astype(float), pivot_entries[None, :, p]
        np.maximum(low, np.abs(a - b) - SLACK * (a + b), out=low)
    low *= low
    order = np.argsort(low, axis=1, kind="stable")
    best, which = np.full(len(parts), np.iinfo(np.int64).max), np.full(len(parts), len(entries))
    active, evaluated = np.arange(len(parts)), 0
    for step in range(len(entries)):
        entry = order[active, step]
        open_ = low[active, entry] <= best[active]
        active, entry = active[open_], entry[open_]
        if not len(active):
            break
        evaluated += len(active)
        found = ((parts[active] - entries[entry]) ** 2).sum(axis=1)
        better = (found < best[active]) | ((found == best[active]) & (entry < which[active]))
        best[active[better]], which[active[better]] = found[better], entry[better]
    return which, best, evaluated


class Codebooks:
    """Entries (part, entry, component) and the fixed pivots of each part position."""

    def __init__(self, entries: np.ndarray, fixed: np.ndarray | None = None):
        self.entries = entries
        self.fixed = np.stack([pivots(e) for e in entries]) if fixed is None else fixed
        self.between = np.stack([np.sqrt(_distances(e, f)) for e, f in zip(self.entries, self.fixed)])

    def to_pivots(self, values: np.ndarray) -> np.ndarray:
        """Distances (row, part, pivot) of whole vectors to the pivots."""
        cut = values.reshape(len(values), len(self.entries), -1)
        return np.stack([np.sqrt(_distances(cut[:, p], f)) for p, f in enumerate(self.fixed)], axis=1)

    def assign(self, values: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry numbers and squared distances (row, part)."""
        cut, far = values.reshape(len(values), len(self.entries), -1), far.reshape(len(values), len(self.entries), -1)
        found = [nearest(cut[:, p], far[:, p], e, self.between[p])[:2] for p, e in enumerate(self.entries)]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)

    def moved(self, cells: dict[int, int]) -> Codebooks:
        """Entries as the floored means of their parts; ``cells`` has sums by place in (part, entry, component and count)."""
        parts, entries, width = self.entries.shape
        table = np.zeros(parts * entries * (width + 1), np.int64)
        table[list(cells)] = list(cells.values())
        table = table.reshape(parts, entries, width + 1)
        counts = table[..., width:]
        return Codebooks(np.where(counts > 0, table[..., :width] // np.maximum(counts, 1), self.entries), self.fixed)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _matrix(column: pa.ListArray, rows: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(rows, -1)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, ROWS):
        yield batch.slice(at, ROWS)


def _first(kept: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """The first codebook (part, entry, component), from the rows of the smallest ids that have the first one's length."""
    def smallest(rows: DataFrame) -> list[list[int]]:
        return [list(r.v) for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()]

    found = smallest(kept)
    if not found:
        return None
    if any(len(v) != len(found[0]) for v in found):
        found = smallest(kept.where(F.size("v") == len(found[0])))
    return np.array(found, np.int64).reshape(len(found), parts, -1).transpose(1, 0, 2)


def _sums(rows: DataFrame, books: Codebooks) -> dict[int, int]:
    """Sums and counts of the parts that each entry gets, by their place in a flat table."""
    parts, entries, width = books.entries.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            for some in _slices(batch):
                values = _matrix(some.column(0), some.num_rows).astype(np.int64)
                which, _ = books.assign(values, _matrix(some.column(1), some.num_rows))
                for place in np.ndindex(parts, width):  # a slice's sums are exact in doubles
                    table[place[0], :, place[1]] += np.bincount(which[:, place[0]], values[:, place[0] * width + place[1]], entries).astype(np.int64)
                for p in range(parts):
                    table[p, :, width] += np.bincount(which[:, p], minlength=entries)
        cells = np.flatnonzero(np.repeat(table[..., width] > 0, width + 1))
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(table.ravel()[cells])], names=["cell", "total"])

    found = rows.select("v", "far").mapInArrow(add, "cell long, total long").groupBy("cell").agg(F.sum("total").alias("total"))
    return {r.cell: r.total for r in found.collect()}  # a row a cell: their number is a parameter


def fit(vectors: DataFrame, cut, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """Codebooks of ``vectors(vec_id, embedding, label)`` and the rows that count, stored by ``cut`` with ``v`` and pivot distances ``far``."""
    if entries > 256:
        raise ValueError("a code has two hexadecimal digits a part: at most 256 entries")
    source = vectors.select("vec_id", "label", F.col("embedding").alias("e")).where(usable(F.col("e"), scale))
    kept = source.where((F.size("e") > 0) & (F.size("e") % parts == 0)).select("vec_id", "label", whole(F.col("e"), scale).alias("v"))
    first = _first(kept, parts, entries)
    schema = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, label {kept.schema['label'].dataType.simpleString()}, v array<int>, far array<float>"
    if first is None:
        return vectors.sparkSession.createDataFrame([], schema), None
    books = Codebooks(first)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _slices(batch):
                far = books.to_pivots(_matrix(some.column(2), some.num_rows).astype(np.int64)).astype(np.float32)
                lists = pa.ListArray.from_arrays(np.arange(0, far.size + 1, far[0].size, dtype=np.int32), far.ravel())
                yield pa.RecordBatch.from_arrays([*some.columns, lists], names=["vec_id", "label", "v", "far"])

    rows = cut(kept.where(F.size("v") == first.shape[0] * first.shape[2]).mapInArrow(measure, schema))
    for _ in range(rounds):
        books = books.moved(_sums(rows, books))
    return rows, books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``vec_id, label, code, error`` of rows from ``fit``."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _slices(batch):
                which, error = books.assign(_matrix(some.column(2), some.num_rows).astype(np.int64), _matrix(some.column(3), some.num_rows))
                codes = [row.tobytes().hex() for row in which.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(codes, pa.string()), pa.array(error.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    kinds = {name: rows.schema[name].dataType.simpleString() for name in ("vec_id", "label")}
    return rows.mapInArrow(write, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress(vectors: DataFrame, **options) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every row that counts."""
    with storage.Scratch(vectors.sparkSession, "codes") as scratch:
        rows, books = fit(vectors, scratch.cut, **options)
        if books is None:
            return rows.select("vec_id", *(F.lit(None).cast(k).alias(n) for n, k in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))))
        coded = storage.cut(encode(rows, books), "codes")
    by_label = storage.cut(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")), "label-errors")
    by_label = storage.small(by_label.withColumnRenamed("label", "own"), F.coalesce(F.octet_length(F.col("own").cast("string")), F.lit(0)))
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("own")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
