"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are presences of lower-cased character n-grams (``ORDERS`` long, white space as one blank) in hashed
buckets. A bucket's value is the logarithm of its share of toxic texts over that of clean ones, from counts over every
labelled row, and a text's values are divided by the square root of their length as a vector: a sum would grow with the
text, a unit vector would thin out one insult in a long text. On them a ridge logistic regression is fitted.

Nothing is judged on what it has learnt from. Texts are dealt to ``FOLDS`` by hash, so copies stay together; a
text's values for fitting come from the other folds' counts, and each fold's scores from the weights of a fit on the
others. On these held-out scores the cut is chosen that costs least (a share of false alarms weighs ``FALSE_ALARM`` times
a share of misses), and it becomes the score THRESHOLD. The model is the mean of the folds' weights on values from
all counts; buckets that no chosen text has weigh nothing.

The fit sees at most ``FIT_ROWS`` different texts of each class, those of the smallest hashes; a task fits a fold.
Everything else covers all rows.

A score depends on the text alone. Defined results: null and empty texts have no features and get the
intercept's score; without rows of both classes every score is the share of toxic rows, or 0 where there
are no labels; where a class has texts in one fold only, the fit is on all and so is its cut; repeated rows score alike;
labels that are null don't count, and of several labels of a document the toxic one does; a text of any length is
scored whole; other columns, of any name, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm import storage

ORDERS = (4, 5, 6)
BUCKET_BITS = 20
FIT_ROWS = 1_000
FOLDS = 3
#: Pseudo-presences a class on average; classes share them by size, so a bucket without rows has ratio 0.
SMOOTHING = 20.0
THRESHOLD = 0.7
FALSE_ALARM = 3.0
RIDGE = 1e-3
STEPS = 30

_MIX = 0x9E3779B97F4A7C15


def buckets(text: str) -> Iterator[np.ndarray]:
    """The bucket of each n-gram of ``text``, one array an order."""
    data = np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    data = np.where((data >= 65) & (data <= 90), data + np.uint64(32), np.where((data >= 9) & (data <= 13), np.uint64(32), data))
    gram, width, mix = data, 1, np.uint64(_MIX)
    for order in ORDERS:
        while width < order and len(gram) > 1:
            gram = gram[:-1] * mix + data[width:]
            width += 1
        if width == order:
            mixed = (gram + np.uint64(order)) * mix
            mixed ^= mixed >> np.uint64(29)
            yield ((mixed * mix) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def present(text: str) -> np.ndarray:
    """The distinct buckets of a text, in order."""
    parts = list(buckets(text))
    if not parts:
        return np.zeros(0, np.int32)
    found = np.sort(np.concatenate(parts))
    return found[np.append(True, found[1:] != found[:-1])]


def _texts(column: pa.Array) -> Iterator[str]:
    for value in column:
        yield value.as_buffer().to_pybytes().decode("utf-8", "replace")


def packed(found: np.ndarray) -> bytes:
    """Sorted buckets as compressed gaps, a third of their size."""
    return zlib.compress(np.diff(found, prepend=0).astype("<i4").tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<i4"))


def length(values: np.ndarray) -> float:
    """What a text's values are divided by."""
    return max(float((values.astype(float) ** 2).sum()) ** 0.25, 1e-9)


def _counts(rows: DataFrame) -> DataFrame:
    """``bucket``, and of each class and fold in how many texts of ``rows(text, toxic, fold)`` it is present: ``c0_0`` to ``c1_2``."""
    names = [f"c{c}_{k}" for c in (0, 1) for k in range(FOLDS)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2 * FOLDS, 1 << BUCKET_BITS), np.int32)
        for batch in batches:
            for text, toxic, fold in zip(_texts(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                table[toxic * FOLDS + fold][present(text)] += 1
        some = np.flatnonzero(table.any(axis=0))
        for at in range(0, len(some), 50_000):
            part = some[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(own[part].astype(np.int64)) for own in table)], names=["bucket", *names])

    parts = rows.select("text", "toxic", "fold").mapInArrow(count, "bucket long, " + ", ".join(f"{n} long" for n in names))
    return parts.groupBy("bucket").agg(*(F.sum(n).cast("float").alias(n) for n in names))


def counted(counts: DataFrame) -> np.ndarray:
    """Counts (class, fold, bucket)."""
    table = counts.toArrow()  # 2 ** BUCKET_BITS rows at most
    found = np.zeros((2 * FOLDS, 1 << BUCKET_BITS), np.float32)
    for i, name in enumerate(table.column_names[1:]):
        found[i, table["bucket"].to_numpy()] = table[name].to_numpy()
    return found.reshape(2, FOLDS, -1)


def log_ratios(clean_counts: np.ndarray, toxic_counts: np.ndarray, clean: int, toxic: int) -> np.ndarray:
    """Of each bucket the logarithm of its smoothed share of toxic texts over that of clean ones."""
    ratios = np.zeros(len(clean_counts))
    for found, n, sign in ((toxic_counts, toxic, 1), (clean_counts, clean, -1)):
        prior = 2 * SMOOTHING * n / (toxic + clean)
        ratios += sign * np.log((found.astype(float) + prior) / (n + prior))
    return ratios.astype(np.float32)


class Model:
    """What every bucket adds, its square value (4 MB each), and the line from sums to scores."""

    def __init__(self, weights: np.ndarray, ratios: np.ndarray, slope: float = 1.0, intercept: float = 0.0):
        self.adds, self.squares = (weights * ratios).astype(np.float32), (ratios * ratios).astype(np.float32)
        self.slope, self.intercept = slope, intercept

    def score(self, features: np.ndarray) -> float:
        divisor = max(float(self.squares[features].sum(dtype=float)) ** 0.25, 1e-9)
        z = self.slope * float(self.adds[features].sum(dtype=float)) / divisor + self.intercept
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def _balance(y: np.ndarray) -> np.ndarray:
    """Weights under which both classes weigh the same."""
    return np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by accelerated gradient steps: a weight a bucket, and the intercept."""
    size, lengths = 1 << BUCKET_BITS, np.array([len(r) for r in rows])
    column, value = np.concatenate(rows), np.concatenate(values).astype(np.float32)
    at, full = np.repeat(np.arange(len(rows), dtype=np.int32), lengths), lengths > 0
    firsts = (np.cumsum(lengths) - lengths)[full]
    by_bucket = np.argsort(column, kind="stable")
    sorted_at, sorted_value, sorted_column = at[by_bucket], value[by_bucket], column[by_bucket]
    starts = np.flatnonzero(np.diff(sorted_column, prepend=-1))
    met = sorted_column[starts]
    balance = _balance(y).astype(np.float32)

    def sums(w: np.ndarray) -> np.ndarray:
        found = np.zeros(len(rows), np.float32)
        if len(firsts):
            found[full] = np.add.reduceat(w[column] * value, firsts)
        return found

    def back(e: np.ndarray) -> np.ndarray:
        found = np.zeros(size, np.float32)
        if len(starts):
            found[met] = np.add.reduceat(e[sorted_at] * sorted_value, starts)
        return found

    steep = np.ones(size, np.float32)
    for _ in range(8):  # the largest curvature, which bounds the step
        steep = back(sums(steep) * balance)
        most = float(np.linalg.norm(steep))
        steep /= max(most, 1e-30)
    rate = 1 / (0.3 * most + 0.25 + RIDGE)
    w = ahead = np.zeros(size, np.float32)
    b = ahead_b = 0.0
    t = 1.0
    for _ in range(STEPS):
        error = ((1 / (1 + np.exp(-np.clip(sums(ahead) + ahead_b, -35, 35))) - y) * balance).astype(np.float32)
        new, new_b = ahead - np.float32(rate) * (back(error) + np.float32(RIDGE) * ahead), ahead_b - rate * float(error.sum())
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + np.float32((t - 1) / after) * (new - w), new_b + (t - 1) / after * (new_b - b)
        w, b, t = new, new_b, after
    return w, b


def cut_and_slope(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Where to cut held-out sums, half-way between neighbours, and how steep scores rise there."""
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order] == 1) / max(1, (y == 1).sum())
    false = np.cumsum(y[order] == 0) / max(1, (y == 0).sum())
    gain = np.append(0.0, hits - FALSE_ALARM * false)
    k = int(gain.argmax())
    edges = np.concatenate([[z.max() + 1], z[order], [z.min() - 1]])
    cut, spread, slope = (edges[k] + edges[k + 1]) / 2, z - z.mean(), 1.0
    level, balance = 0.0, _balance(y)
    for _ in range(30):  # a logistic regression on one number, by Newton's steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(slope * spread + level, -35, 35)))
        gradient = np.array([(balance * (p - y) * spread).sum() + 1e-3 * slope, (balance * (p - y)).sum()])
        curve = balance * p * (1 - p)
        matrix = np.array([[(curve * spread * spread).sum() + 1e-3, (curve * spread).sum()], [(curve * spread).sum(), curve.sum() + 1e-6]])
        slope, level = np.array([slope, level]) - np.clip(np.linalg.solve(matrix, gradient), -2, 2)
    return float(cut), float(max(slope, 0.5))


def _hashed(labelled: DataFrame) -> DataFrame:
    rows = labelled.where("toxic in (0, 1)").select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    return rows.withColumn("h", F.xxhash64("text")).withColumn("fold", F.pmod("h", F.lit(FOLDS)).cast("int"))


def _sampled(rows: DataFrame, hashes: DataFrame, fit_rows: int) -> DataFrame:
    """``text, toxic, fold`` of at most ``fit_rows`` different texts of each class: those of the smallest hashes, so always the same."""
    chosen = F.lit(False)
    for toxic in (0, 1):
        last = hashes.where(F.col("toxic") == toxic).orderBy("h").limit(fit_rows).agg(F.max("h").alias("h")).first().h
        if last is not None:
            chosen = chosen | ((F.col("toxic") == toxic) & (F.col("h") <= last))
    return rows.where(chosen).groupBy("toxic", "fold", "h").agg(F.first("text").alias("text")).select("text", "toxic", "fold")


def _fitted(spark, sample: list[tuple[int, int, bytes]], ratios: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Mean weights of the folds' fits, the cut and the slope."""
    y, folds = np.array([s[0] for s in sample]), np.array([s[1] for s in sample])
    able = [k for k in range(FOLDS) if len(set(y[folds != k])) == 2 and (folds == k).any()]
    shared = spark.sparkContext.broadcast((sample, ratios))  # 2 * FIT_ROWS texts' features, and 4 MB a fold

    def fit_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, ratios = shared.value
        for fold in (k for batch in batches for k in batch.column(0).to_pylist()):
            rows = [unpacked(s[2]) for s in sample]
            values = [ratios[s[1]][r] for s, r in zip(sample, rows)]
            values = [v / length(v) for v in values]
            learn = np.flatnonzero(folds != fold)
            w, b = descend([rows[i] for i in learn], [values[i] for i in learn], y[learn])
            held = np.flatnonzero((folds == fold) | (fold < 0))
            z = np.array([float(w[rows[i]] @ values[i]) + b for i in held])
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([b]), pa.array([held.tolist()], pa.list_(pa.int64())), pa.array([z.tolist()], pa.list_(pa.float64()))], names=["w", "b", "held", "z"])

    tasks = spark.createDataFrame([(k,) for k in able or [-1]], "fold int").repartition(len(able) or 1)
    found = tasks.mapInArrow(fit_fold, "w binary, b double, held array<long>, z array<double>").collect()  # a row a fold
    weights = sum(np.frombuffer(r.w, np.float32) for r in sorted(found, key=lambda r: r.held)) / len(found)
    b = sum(sorted(r.b for r in found)) / len(found)
    at, z = np.concatenate([r.held for r in found]).astype(int), np.concatenate([r.z for r in found])
    cut, slope = cut_and_slope(z[np.argsort(at)], y[np.sort(at)])
    return weights, cut - b, slope


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Train on ``labelled(text, toxic)``, toxic being 0 or 1."""
    spark, rows, nothing = labelled.sparkSession, _hashed(labelled), np.zeros(1 << BUCKET_BITS, np.float32)
    with storage.Scratch(spark, "toxicity") as scratch:
        hashes = scratch.cut(rows.groupBy("toxic", "h", "fold").count())
        totals = np.zeros((2, FOLDS), np.int64)
        for r in hashes.groupBy("toxic", "fold").agg(F.sum("count").alias("n")).collect():
            totals[r.toxic, r.fold] = r.n
        clean, toxic = totals.sum(axis=1).tolist()
        if not toxic or not clean:
            share = toxic / max(1, toxic + clean)
            return Model(nothing, nothing, intercept=float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
        counts = counted(_counts(rows))

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [packed(present(t)) for t in _texts(batch.column(0))]
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found, pa.binary())], names=["toxic", "fold", "features"])

        sample = _sampled(rows, hashes, fit_rows).mapInArrow(features, "toxic int, fold int, features binary").collect()  # fit_rows a class
    sample = sorted(((r.toxic, r.fold, bytes(r.features)) for r in sample), key=lambda x: (zlib.crc32(x[2]), x))
    every = counts.sum(axis=1)
    able = [len({s[0] for s in sample if s[1] != k}) == 2 for k in range(FOLDS)]
    others = np.stack([log_ratios(*(every - counts[:, k]), *(totals.sum(axis=1) - totals[:, k])) if all(able) else log_ratios(*every, clean, toxic) for k in range(FOLDS)])
    weights, cut, slope = _fitted(spark, sample, others)
    return Model(weights, log_ratios(*every, clean, toxic), slope, float(np.log(THRESHOLD / (1 - THRESHOLD))) - slope * cut)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for every row of ``docs(doc_id, text)``; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 8 MB, whatever the data

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = [model.score(present(t)) for t in _texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(judge, f"doc_id {doc_id}, score double")


def join_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, toxic`` of labelled documents; labels are broadcast only if ``storage.small`` finds them so."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "text").join(storage.small(known, F.octet_length(F.col("doc_id").cast("string"))), "doc_id")
