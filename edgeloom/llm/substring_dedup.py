"""Removal of repeated passages by bucket-pointer refinement.

A byte is removed if some ``length``-byte string over it also starts anywhere else. Windows of that length
are put into buckets that are refined step by step, as suffixes are in bucket-pointer refinement. A bucket's
identifier stands for bytes, so any task can name the bucket at a later offset; what a global sort would
bring together, a shuffle by identifiers does. Each step keeps only what still shares its bucket:

1. Initial buckets: q-grams, q being a quarter of the length. Each window is spoken for by the leftmost smallest
   q-gram bucket in it, so equal windows are in equal buckets at equal distances; about one position in q is
   kept. Neighbouring windows with one such position are a run. Runs whose bucket nobody shares are done.
2. The bucket of each position is refined by the one at the later offset q, and these identifiers again, at offset
   2q: they then stand for whole windows. Inside a q-gram's bucket, runs are split by the identifiers of their
   first and last window. Runs that still agree repeat wholly.
3. Where runs of a bucket differ, one run of each kind is split into blocks of BLOCK windows. A block's bucket are
   the bytes that its windows share: the identifier of 2q bytes, refined by that of the 2q bytes at a later offset.
4. In a block's bucket, blocks that agree in all bytes left and right of those, one shape, repeat wholly. Where shapes differ,
   one block of each shape is split into windows by the few bytes beside those; what agrees is equal.

``levels`` reuses a shorter length's result: a window repeats only if all shorter ones in it do, so the next level
looks at stretches of those only.

Every table is keyed by bucket, so a passage in a third of all documents is a third of some rows; these are
aggregated before they are shuffled, and met by joins that AQE splits; none is a broadcast, as lists of places are many
times their files. No pairs are made. Two different windows are
taken for equal only if two 64-bit identifiers, of the q-gram and the window or of the shared bytes and those
beside them, agree at once. Copies of a whole text count as one text with a number.

Defined results: a null text is empty; texts under ``length`` bytes lose nothing; repeated rows are copies of each
other and lose everything (from ``length`` bytes on); an empty table gives no rows; the input's other columns, of
any name, travel in the struct ``doc``; a text of any length is looked at in segments of SEGMENT bytes, which only
makes more runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm import storage
from edgeloom.llm.windows import pair, q_buckets, refined, runs, word_bounds, word_codes

LENGTH = 400
#: A passage has over so many words, or LENGTH bytes.
PASSAGE_WORDS = 50
#: Repeated strings of so many bytes are searched for passages; those whose words are too short for that, by words.
PASSAGE = 4 * PASSAGE_WORDS
BLOCK = 16
#: Windows that are looked at together.
SEGMENT = 1 << 20

#: Texts of so many bytes together are looked at in one go.
CHUNK = 1 << 18

_RUNS = pa.schema([("digest", pa.binary()), ("in_words", pa.bool_()), ("bucket", pa.int64()), ("ctx", pa.int64()), ("pf", pa.int32()), ("w", pa.int32()), ("d", pa.int32())])
_BLOCKS = pa.schema([("digest", pa.binary()), ("key", pa.int64()), ("at", pa.int32()), ("l0", pa.int32()), ("l1", pa.int32()), ("left", pa.binary()), ("right", pa.binary())])


def _runs_of(pieces: list[np.ndarray], length: int) -> tuple[np.ndarray, ...]:
    """Of pieces of bytes or word codes that have a window: a run's piece, bucket, refined bucket, first window, windows, distance to the smallest q-gram."""
    q = -(-length // 4)
    size = np.array([len(piece) for piece in pieces])
    begin = np.cumsum(size) - size
    buckets = q_buckets(np.concatenate(pieces), q)
    first, at = runs(buckets, length - q + 1, begin)
    whole = refined(refined(buckets, q), length - 2 * q)
    piece = np.searchsorted(begin, first, "right") - 1
    end = np.minimum(np.append(first[1:], len(whole)), (begin + size - length + 1)[piece])
    own = first < end  # other windows are of two pieces
    first, at, piece, end = first[own], at[own], piece[own], end[own]
    n = end - first
    ctx = pair(pair(whole[first], whole[end - 1]), n.astype(np.uint64))
    return piece, buckets[at].view(np.int64), ctx.view(np.int64), first - begin[piece], n, at - first


def stretches(pf: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal ranges that runs ``pf, w`` cover together, touching ones joined."""
    if not len(pf):
        return pf, pf
    order = np.argsort(pf, kind="stable")
    begin, end = pf[order], np.maximum.accumulate((pf + w)[order])
    new = np.append(True, begin[1:] > end[:-1])
    return begin[new], end[np.append(new[1:], True)]


def _numbers(spans: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """``pf`` and ``w`` of a list of runs."""
    inside = spans.values
    return np.asarray(inside.field("pf"), np.int64), np.asarray(inside.field("w"), np.int64)


def _short(begins: np.ndarray, ends: np.ndarray, words: int, below: int) -> np.ndarray:
    """Whether the ``words`` words from each on would have fewer than ``below`` bytes with one blank between any two."""
    total = np.append(0, np.cumsum(ends - begins))
    return total[words:] - total[:-words] + words - 1 < below


def _with_short(texts: list[np.ndarray], words: int, below: int) -> list[int]:
    """The places of those ``texts`` in which some ``words`` words are short."""
    blank = np.frombuffer(b" ", np.uint8)
    bounds = word_bounds(np.concatenate([x for text in texts for x in (text, blank)]))
    if len(bounds[0]) < words:
        return []
    text = np.searchsorted(np.cumsum([len(text) + 1 for text in texts]), bounds[0], "right")
    return np.unique(text[: 1 - words][_short(*bounds, words, below) & (text[: 1 - words] == text[words - 1 :])]).tolist()


def _find_runs(texts: DataFrame, length: int, known: int = 0, words: int = 0) -> DataFrame:
    """Runs of the windows of ``texts(digest, text)``; with ``spans`` of repeated windows of ``known`` bytes, of those made of them.

    With ``words``, also of windows of so many words that have fewer than ``length`` bytes.
    """
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # of texts that have a window
        least = min(length, 2 * words - 1) if words else length
        for batch in batches:
            held: list[tuple[bytes, np.ndarray]] = []
            pieces: list[tuple[bytes, int, np.ndarray]] = []
            size, waiting = 0, 0
            for i, digest in enumerate(batch.column(0).to_pylist()):
                data = np.frombuffer(batch.column(1)[i].as_buffer(), np.uint8)
                if len(data) < least or digest in seen:
                    continue
                seen.add(digest)
                if known:
                    begins, ends = stretches(*_numbers(batch.column(2)[i]))
                    slices = zip(begins.tolist(), (ends - 1 + known).tolist(), strict=True)
                else:
                    slices = [(0, len(data))]
                for start, piece in cut(data, slices, length):
                    pieces.append((digest, start, piece))
                    size += len(piece)
                    if size > CHUNK:
                        yield rows(pieces, length, False)
                        pieces, size = [], 0
                if words:
                    held.append((digest, data))
                    waiting += len(data)
                    if waiting > CHUNK:
                        yield from short(held)
                        held, waiting = [], 0
            if pieces:
                yield rows(pieces, length, False)
            if held:
                yield from short(held)

    def cut(data: np.ndarray, slices: Iterator[tuple[int, int]], n: int) -> Iterator[tuple[int, np.ndarray]]:
        for a, b in slices:
            for start in range(a, b - n + 1, SEGMENT):
                yield start, data[start : min(b, start + SEGMENT + n - 1)]

    def short(held: list[tuple[bytes, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        pieces: list[tuple[bytes, int, np.ndarray]] = []
        for i in _with_short([data for _, data in held], words, length):
            digest, data = held[i]
            bounds = word_bounds(data)
            edges = np.flatnonzero(np.diff(np.concatenate(([0], _short(*bounds, words, length), [0]))))
            slices = zip(edges[::2].tolist(), (edges[1::2] - 1 + words).tolist(), strict=True)
            pieces += [(digest, start, piece) for start, piece in cut(word_codes(data, *bounds), slices, words)]
        if pieces:
            yield rows(pieces, words, True)

    def rows(pieces: list[tuple[bytes, int, np.ndarray]], n: int, in_words: bool) -> pa.RecordBatch:
        digests, starts, data = zip(*pieces, strict=True)
        piece, bucket, ctx, pf, *rest = _runs_of(data, n)
        columns = [bucket, ctx, pf + np.array(starts)[piece], *rest]
        own = pa.array(digests, pa.binary()).take(pa.array(piece)), pa.array(np.full(len(piece), in_words))
        return pa.RecordBatch.from_arrays([*own, *(pa.array(c, f.type, safe=False) for c, f in zip(columns, list(_RUNS)[2:], strict=True))], schema=_RUNS)

    return texts.mapInArrow(storage.frugal(find), "digest binary, in_words boolean, bucket long, ctx long, pf int, w int, d int")


def _slices(data: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``n`` bytes of ``data`` from each ``begin`` on, one after another, and their numbers."""
    return data[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())], n


def _binary(slices: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """A value of each of these slices."""
    data, n = (np.concatenate(x) for x in zip(*slices, strict=True))
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.append(0, np.cumsum(n)).astype(np.int32)), pa.py_buffer(data)])


def _blocks(texts: DataFrame, length: int, words: bool) -> DataFrame:
    """Blocks of the runs in ``needs``: the bucket of the bytes (or words) that the windows share, and the bytes (or codes) beside them."""
    core, q, width = length - BLOCK + 1, -(-length // 4), 8 if words else 1

    def blocks(data: np.ndarray, pf: np.ndarray, w: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of all runs: bucket, where the shared bytes begin, and how far left of that windows begin, at least and at most."""
        ids = refined(q_buckets(data, q), q)
        low = d - w + 1
        first = low // BLOCK
        n = d // BLOCK - first + 1
        run = np.repeat(np.arange(len(pf)), n)
        j = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        at = (pf + d)[run] - BLOCK * j
        key = pair(ids[at], ids[at + core - 2 * q])
        return key.view(np.int64), at, np.maximum(0, low[run] - BLOCK * j), np.minimum(BLOCK - 1, d[run] - BLOCK * j)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for i, digest in enumerate(batch.column(0).to_pylist()):
                text, needs = np.frombuffer(batch.column(1)[i].as_buffer(), np.uint8), batch.column(2)[i].values
                if words:
                    text = word_codes(text, *word_bounds(text))
                pf, w, d = (np.asarray(needs.field(c), np.int64) for c in ("pf", "w", "d"))
                for segment in np.unique(pf // SEGMENT).tolist():
                    own, start = pf // SEGMENT == segment, segment * SEGMENT
                    data = text[start : start + SEGMENT + 2 * length]
                    key, at, l0, l1 = blocks(data, pf[own] - start, w[own], d[own])
                    data = data.view(np.uint8)
                    left = _slices(data, width * (at - l1), width * l1)
                    right = _slices(data, width * (at + core), width * (BLOCK - 1 - l0))
                    rows.append((digest, key, start + at, l0, l1, left, right))
                    held += len(key)
                if held > 20_000:
                    yield table(rows)
                    rows, held = [], 0
            if rows:
                yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        digests, *numbers, left, right = zip(*rows, strict=True)
        own = pa.array(digests, pa.binary()).take(pa.array(np.repeat(np.arange(len(rows)), [len(key) for key in numbers[0]])))
        columns = [pa.array(np.concatenate(c), f.type, safe=False) for c, f in zip(numbers, list(_BLOCKS)[1:5], strict=True)]
        return pa.RecordBatch.from_arrays([own, *columns, _binary(left), _binary(right)], schema=_BLOCKS)

    return texts.mapInArrow(storage.frugal(split), "digest binary, key long, at int, l0 int, l1 int, left binary, right binary")


def _grouped(found: DataFrame, stored: DataFrame, cut) -> DataFrame:
    """``digest, pf, w, d, agreed, needed`` of the runs in buckets of two places or more: whether all windows of a run repeat
    because a whole run does, and whether it stands for its kind where a bucket has several.

    ``found`` are all runs; ``stored``, the table that they are read from, is dropped.
    """
    place = F.xxhash64("digest", "pf")  # what several tasks found in copies of a text is one place
    two = F.min(place).alias("lo"), F.max(place).alias("hi")
    shared = cut(found.groupBy("bucket").agg(*two).where("lo < hi").select("bucket"))
    found = cut(found.join(shared.hint("merge"), "bucket"), stored, shared)
    kinds = cut(found.groupBy("bucket", "ctx").agg(*two))
    differing = kinds.groupBy("bucket").agg((F.count("*") > 1).alias("differing"))
    kinds_ = kinds.join(differing.hint("merge"), "bucket").where("lo < hi or differing")
    agreed, needed = F.expr("lo < hi"), F.col("differing") & (place == F.col("lo"))
    rows = found.join(kinds_.hint("merge"), ["bucket", "ctx"]).select("digest", "pf", "w", "d", agreed.alias("agreed"), needed.alias("needed"))
    return cut(rows.where("agreed or needed"), found, kinds)


def _spans(grouped: DataFrame, texts: DataFrame, length: int, cut, words: bool = False) -> DataFrame:
    """``digest, spans``: the repeated windows, as stretches (first, number), of texts that have some.

    ``grouped``: runs by ``_grouped``, which are dropped; ``texts`` has at least their texts, once each. ``words``: windows
    are of words, not bytes.
    """
    width = 8 if words else 1
    # at most a text's windows
    needs = cut(grouped.where("needed").groupBy("digest").agg(F.collect_set(F.struct("pf", "w", "d")).alias("needs")))
    blocks = _blocks(texts.join(needs.hint("merge"), "digest").select("digest", "text", "needs"), length, words)
    shape = F.xxhash64("l0", "l1", "left", "right").alias("shape")
    blocks = cut(blocks.select("*", shape, F.monotonically_increasing_id().alias("id")), needs)
    # a text is there once, so each block is one place; blocks of one shape repeat wholly, and one of them is compared with other shapes
    kinds = cut(blocks.groupBy("key", "shape").agg(F.min("id").alias("one"), F.count("*").alias("n")))
    differing = kinds.groupBy("key").agg((F.count("*") > 1).alias("differing"))
    kinds_ = kinds.join(differing.hint("merge"), "key").where("n > 1 or differing")
    blocks = cut(blocks.join(kinds_.hint("merge"), ["key", "shape"]).drop("shape"), blocks, kinds)
    whole = blocks.where("n > 1").select("digest", (F.col("at") - F.col("l1")).alias("pf"), (F.col("l1") - F.col("l0") + 1).alias("w"))
    # a window with l bytes left of the shared ones has BLOCK - 1 - l right of them
    beside = F.xxhash64(F.expr(f"substring(left, length(left) - {width} * l + 1, {width} * l)"), F.expr(f"substring(right, 1, {width} * ({BLOCK - 1} - l))"))
    windows = blocks.where("differing and id = one").withColumn("l", F.explode(F.sequence("l0", "l1")))
    windows = cut(windows.select("key", beside.alias("beside"), "id", F.col("l").cast("byte").alias("l"), (F.col("n") == 1).alias("alone")))
    twice = windows.groupBy("key", "beside").agg(F.count("*").alias("n")).where("n > 1").select("key", "beside")
    single = windows.where("alone").join(twice.hint("merge"), ["key", "beside"]).groupBy("id").agg(F.expr("bit_or(shiftleft(1, l))").alias("ls"))
    single = cut(single, windows)  # a bit for each l
    one = F.explode(F.expr(f"filter(sequence(0, {BLOCK - 1}), l -> getbit(ls, l) = 1)")).alias("l")
    single = blocks.where("n = 1").join(single.hint("merge"), "id").select("digest", "at", one)
    spans = grouped.where("agreed").select("digest", "pf", "w").unionByName(whole)
    spans = spans.unionByName(single.select("digest", (F.col("at") - F.col("l")).alias("pf"), F.lit(1).alias("w")))
    number = F.expr("shiftleft(cast(pf as long), 32) + w")
    return cut(_joined(spans.groupBy("digest").agg(F.collect_set(number).alias("spans"))), grouped, blocks)


def _joined(spans: DataFrame) -> DataFrame:
    """``spans`` of ``pf << 32 | w`` as stretches."""
    inside = pa.struct([("pf", pa.int32()), ("w", pa.int32())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.asarray(x.values, np.int64) for x in batch.column(1)]
            found = [stretches(x >> 32, x & 0xFFFFFFFF) for x in found]
            if found:
                begins, ends = (np.concatenate(x) for x in zip(*found, strict=True))
                offsets = pa.array(np.append(0, np.cumsum([len(x) for x, _ in found])), pa.int32())
                values = pa.StructArray.from_arrays([pa.array(begins, pa.int32()), pa.array(ends - begins, pa.int32())], fields=list(inside))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, values)], names=["digest", "spans"])

    return spans.mapInArrow(storage.frugal(join), "digest binary, spans array<struct<pf: int, w: int>>")


def repeated_spans(texts: DataFrame, levels: tuple[int, ...] = (LENGTH,), words: int = 0) -> DataFrame:
    """``digest, copies, spans0, spans1, ...``, a list of stretches of repeated windows a level, for each text of
    ``texts(digest, text)`` that has copies or such windows. Levels are lengths, in ascending order.

    With ``words``, ``in_words`` has stretches of repeated windows of so many words that have fewer bytes than the first level.
    """
    with storage.Scratch(texts.sparkSession, "repeats") as scratch:
        cut = scratch.cut
        least = min(levels[0], 2 * words - 1) if words else levels[0]
        long = texts.where(F.octet_length("text") >= least)
        rows = long.groupBy("digest").agg(F.count("*").alias("copies")).where("copies > 1")
        found = cut(_find_runs(long, levels[0], words=words))
        by_words = cut(found.where("in_words")) if words else None
        grouped, short = _grouped(found.where("not in_words"), found, cut), _grouped(by_words, by_words, cut) if words else None
        own = grouped.select("digest")
        own = (own.unionByName(short.select("digest")) if words else own).distinct()
        # a task's copies of a text are one before the shuffle; stored, as later levels ask for fewer
        kept = cut(long.groupBy("digest").agg(F.first("text").alias("text")).join(own.hint("merge"), "digest"))
        known = 0
        for i, length in enumerate(levels):
            if known:
                found = cut(_find_runs(kept.join(spans.hint("merge"), "digest").select("digest", "text", "spans"), length, known))
                grouped = _grouped(found, found, cut)
            spans, known = _spans(grouped, kept, length, cut), length
            rows = rows.join(spans.withColumnRenamed("spans", f"spans{i}").hint("merge"), "digest", "full")
        if words:
            rows = rows.join(_spans(short, kept, words, cut, True).withColumnRenamed("spans", "in_words").hint("merge"), "digest", "full")
        return storage.cut(rows, "spans")


def merged(spans: pa.ListScalar, copies: int | None, size: int, length: int) -> list[tuple[int, int]]:
    """Maximal repeated byte ranges."""
    if size < length:
        return []
    if copies:
        return [(0, size)]
    if not spans.is_valid:
        return []
    pf, w = _numbers(spans)
    begins, ends = stretches(pf, w - 1 + length)
    return list(zip(begins.tolist(), ends.tolist(), strict=True))


def merged_words(data: bytes, spans: pa.ListScalar, copies: int | None, words: int) -> list[tuple[int, int]]:
    """Byte ranges of the repeated windows of ``words`` words, from a first to a last word."""
    if not copies and not spans.is_valid:
        return []
    first, last = word_bounds(np.frombuffer(data, np.uint8))
    if copies:
        return [(int(first[0]), int(last[-1]))] if len(first) >= words else []
    pf, w = _numbers(spans)
    begins, ends = stretches(pf, w - 1 + words)
    return list(zip(first[begins].tolist(), last[ends - 1].tolist(), strict=True))


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges that ``spans`` cover together, touching ones joined."""
    found: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if found and a <= found[-1][1]:
            found[-1] = (found[-1][0], max(b, found[-1][1]))
        else:
            found.append((a, b))
    return found


def is_passage(data: bytes, begin: int, end: int) -> bool:
    """Whether a span has LENGTH bytes or over PASSAGE_WORDS whole words; words are parted by ASCII white space."""
    n = len(data[begin:end].split())
    for at in (begin, end):  # a word that the span cuts doesn't count
        n -= 0 < at < len(data) and not data[at - 1 : at].isspace() and not data[at : at + 1].isspace()
    return end - begin >= LENGTH or n > PASSAGE_WORDS


def remove_repeats(docs: DataFrame, length: int = LENGTH, whole_characters: bool = False, passage: int | None = None, passages_only: bool = False) -> DataFrame:
    """``doc`` (all input columns but the text), ``kept`` (bytes), ``n_bytes, n_removed, n_spans`` for every row.

    ``whole_characters`` keeps the rest of a character that a span cuts, so ``kept`` is valid UTF-8. ``passages_only``
    removes only maximal runs that ``is_passage`` accepts. ``passage``, a shorter length, adds ``n_passage``: the bytes
    of such runs of strings of that length that also start elsewhere; they stay. Both take in runs of over PASSAGE_WORDS
    words that also start elsewhere and have too few bytes for the length; white space between words is not compared there.
    """
    levels = (passage, length) if passage else (length,)
    if any(n % 4 or n <= 4 * BLOCK for n in levels) or sorted(levels) != list(levels):
        raise ValueError("lengths must be ascending multiples of 4, over four times the block")
    words = PASSAGE_WORDS + 1 if (passage or passages_only) and levels[0] > 2 * PASSAGE_WORDS + 1 else 0
    text = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(text)).alias("digest")
    spans = repeated_spans(docs.select(digest, text.alias("text")), levels, words)
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    doc = docs.select(others.alias("doc"), digest, text.alias("body"))
    rows = doc.join(spans.hint("merge"), "digest", "left").select("doc", "body", "copies", *(f"spans{i}" for i in range(len(levels))), *(["in_words"] if words else []))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, counts = [], []
            bodies, copies, *own = (batch.column(i) for i in range(1, batch.num_columns))
            # a batch's rows without copies and spans are many; only the others are looked at one by one
            idle = [c is None and not any(s.is_valid for s in x) for c, *x in zip(copies.to_pylist(), *own, strict=True)]
            for i, body in enumerate(bodies):
                data = body.as_buffer().to_pybytes()
                if idle[i]:
                    kept.append(data)
                    counts.append((len(data), 0, 0, 0))
                    continue
                found = [merged(x[i], copies[i].as_py(), len(data), size) for x, size in zip(own, levels, strict=False)]
                by_words = merged_words(data, own[-1][i], copies[i].as_py(), words) if words else []
                cut = found[-1]
                if passage or passages_only:
                    found[0] = united([*(span for span in found[0] if is_passage(data, *span)), *by_words])
                if passages_only:
                    cut = found[0] if not passage else united([*(span for span in cut if is_passage(data, *span)), *by_words])
                if whole_characters:
                    cut = [(_after(data, a), _before(data, b)) for a, b in cut]
                parts, last = [], 0
                for a, b in cut:
                    parts.append(data[last:a])
                    last = b
                parts.append(data[last:])
                kept.append(b"".join(parts))
                counts.append((len(data), sum(b - a for a, b in cut), len(cut), sum(b - a for a, b in found[0])))
            n = list(zip(*counts, strict=True)) or [()] * 4
            names = ["n_bytes", "n_removed", "n_spans", "n_passage"][: 3 + bool(passage)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), *(pa.array(c, pa.int64()) for c in n[: len(names)])], names=["doc", "kept", *names])

    more = ", n_passage long" if passage else ""
    return rows.mapInArrow(storage.frugal(apply), f"doc {rows.schema['doc'].dataType.simpleString()}, kept binary, n_bytes long, n_removed long, n_spans long{more}")


def _after(data: bytes, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def _before(data: bytes, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at
