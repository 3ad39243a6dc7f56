"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has a bit set where over half of its shingles' hashes have it. To find every pair of
fingerprints within ``RADIUS`` bits, each bit position gets a random vector m(i) of RADIUS + 1 bits, and
table v (every non-zero vector of that length) looks at the positions whose m(i) is not orthogonal to v. The
at most RADIUS differing positions don't span the whole space, so some v is orthogonal to all of them: that
table looks at none of them, and the pair agrees in it. No link is lost, for sure rather than probably.

Equal fingerprints are one node. A table's bucket of up to ``SMALL`` distinct fingerprints is compared in
one task and gives at most a spanning forest. A larger one never meets in a task: each fingerprint that is
in some such bucket goes, as one row, to all of its variants within RADIUS / 2 bits. Two fingerprints within
RADIUS share a variant, and all sharing one are within RADIUS, so they link to their smallest. That is
1 + 64 + 2016 rows a fingerprint, whatever the buckets' sizes.

Spark sizes what an explode or Python made by the rows before it, 31 or 2,081 times too low here, so tables that grow with
the input are joined by shuffles and sorts only.

Four bits are a shingle cosine of about 0.98. ``keep_one`` also finds copies that differ more, down to a Jaccard
similarity of 0.8 of their sets of five-word shingles: beside the fingerprint of the whole text there are PARTS of
samples of that set. A set is sorted by hash, as a ring, and part i is the PICK shingles from the hash
i / PARTS of the way round on, so texts of every length have parts of one size. Two sets of similarity J share a part with probability
J ** PICK; at 0.8 none of 32 is shared once in some 2,000 pairs. Fingerprints are compared first with the smallest
and the largest that they share a part with, two rows a part whatever the bucket's size. In buckets that these links leave in
several components, all pairs across components are candidates that share one of their rarest shingles, without which
they cannot be alike; so pairs of one component are not made. Linked are those whose first texts' sets are as
similar as asked for, which is counted, not estimated.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; repeated rows
share their fingerprint and component; a null ``doc_id`` is kept and never is a component's name unless all
its members are null; an empty table gives no rows; a text of any length is hashed whole, in steps of 65,536 shingles;
other columns, of any name, are ignored, and ``keep_one`` keeps them; a text without words has no parts.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm import storage
from edgeloom.llm.components import components
from edgeloom.llm.tokens import in_bytes
from edgeloom.llm.windows import q_buckets, word_bounds, word_codes

WORDS = 4
RADIUS = 4
SEED = 42
SMALL = 2_048
#: Of sets of shingles: words of a shingle, the least Jaccard similarity of a link, samples and shingles in a sample.
SET_WORDS = 5
LEAST = 0.8
PARTS = 32
PICK = 7
_COUNT = np.array([bin(i).count("1") for i in range(65_536)], np.uint8)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64 bits: those set in over half of the shingles' XXH64."""
    import xxhash

    parts = (text or "").encode().lower().split()  # of bytes: A-Z only, and ASCII white space
    if not parts:
        return 0
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(parts) - words + 1)
    starts = (ends - sizes)[:n].tolist()
    stops = ends[min(words, len(parts)) - 1 :].tolist()
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        some = slice(at, min(n, at + 65_536))
        hashes = np.array([digest(view[a:b], SEED) for a, b in zip(starts[some], stops[some])], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def shingle_set(text: str | None, words: int = SET_WORDS) -> np.ndarray:
    """The hashes of a text's different shingles, ascending; fewer words are one shingle, no words are none."""
    data = np.frombuffer((text or "").encode().lower(), np.uint8)
    begins, ends = word_bounds(data)
    if not len(begins):
        return np.zeros(0, np.uint64)
    return np.unique(q_buckets(word_codes(data, begins, ends), min(words, len(begins))))


def part_prints(hashes: np.ndarray) -> np.ndarray:
    """A fingerprint of each part of an ascending set of hashes: bits that are set in over half of its shingles."""
    if not len(hashes):
        return hashes
    first = np.searchsorted(hashes, np.arange(PARTS, dtype=np.uint64) * np.uint64((1 << 64) // PARTS))
    n = min(PICK, len(hashes))
    picked = hashes[(first[:, None] + np.arange(n)) % len(hashes)]
    bits = np.unpackbits(picked.view(np.uint8).reshape(PARTS, n, 8), axis=2, bitorder="little").sum(axis=1, dtype=np.uint8)
    return np.packbits(2 * bits > n, axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (as a signed long) for every row; no shuffle."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = np.array([fingerprint(t) for _, some in in_bytes(texts) for t in some], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(compute, f"doc_id {doc_id}, fp long")


def _with_parts(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, parts`` for every row; no shuffle."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in in_bytes(batch.column(1).to_pylist()):
                whole = np.array([fingerprint(t) for t in texts], np.uint64)
                parts = [part_prints(shingle_set(t)) for t in texts]
                lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, parts)]).astype(np.int32), np.concatenate(parts).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(whole.view(np.int64)), lists], names=["doc_id", "fp", "parts"])

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(storage.frugal(compute), f"doc_id {doc_id}, fp long, parts array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    """``fp, hashes``: the sets of shingles of ``texts(fp, text)``."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in in_bytes(batch.column(1).to_pylist()):
                sets = [shingle_set(t) for t in some]
                lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)]).astype(np.int32), np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), lists], names=["fp", "hashes"])

    return texts.select("fp", "text").mapInArrow(storage.frugal(compute), "fp long, hashes array<long>")


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs(u, v)`` whose ``sets(fp, hashes)`` have a similarity of ``least`` or more."""
    for end, own in (("u", "a"), ("v", "b")):
        pairs = pairs.join(sets.select(F.col("fp").alias(end), F.col("hashes").alias(own)).hint("merge"), end)
    both, all_ = F.size(F.array_intersect("a", "b")), F.size("a") + F.size("b")
    # both / (all - both) >= least
    return pairs.where(both * (1 + least) >= least * all_).select("u", "v")


def _rarest(sets: DataFrame, named: DataFrame, least: float) -> DataFrame:
    """``token, fp, component, n``: of each set of ``named(fp, component)`` the rarest of its n shingles, so many that sets with
    a similarity of ``least`` or more have one in common; those that no other set has are left out.

    A set shares ``least`` of its shingles at least, so not all of the others and one more can be missing in the other set, and
    both sets' shingles are in one order.
    """
    rows = sets.join(named.hint("merge"), "fp").select("fp", "component", F.size("hashes").alias("n"), F.explode("hashes").alias("token"))
    counts = rows.groupBy("token").agg(F.count("*").alias("sets"))
    ordered = rows.join(counts.hint("merge"), "token").groupBy("fp", "component", "n").agg(F.array_sort(F.collect_list(F.struct("sets", "token"))).alias("tokens"))
    most = (F.col("n") - F.ceil(F.col("n") * least - 1e-6) + 1).cast("int")
    first = ordered.select("fp", "component", "n", F.explode(F.slice("tokens", F.lit(1), most)).alias("t")).where("t.sets > 1")
    return first.select("t.token", "fp", "component", "n")


def set_links(prints: DataFrame, texts, scratch: storage.Scratch, near: DataFrame, least: float = LEAST) -> DataFrame:
    """``u, v``: links between fingerprints of ``prints(fp, parts)`` whose texts' sets of shingles have a similarity of ``least`` or more.

    Together with the links ``near`` they have the components of all such pairs that share a part. ``texts(fps)`` gives
    ``fp, text``, the first text of each of these fingerprints.
    """
    rows = prints.select("fp", F.posexplode("parts").alias("i", "part")).select("fp", F.xxhash64("i", "part").alias("bucket"))
    ends = rows.groupBy("bucket").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi")
    members = scratch.cut(rows.join(ends.hint("merge"), "bucket").distinct())
    sets = scratch.cut(_sets(texts(members.select("fp").distinct())).dropDuplicates(["fp"]))
    met = members.select("fp", F.explode(F.array("lo", "hi")).alias("other"))
    met = met.select(F.least("fp", "other").alias("u"), F.greatest("fp", "other").alias("v"))
    met = met.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) > RADIUS).distinct()  # nearer ones are linked anyway
    found = scratch.cut(_alike(met, sets, least))
    # buckets whose members are not all linked by now: every pair of different components that can be alike is compared
    labels = components(near.unionByName(found)).select(F.col("node").alias("fp"), "component")
    named = members.select("bucket", "fp").join(labels.hint("merge"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = scratch.cut(named)
    parted = named.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("bucket")
    rest = scratch.cut(named.join(parted.hint("merge"), "bucket", "left_semi").select("fp", "component").distinct())
    rare = scratch.cut(_rarest(sets, rest, least))
    other = rare.select("token", *(F.col(c).alias(f"_{c}") for c in ("fp", "component", "n")))
    pairs = rare.join(other.hint("merge"), "token").where("fp < _fp and component <> _component")
    pairs = pairs.where(F.least("n", "_n") >= F.greatest("n", "_n") * least - 1e-6)
    return found.unionByName(_alike(pairs.select(F.col("fp").alias("u"), F.col("_fp").alias("v")).distinct(), sets, least))


def masks(radius: int = RADIUS, seed: int = SEED) -> list[int]:
    """The positions that each table looks at, one mask a table, 2 ** (radius + 1) - 1 of them."""
    pick = random.Random(seed)
    vectors = [pick.randrange(1 << (radius + 1)) for _ in range(64)]
    return [sum(1 << i for i, m in enumerate(vectors) if bin(m & v).count("1") % 2) for v in range(1, 1 << (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bits(x: np.ndarray) -> np.ndarray:
    """Set bits of each uint64."""
    return _COUNT[np.ascontiguousarray(x).view(np.uint16)].reshape(*x.shape, 4).sum(axis=-1)


def _forest(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links to the first member of each component among at most SMALL fingerprints."""
    near = np.empty((len(values), len(values)), bool)
    for i in range(0, len(values), 256):
        near[i : i + 256] = _bits(values[i : i + 256, None] ^ values[None, :]) <= radius
    label = np.arange(len(values))
    while True:
        least = np.where(near, label[None, :], len(values)).min(axis=1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    own = label != np.arange(len(values))
    return values[own], values[label[own]]


def links(values: DataFrame, cut, radius: int = RADIUS, small: int = SMALL) -> DataFrame:
    """``u, v``: links between distinct fingerprints ``values(fp)`` with the same components as all pairs within ``radius``.

    ``cut`` stores the buckets, which are read twice.
    """
    if radius % 2:
        raise ValueError("variants need an even radius")
    tables = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks(radius))]
    rows = values.select("fp", F.explode(F.array(*tables)).alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(rows.join(sizes.hint("merge"), "bucket"))
    few = met.where(F.col("n") <= small).groupBy("bucket").agg(F.collect_list("fp").alias("fps"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            flat, sizes = np.asarray(column.flatten()).view(np.uint64), np.asarray(column.value_lengths(), np.int64)
            ends = np.cumsum(sizes)
            pairs = ends[sizes == 2]
            near = _bits(flat[pairs - 2] ^ flat[pairs - 1]) <= radius
            found = [(flat[pairs - 2][near], flat[pairs - 1][near])]
            found += [_forest(flat[end - n : end], radius) for end, n in zip(ends[sizes > 2], sizes[sizes > 2], strict=True)]
            u, v = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    compared = few.select("fps").mapInArrow(compare, "u long, v long")
    return compared.unionByName(_through_variants(met.where(F.col("n") > small).select("fp").distinct(), radius)).distinct()


def _through_variants(crowded: DataFrame, radius: int) -> DataFrame:
    """Links of fingerprints in buckets of any size, by variants that two within ``radius`` share."""
    flips = np.array([sum(1 << i for i in at) for k in range(radius // 2 + 1) for at in combinations(range(64), k)], np.uint64)

    def vary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column(0)).view(np.uint64)
            for at in range(0, len(own), 100):
                some = own[at : at + 100]
                variants = (some[:, None] ^ flips[None, :]).reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, len(flips)).view(np.int64)), pa.array(variants.view(np.int64))], names=["fp", "variant"])

    rows = crowded.mapInArrow(vary, "fp long, variant long")
    least = rows.groupBy("variant").agg(F.min("fp").alias("v"), F.max("fp").alias("most")).where("v < most")
    return rows.join(least.hint("merge"), "variant").where("fp <> v").select(F.col("fp").alias("u"), "v")


def _grouped(classes: DataFrame, linked: DataFrame) -> DataFrame:
    """``fp, first``: for each fingerprint of ``classes(fp, own)`` the smallest ``own`` in its component by ``linked(u, v)``."""
    found = components(linked)
    rows = classes.join(found.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    # with the hash, the join has an exchange of its own here, and AQE splits a large component
    least = rows.groupBy(F.xxhash64("component").alias("hash"), "component").agg(F.min("own").alias("first")).drop("hash")
    return rows.join(least.hint("merge"), "component").select("fp", "first")


def _classes(prints: DataFrame, scratch: storage.Scratch) -> DataFrame:
    """Each fingerprint with its smallest ``doc_id``."""
    return scratch.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("own")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs(doc_id, text)``."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    with storage.Scratch(docs.sparkSession, "simhash") as scratch:
        prints = scratch.cut(fingerprints(docs))
        classes = _classes(prints, scratch)
        rows = prints.join(_grouped(classes, links(classes.select("fp"), scratch.cut)).hint("merge"), "fp")
        return storage.cut(rows.select("doc_id", hexed.alias("fingerprint"), F.col("first").alias("component_id")), "near-duplicates")


def keep_one(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs``, all columns, one of each group: that of the smallest ``doc_id``.

    Groups are components of fingerprints within RADIUS bits and of texts whose sets of shingles have a similarity of
    ``least`` or more. Only ids, fingerprints, those of parts and the sets of candidates are stored; texts are shuffled
    once, to meet the rows to keep, and those of candidates once more. A null id comes after all others.
    """
    none = F.lit(0).cast(docs.schema["doc_id"].dataType)
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", none).alias("id"), F.xxhash64("text").alias("hash"))
    with storage.Scratch(docs.sparkSession, "simhash") as scratch:
        keyed = docs.select(key.alias("doc_id"), "text")
        prints = scratch.cut(_with_parts(keyed))
        classes = _classes(prints, scratch)

        def texts(fps: DataFrame) -> DataFrame:
            asked = classes.join(fps.hint("merge"), "fp").select("fp", F.col("own").alias("doc_id"))
            return keyed.join(storage.small(asked, F.octet_length(F.col("doc_id.id").cast("string"))), "doc_id").select("fp", "text")

        near = scratch.cut(links(classes.select("fp"), scratch.cut))
        more = scratch.cut(set_links(prints, texts, scratch, near, least))
        firsts = storage.cut(_grouped(classes, near.unionByName(more)).select(F.col("first").alias("kept_key")).distinct(), "kept")
    rows = docs.select(F.struct("*").alias("row"), key.alias("own_key"))
    flat = [F.col(f"own_key.{c}").alias(c) for c in ("none", "id", "hash")]
    kept = firsts.select(*(F.col(f"kept_key.{c}").alias(c) for c in ("none", "id", "hash")))
    kept = storage.small(kept, F.octet_length(F.col("id").cast("string")))
    rows = rows.select("row", *flat).join(kept, ["none", "id", "hash"], "left_semi")
    # rows that repeat id and text are alike; the first of them stays
    place = F.row_number().over(Window.partitionBy("none", "id", "hash").orderBy("none"))
    return rows.withColumn("place", place).where("place = 1").select("row.*")
