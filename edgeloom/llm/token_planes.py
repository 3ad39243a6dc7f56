"""Token-id output in bit-plane files.

A file holds the ids of consecutive documents. They are cut into blocks of ``block_ids`` ids; each block is
transposed into planes (``byte``: plane i holds byte i of every id; ``bit``: plane i holds bit i), and each
plane is compressed with zstandard. All-zero planes take no bytes. Layout, little-endian:

    magic | planes of block 0, of block 1, ... | index (zstandard) | uint64 index offset | magic

The index is JSON: plane kind, block size, ids in the file, per block the offset and the planes' sizes, and
the documents' ids and lengths. So any span of ids is read with one seek per block.

Defined results: a null text is an empty one; a null ``doc_id`` comes first; repeated ids stand next to each
other, ordered by the text's hash; an empty table gives no files; a text of any length is one document, whose ids one
task holds; other columns, of any name, are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm import storage, tokens

MAGIC = b"ELPLANE1"
BLOCK_IDS = 65_536
#: Text bytes that a file's documents have, about; more input makes more files, up to MOST_FILES, then larger ones.
FILE_BYTES, MOST_FILES = 32_000_000, 100_000
WIDTH = {"byte": 4, "bit": 32}


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of uint32 ids, lowest first; an all-zero plane is empty."""
    rows = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        rows = np.unpackbits(rows, axis=1, bitorder="little")
        planes = [np.packbits(rows[:, i]) for i in range(32)]
    else:
        planes = [np.ascontiguousarray(rows[:, i]) for i in range(4)]
    return [p.tobytes() if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """The ids of a block again."""
    rows = np.zeros((n, WIDTH[kind]), np.uint8)
    for i, plane in enumerate(planes):
        if plane:
            raw = np.frombuffer(plane, np.uint8)
            rows[:, i] = np.unpackbits(raw, count=n) if kind == "bit" else raw
    if kind == "bit":
        rows = np.packbits(rows, axis=1, bitorder="little")
    return rows.reshape(-1).view("<u4")


class PlaneWriter:
    """Writes one file; holds one block of ids at a time, and the documents' lengths."""

    def __init__(self, stream, kind: str = "byte", block_ids: int = BLOCK_IDS, level: int = 3):
        self.stream, self.kind, self.block_ids = stream, kind, block_ids
        self.pack = zstandard.ZstdCompressor(level=level)
        self.pending: list[bytes] = []
        self.held = self.total = 0
        self.blocks: list[list[int]] = []
        self.docs: list[tuple[int | None, int]] = []
        self.at = stream.write(MAGIC) and len(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4))
        self.pending.append(ids)
        self.held += len(ids) // 4
        if self.held >= self.block_ids:
            self._flush(self.held - self.held % self.block_ids)

    def _flush(self, n: int) -> None:
        ids = np.frombuffer(b"".join(self.pending), "<u4")
        for start in range(0, n, self.block_ids):
            sizes = []
            for plane in to_planes(ids[start : min(n, start + self.block_ids)], self.kind):
                packed = self.pack.compress(plane) if plane else b""
                self.stream.write(packed)
                sizes.append(len(packed))
            self.blocks.append([self.at, *sizes])
            self.at += sum(sizes)
        self.pending, self.held, self.total = [ids[n:].tobytes()], self.held - n, self.total + n

    def close(self) -> None:
        if self.held:
            self._flush(self.held)
        index = {
            "planes": self.kind, "block_ids": self.block_ids, "ids": self.total, "blocks": self.blocks,
            "doc_ids": [d for d, _ in self.docs], "lengths": [n for _, n in self.docs],
        }
        self.stream.write(self.pack.compress(json.dumps(index).encode()))
        self.stream.write(struct.pack("<Q", self.at) + MAGIC)


class PlaneReader:
    """Reads a file's index at once and its blocks as they are asked for."""

    def __init__(self, source, size: int):
        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        tail = source.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a plane file, or a cut one")
        (at,) = struct.unpack("<Q", tail[:8])
        self.index = json.loads(self.unpack.decompress(source.read_at(size - 16 - at, at)))

    def block(self, i: int) -> np.ndarray:
        x = self.index
        at, *sizes = x["blocks"][i]
        raw, planes, start = self.source.read_at(sum(sizes), at), [], 0
        for n in sizes:
            planes.append(self.unpack.decompress(raw[start : start + n]) if n else b"")
            start += n
        return from_planes(planes, min(x["block_ids"], x["ids"] - i * x["block_ids"]), x["planes"])

    def span(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` of the file; only their blocks are read."""
        size = self.index["block_ids"]
        parts = [self.block(i) for i in range(start // size, -(-end // size))] if end > start else []
        return np.concatenate(parts)[start % size :][: end - start] if parts else np.zeros(0, "<u4")

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        """Each document's id and ids; holds one document and one block."""
        left, block = b"", 0
        for doc_id, n in zip(self.index["doc_ids"], self.index["lengths"], strict=True):
            parts, have = [left], len(left)
            while have < 4 * n:
                parts.append(self.block(block).tobytes())
                have += len(parts[-1])
                block += 1
            joined = b"".join(parts)
            yield doc_id, joined[: 4 * n]
            left = joined[4 * n :]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str = tokens.DEFAULT_TOKENIZER, end_id: int = 0,
                 kind: str = "byte", block_ids: int = BLOCK_IDS, files: int | None = None) -> DataFrame:
    """Write the ids of ``docs.text`` plus ``end_id`` after each document, in ascending ``doc_id`` order.

    Returns the manifest, a row a file: ``file_no, name, n_docs, n_ids``. File numbers follow ``doc_id``.
    The shuffle moves texts, which are smaller than ids; a range's rows never meet in memory.
    """
    if files is None:
        size = docs.select(F.sum(F.octet_length("text")).alias("n")).first().n or 0
        files = max(1, -(-size // max(FILE_BYTES, -(-size // MOST_FILES))))
    order = (F.col("doc_id"), F.xxhash64("text"))
    rows = docs.select("doc_id", "text", order[1].alias("tie"))
    rows = rows.repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        number, end = TaskContext.get().partitionId(), struct.pack("<I", end_id)
        encode, done = tokens.encoder(tokenizer).encode_all, []

        def fill(stream):
            writer = PlaneWriter(stream, kind, block_ids)
            batch = first
            while batch is not None:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for start, some in tokens.in_bytes(texts):
                    for doc_id, one in zip(ids[start:], encode(some), strict=False):
                        writer.add(doc_id, one + end)
                batch = next(batches, None)
            writer.close()
            done.extend((len(writer.docs), writer.total))

        name = f"tokens-{number:06d}.planes"
        storage.publish(folder, name, TaskContext.get().taskAttemptId(), fill)
        yield pa.RecordBatch.from_pydict({"file_no": [number], "name": [name], "n_docs": [done[0]], "n_ids": [done[1]]})

    schema = "file_no long, name string, n_docs long, n_ids long"
    return storage.cut(rows.select("doc_id", "text").mapInArrow(write, schema), "manifest")


def read_tokens(manifest: DataFrame, folder: str, each, schema: str) -> DataFrame:
    """Apply ``each(doc_id, ids as bytes)`` to every document of the files; a task reads one file's blocks in turn.

    ``schema`` names what ``each`` returns; the columns ``doc_id`` and ``start``, the number of ids in all
    documents before, come first.
    """
    sizes = manifest.select("file_no", "name", "n_ids").orderBy("file_no").collect()  # a row a file, MOST_FILES by default
    starts, total = {}, 0
    for x in sizes:
        starts[x.name], total = total, total + x.n_ids
    names = manifest.sparkSession.createDataFrame([(n, s) for n, s in starts.items()], "name string, start long")
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64())])
    fields = [f.strip().split() for f in schema.split(",")]
    for name, kind in fields:
        out = out.append(pa.field(name, {"long": pa.int64(), "binary": pa.binary()}[kind]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, path = storage.open_folder(folder)
                with system.open_input_file(f"{path}/{name}") as source:
                    reader, rows = PlaneReader(source, source.size()), []
                    for doc_id, ids in reader.documents():
                        rows.append((doc_id, start, *each(doc_id, ids)))
                        start += len(ids) // 4
                        if len(rows) == 5_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    spread = names.repartition(max(1, len(sizes)), "name")
    return spread.mapInArrow(read, f"doc_id long, start long, {schema}")


def token_digests(docs: DataFrame) -> DataFrame:
    """Write, read back, and describe each document by its place and a checksum."""
    folder = storage.new_folder(docs.sparkSession, "tokens")
    manifest = write_tokens(docs, folder)
    return read_tokens(manifest, folder, lambda _, ids: (len(ids) // 4, zlib.crc32(ids)), "n_tokens long, ids_crc32 long")
