"""Python data sources: binary adjacency files as edges, and typed values as a file's bytes.

``spark.read.format(CSR)`` gives ``src, dst[, weight]``. A partition is a range of edges, so hubs are split; its task finds the
first edge's vertex by bisection in the offsets and reads no more of them than it needs. Comparisons of the vertex whose
lists the file has, ``src`` or with ``incoming`` ``dst``, are taken over: they become a range of vertices, hence of edges, and
only its bytes are read.

``write.format(BYTES)`` writes rows ``kind, whole, real`` in the order of their partitions. Parts go to a folder of their own;
the commit names that folder in the file ``_current`` and then deletes older ones, so a failed or aborted write leaves
the file that was there whole, and parts of an earlier, larger one don't stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from edgeloom.sources.formats import _TYPES, CHUNK, CURRENT, _Bytes, _open, csr_sizes

CSR, BYTES = "edgeloom_csr", "edgeloom_bytes"
#: Edges of a batch, and offsets that are read at a time.
BATCH = 100_000


def with_binary_sources(spark: SparkSession) -> None:
    """Make both formats known to the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CsrSource)
    spark.dataSource.register(BytesSource)


@dataclass
class Range(InputPartition):
    start: int
    stop: int


class CsrReader(DataSourceReader):
    def __init__(self, uri: str, incoming: bool, weighted: bool, chunk: int):
        self.uri, self.incoming, self.weighted, self.chunk = uri, incoming, weighted, chunk
        self.n, self.m = csr_sizes(uri)
        self.low, self.high = 0, self.n

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        key = "dst" if self.incoming else "src"
        for f in filters:
            if isinstance(f, IsNotNull):
                continue  # nothing in a file is null
            if getattr(f, "attribute", None) != (key,) or not isinstance(getattr(f, "value", None), int):
                yield f
            elif isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value + 1)
            elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, LessThan | LessThanOrEqual):
                self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
            else:
                yield f

    def _offsets(self, data: _Bytes, at: int, n: int) -> np.ndarray:
        return np.frombuffer(data.read(12 + 8 * at, 8 * n), "<u8").astype(np.int64)

    def partitions(self) -> list[Range]:
        if self.low >= self.high:
            return [Range(0, 0)]
        data = _Bytes(self.uri)
        start, stop = (int(self._offsets(data, v, 1)[0]) for v in (self.low, self.high))
        return [Range(a, min(a + self.chunk, stop)) for a in range(start, stop, self.chunk)] or [Range(0, 0)]

    def _vertex(self, data: _Bytes, place: int) -> int:
        """The last vertex whose list starts at or before an edge's place."""
        low, high = self.low, self.high
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self._offsets(data, middle, 1)[0] <= place else (low, middle)
        return low

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.start >= partition.stop:
            return
        data = _Bytes(self.uri)
        at = 12 + 8 * (self.n + 1)
        vertex = self._vertex(data, partition.start)
        for start in range(partition.start, partition.stop, BATCH):
            stop = min(start + BATCH, partition.stop)
            offsets = self._offsets(data, vertex, min(BATCH, self.n + 1 - vertex))
            while offsets[-1] < stop:
                offsets = np.append(offsets, self._offsets(data, vertex + len(offsets), min(BATCH, self.n + 1 - vertex - len(offsets))))
            ids = np.searchsorted(offsets, np.arange(start, stop), side="right") - 1 + vertex
            others = np.frombuffer(data.read(at + 4 * start, 4 * (stop - start)), "<u4").astype(np.int64)
            columns = [others, ids] if self.incoming else [ids, others]
            if self.weighted:
                columns.append(np.frombuffer(data.read(at + 4 * self.m + 8 * start, 8 * (stop - start)), "<f8"))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["src", "dst", "weight"][: len(columns)])
            vertex = int(ids[-1])


class CsrSource(DataSource):
    """Options: ``path``; ``incoming`` and ``weighted``, false unless true; ``chunk``, the edges of a partition."""

    @classmethod
    def name(cls) -> str:
        return CSR

    def schema(self) -> str:
        return "src long, dst long" + (", weight double" if self._is("weighted") else "")

    def _is(self, option: str) -> bool:
        return self.options.get(option, "false").lower() == "true"

    def reader(self, schema: StructType) -> CsrReader:
        return CsrReader(self.options["path"], self._is("incoming"), self._is("weighted"), int(self.options.get("chunk", CHUNK)))


@dataclass
class Part(WriterCommitMessage):
    partition: int
    name: str


class BytesWriter(DataSourceArrowWriter):
    def __init__(self, uri: str, header: bytes):
        self.uri, self.header, self.folder = uri, header, f"parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        task = TaskContext.get()
        name = f"{task.partitionId() + 1:06d}.{task.taskAttemptId()}"
        system, path = _open(self.uri)
        system.create_dir(f"{path}/{self.folder}", recursive=True)
        with system.open_output_stream(f"{path}/{self.folder}/draft-{name}") as stream:
            for batch in iterator:
                kinds = np.asarray(batch.column(0))
                cuts = [0, *(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1).tolist(), len(kinds)]
                for a, b in zip(cuts, cuts[1:]):
                    if b > a:
                        column = batch.column(2 if kinds[a] == "f8" else 1).slice(a, b - a)
                        stream.write(np.asarray(column).astype(_TYPES[kinds[a]]).tobytes())
        return Part(task.partitionId(), name)

    def commit(self, messages: list[Part | None]) -> None:
        """Parts of the attempts that count get their names; then the new folder takes the old one's place."""
        system, path = _open(self.uri)
        own = f"{path}/{self.folder}"
        system.create_dir(own, recursive=True)
        with system.open_output_stream(f"{own}/part-000000") as stream:
            stream.write(self.header)
        for part in messages:
            if part is not None:
                system.move(f"{own}/draft-{part.name}", f"{own}/part-{part.partition + 1:06d}")
        with system.open_output_stream(f"{path}/.{CURRENT}.{self.folder}") as stream:
            stream.write(self.folder.encode())
        system.move(f"{path}/.{CURRENT}.{self.folder}", f"{path}/{CURRENT}")
        for found in system.get_file_info(pafs.FileSelector(path)):
            if found.type == pafs.FileType.Directory and found.base_name.startswith("parts-") and found.base_name != self.folder:
                system.delete_dir(found.path)

    def abort(self, messages: list[Part | None]) -> None:
        system, path = _open(self.uri)
        if system.get_file_info(f"{path}/{self.folder}").type == pafs.FileType.Directory:
            system.delete_dir(f"{path}/{self.folder}")


class BytesSource(DataSource):
    """Options: ``path``; ``header``, the first bytes as hexadecimal digits."""

    @classmethod
    def name(cls) -> str:
        return BYTES

    def schema(self) -> str:
        return "kind string, whole long, real double"

    def writer(self, schema: StructType, overwrite: bool) -> BytesWriter:
        return BytesWriter(self.options["path"], bytes.fromhex(self.options.get("header", "")))
