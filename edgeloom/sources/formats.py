"""Graph file formats: binary adjacency and vectors, adjacency text, vertex orders, degrees, block dumps, results.

All binary values are little-endian. A large file is written as a folder of parts, each by the task that
has its values; the parts, joined in the order of their names, are the file. Reading takes such a folder or
one file, and each task reads its own range of bytes. ``binary`` has the data sources behind both.
"""

from __future__ import annotations

import csv
import io
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.operators.adjacency import all_offsets
from edgeloom.operators.canonical import check_permutation, endpoints
from edgeloom.sources.edges import edge_lines

#: Values that one reading task takes.
CHUNK = 4_000_000
#: In a folder of parts, the file that names the folder of the last complete write.
CURRENT = "_current"
_TYPES = {"u4": "<u4", "u8": "<u8", "f8": "<f8"}


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri)}")


def _write_parts(values: DataFrame, folder: str, parts: int, header: bytes) -> None:
    """Write ``values(section, place, kind, whole, real)`` in the order of section and place behind ``header``."""
    from edgeloom.sources.binary import BYTES, with_binary_sources

    with_binary_sources(values.sparkSession)
    rows = values.repartitionByRange(parts, "section", "place").sortWithinPartitions("section", "place").select("kind", "whole", "real")
    rows.write.format(BYTES).mode("overwrite").option("header", header.hex()).save(folder)


class _Bytes:
    """A file, or a folder of parts, as one range of bytes."""

    def __init__(self, uri: str):
        self.system, path = _open(uri)
        info = self.system.get_file_info(path)
        if info.type == pafs.FileType.Directory:
            if self.system.get_file_info(f"{path}/{CURRENT}").type == pafs.FileType.File:
                with self.system.open_input_file(f"{path}/{CURRENT}") as source:
                    path = f"{path}/{source.read().decode()}"
            found = self.system.get_file_info(pafs.FileSelector(path))
            files = sorted((f.path, f.size) for f in found if f.base_name.startswith("part-"))
        else:
            files = [(path, info.size)] if info.type == pafs.FileType.File else []
        self.files, self.size = files, sum(size for _, size in files)

    def read(self, at: int, n: int) -> bytes:
        out, start = [], 0
        for path, size in self.files:
            low, high = max(at, start), min(at + n, start + size)
            if low < high:
                with self.system.open_input_file(path) as source:
                    out.append(source.read_at(high - low, low - start))
            start += size
        return b"".join(out)


def _read_values(spark: SparkSession, uri: str, at: int, n: int, kind: str) -> DataFrame:
    """``place, value`` of ``n`` values from byte ``at`` on."""
    width = int(kind[1])
    chunks = spark.range(0, -(-n // CHUNK), numPartitions=max(1, -(-n // CHUNK)))
    value = pa.float64() if kind == "f8" else pa.int64()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = _Bytes(uri)
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                first, count = chunk * CHUNK, min(CHUNK, n - chunk * CHUNK)
                values = np.frombuffer(data.read(at + first * width, count * width), _TYPES[kind])
                places = np.arange(first, first + count)
                yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(values.astype(np.float64 if kind == "f8" else np.int64), value)], names=["place", "value"])

    return chunks.mapInArrow(read, f"place long, value {'double' if kind == 'f8' else 'long'}")


def write_vector(values: DataFrame, uri: str, kind: str = "u4", parts: int = 8) -> None:
    """``values(place, value)``: a count of eight bytes and the values."""
    real = kind == "f8"
    rows = values.select(F.lit(0).alias("section"), "place", F.lit(kind).alias("kind"),
                         F.lit(None).cast("long").alias("whole") if real else F.col("value").cast("long").alias("whole"),
                         F.col("value").cast("double").alias("real") if real else F.lit(None).cast("double").alias("real"))
    _write_parts(rows, uri, parts, struct.pack("<Q", values.count()))


def read_vector(spark: SparkSession, uri: str, kind: str = "u4") -> DataFrame:
    """``place, value``; a missing file is an empty vector."""
    data = _Bytes(uri)
    n = struct.unpack("<Q", data.read(0, 8))[0] if data.size >= 8 else 0
    return _read_values(spark, uri, 8, n, kind)


def write_csr(edges: DataFrame, uri: str, incoming: bool = False, parts: int = 8) -> None:
    """n (four bytes), m (eight), n + 1 offsets, m neighbours, and m weights if the edges have them.

    Vertices must be numbered densely from 0; other ids raise.
    """
    key, other = ("dst", "src") if incoming else ("src", "dst")
    ids = endpoints(edges).agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).first()
    n, m = ids.n, edges.count()
    if n and (ids.low != 0 or ids.high != n - 1):
        raise ValueError(f"{n} vertices with ids from {ids.low} to {ids.high} are not numbered densely from 0")
    whole = F.lit(None).cast("double").alias("real")
    starts = all_offsets(edges, incoming).select(F.lit(0).alias("section"), F.col("id").alias("place"), F.lit(0).cast("long").alias("minor"), F.lit("u8").alias("kind"), F.col("start").cast("long").alias("whole"), whole)
    last = edges.sparkSession.range(1).select(F.lit(0).alias("section"), F.lit(n).cast("long").alias("place"), F.lit(0).cast("long").alias("minor"), F.lit("u8").alias("kind"), F.lit(m).cast("long").alias("whole"), whole)
    lists = edges.select(F.lit(1).alias("section"), F.col(key).alias("place"), F.col(other).alias("minor"), F.lit("u4").alias("kind"), F.col(other).cast("long").alias("whole"), whole)
    rows = starts.unionByName(last).unionByName(lists)
    if "weight" in edges.columns:
        rows = rows.unionByName(edges.select(F.lit(2).alias("section"), F.col(key).alias("place"), F.col(other).alias("minor"), F.lit("f8").alias("kind"), F.lit(None).cast("long").alias("whole"), F.col("weight").cast("double").alias("real")))
    rows = rows.select("section", F.struct("place", "minor").alias("place"), "kind", "whole", "real")
    _write_parts(rows, uri, parts, struct.pack("<IQ", n, m))


def csr_sizes(uri: str) -> tuple[int, int]:
    """Vertices and edges, from the first bytes of a binary file."""
    return struct.unpack("<IQ", _Bytes(uri).read(0, 12))


def read_csr(spark: SparkSession, uri: str, incoming: bool = False, weighted: bool = False) -> DataFrame:
    """Edges ``src, dst[, weight]`` of a binary file, by the data source ``binary.CSR``: a task takes a range of edges, so a hub is many tasks'."""
    from edgeloom.sources.binary import CSR, with_binary_sources

    with_binary_sources(spark)
    return spark.read.format(CSR).options(incoming=str(incoming).lower(), weighted=str(weighted).lower()).load(uri)


def adjacency_lines(edges: DataFrame) -> DataFrame:
    """``section, place, minor, value``: the lines of an adjacency text file, to be sorted by the first three."""
    spark, weighted = edges.sparkSession, "weight" in edges.columns
    n, m = endpoints(edges).count(), edges.count()
    head = [("WeightedAdjacencyGraph" if weighted else "AdjacencyGraph",), (str(n),), (str(m),)]
    rows = spark.createDataFrame([(0, i, 0, v[0]) for i, v in enumerate(head)], "section int, place long, minor long, value string")
    starts = all_offsets(edges).select(F.lit(1).alias("section"), F.col("id").alias("place"), F.lit(0).cast("long").alias("minor"), F.col("start").cast("string").alias("value"))
    rows = rows.unionByName(starts).unionByName(edges.select(F.lit(2).alias("section"), F.col("src").alias("place"), F.col("dst").alias("minor"), F.col("dst").cast("string").alias("value")))
    if weighted:
        rows = rows.unionByName(edges.select(F.lit(3).alias("section"), F.col("src").alias("place"), F.col("dst").alias("minor"), F.col("weight").cast("string").alias("value")))
    return rows


def write_adjacency_text(edges: DataFrame, path: str) -> None:
    adjacency_lines(edges).orderBy("section", "place", "minor").select("value").write.text(path)


def read_vertex_order(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """``old_id, new_id`` of a text file: two lines of one number are its head, the sizes, and lines of two its map.

    Raises unless the map is a permutation of as many ids as the head says, and of ``n`` if that is given.
    """
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f"))
    head = [int(r.f[0]) for r in lines.where((F.size("f") == 1) & (F.col("f")[0] != "")).limit(3).collect()]
    fields = lines.where(F.size("f") == 2)
    ids = fields.select(F.col("f")[0].cast("long").alias("old_id"), F.col("f")[1].cast("long").alias("new_id"))
    check_permutation(ids)
    found = ids.count()
    if len(head) != 2 or found not in head or n not in (None, found):
        raise ValueError(f"a map of {found} vertices; its head says {' and '.join(map(str, sorted(head))) or 'nothing'}" + (f", the graph has {n}" if n is not None else ""))
    return ids


def write_vertex_order(ids: DataFrame, path: str, n: int, m: int) -> None:
    head = ids.sparkSession.createDataFrame([(-2, str(n)), (-1, str(m))], "old_id long, value string")
    rows = head.unionByName(ids.select("old_id", F.concat_ws(" ", F.col("old_id").cast("string"), F.col("new_id").cast("string")).alias("value")))
    rows.orderBy("old_id").select("value").write.text(path)


def write_sizes(spark: SparkSession, path: str, n: int, m: int) -> None:
    """Two lines: vertices and edges."""
    spark.createDataFrame([(str(n),), (str(m),)], "value string").coalesce(1).write.text(path)


def read_sizes(spark: SparkSession, path: str) -> tuple[int, int]:
    n, m = (int(r.value) for r in spark.read.text(path).limit(2).collect())
    return n, m


def write_degrees(degrees: DataFrame, path: str, incoming: bool = False) -> None:
    """A degree a line, in the order of vertices."""
    degrees.orderBy("id").select(F.col("in_deg" if incoming else "out_deg").cast("string").alias("value")).write.text(path)


def block_lines(blocks: DataFrame) -> DataFrame:
    """``idx, value``: a block's line ``x y side_len idx nnz`` with a blank at its end."""
    fields = [F.col(c).cast("string") for c in ("x", "y", "side_len", "idx", "nnz")]
    return blocks.select("idx", F.concat(F.concat_ws(" ", *fields), F.lit(" ")).alias("value"))


def write_blocks(blocks: DataFrame, path: str) -> None:
    block_lines(blocks).orderBy("idx").select("value").write.text(path)


def write_block_edges(edges: DataFrame, index: DataFrame, edge_path: str, index_path: str) -> None:
    """The flattened edges, and 0 followed by each block's end."""
    edge_lines(edges.orderBy("place").select("src", "dst")).write.text(edge_path)
    zero = edges.sparkSession.range(1).select(F.lit(-1).cast("long").alias("block"), F.lit(0).cast("long").alias("end"))
    rows = index.select("block", "end").unionByName(zero)
    rows.orderBy("block").select(F.col("end").cast("string").alias("value")).write.text(index_path)


def hilbert_edge_lines(ranked: DataFrame) -> DataFrame:
    """``rank, value``: the line ``src dst rank`` of each edge in its order along the curve."""
    return ranked.select("rank", F.concat_ws(" ", *(F.col(c).cast("string") for c in ("src", "dst", "rank"))).alias("value"))


def write_hilbert_edges(ranked: DataFrame, path: str) -> None:
    """Edges with their ranks along the curve, in that order."""
    hilbert_edge_lines(ranked).orderBy("rank").select("value").write.text(path)


def shown_edges(edges: DataFrame) -> DataFrame:
    """Edges as ``#h (src, dst)``."""
    return edges.select(F.format_string("#%d (%d, %d)", "h", "src", "dst").alias("value"))


def shown_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks as ``#idx (x:, y:) (s:, n:)`` with their numbers."""
    return blocks.select(F.format_string("#%d (x:%d, y:%d) (s:%d, n:%d)", "idx", "x", "y", "side_len", "nnz").alias("value"))


def append_result(uri: str, row: dict[str, object]) -> None:
    """Add an experiment's row to a small results file on the driver, with a head if the file is new."""
    system, path = _open(uri)
    old = b""
    if system.get_file_info(path).type == pafs.FileType.File:
        with system.open_input_file(path) as source:
            old = source.read()
    text = io.StringIO()
    writer = csv.DictWriter(text, list(row), lineterminator="\n")
    if not old:
        writer.writeheader()
    writer.writerow(row)
    with system.open_output_stream(path) as stream:
        stream.write(old + text.getvalue().encode())
