"""Tables and files in the folder that the driver and every executor share."""

from __future__ import annotations

import ctypes
import os
import threading
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.shared import cut, drop, new_folder, shared_root

__all__ = ["Scratch", "cut", "drop", "frugal", "new_folder", "open_folder", "publish", "shared_root", "small"]

#: What a broadcast table may have, by the sum over its rows.
BROADCAST_BYTES = 16 << 20
#: Seconds without work after which a worker forgets what it only keeps for speed.
IDLE_SECONDS = 5.0
_IDLE: dict[str, threading.Timer] = {}


def small(frame: DataFrame, size: Column | None = None) -> DataFrame:
    """Marked for broadcast if its rows have BROADCAST_BYTES at most, else for a sorted join, whatever Spark takes its size
    to be; ``size`` is what a row has besides 32 bytes."""
    total = frame.agg(F.sum(F.lit(32).cast("long") + (F.lit(0) if size is None else size)).alias("n")).first().n or 0
    return F.broadcast(frame) if total <= BROADCAST_BYTES else frame.hint("merge")


class Scratch:
    """Tables that only serve to make a result; leaving the ``with`` block deletes them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.folder, self.n = spark, new_folder(spark, label), 0
        self.paths: dict[int, str] = {}
        self.tables: list[DataFrame] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(self.folder)

    def cut(self, frame: DataFrame, *done: DataFrame) -> DataFrame:
        """Write ``frame`` and read it back: its lineage ends there. Of ``done``, tables that nothing later reads, the files go."""
        self.n += 1
        path = f"{self.folder}/{self.n:03d}"
        frame.write.parquet(path)
        for table in done:
            self.drop(self.paths.pop(id(table)))
        table = self.spark.read.schema(frame.schema).parquet(path)
        self.paths[id(table)] = path
        self.tables.append(table)  # so that no other table gets its id
        return table

    def drop_before(self, keep: int) -> None:
        """Delete the tables before the last ``keep``."""
        for n in range(1, self.n - keep + 1):
            self.drop(f"{self.folder}/{n:03d}")

    def drop(self, path: str) -> None:
        drop(self.spark, path)


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """An Arrow file system and the path in it, for code inside tasks."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri)}")


def publish(uri: str, name: str, attempt: int, write) -> None:
    """Let ``write(stream)`` fill a file that appears under its final name only when complete.

    A task that runs again replaces the file by one with the same bytes.
    """
    system, folder = open_folder(uri)
    system.create_dir(folder, recursive=True)
    draft, final = f"{folder}/.{name}.{attempt}", f"{folder}/{name}"
    with system.open_output_stream(draft) as stream:
        write(stream)
    try:
        system.move(draft, final)
    except OSError:
        system.delete_file(final)
        system.move(draft, final)


def release() -> None:
    """Give memory that this process has freed back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def frugal(step: Callable[[Iterator], Iterator], forget: Callable[[], None] | None = None) -> Callable[[Iterator], Iterator]:
    """``step`` for ``mapInArrow``, whose worker gives its memory back after each partition.

    Spark keeps workers for the next stages, which share the executor's memory with them. ``forget`` empties
    caches once the worker has had no partition of such a step for IDLE_SECONDS.
    """
    def run(batches: Iterator) -> Iterator:
        if "timer" in _idle():
            _idle().pop("timer").cancel()
        yield from step(batches)
        release()
        if forget:
            timer = threading.Timer(IDLE_SECONDS, lambda: (forget(), release()))
            timer.daemon = True
            timer.start()
            _idle()["timer"] = timer

    return run


def _idle() -> dict[str, threading.Timer]:
    """This process's timer; a function, so that a pickled step finds the worker's own."""
    return _IDLE
