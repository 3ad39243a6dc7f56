"""Tables in the folder that the driver and every executor share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_MADE: list[list[str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a one-machine session may go without that setting; it gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="edgeloom-")
    return f"file://{_LOCAL[context.applicationId]}"


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared root, deleted when the application ends."""
    path = f"{shared_root(spark)}/edgeloom-{label}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    for made in _MADE:
        made.append(path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder under the shared root."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer used; else they wait until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def dropped_at_end(spark: SparkSession) -> Iterator[None]:
    """What is made under the shared root inside this block goes when the block ends: its result must be stored elsewhere."""
    made: list[str] = []
    _MADE.append(made)
    try:
        yield
    finally:
        _MADE.pop()
        for path in made:
            drop(spark, path)


def cut(frame: DataFrame, label: str) -> DataFrame:
    """Write ``frame`` as Parquet into the shared folder and read it back.

    This ends the lineage: a lost executor costs at most the tasks since the last cut.
    """
    spark = frame.sparkSession
    path = new_folder(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


@contextmanager
def bucketed(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """``store(frame, label, buckets, *by)`` writes a table in buckets by ``by`` and reads it so: joins and groups on those keys don't move it.

    One task writes a bucket, so there are as many files as buckets. The tables go when the block ends.
    """
    made: list[tuple[str, str]] = []

    def store(frame: DataFrame, label: str, buckets: int, *by: str) -> DataFrame:
        name, path = f"edgeloom_{label}_{uuid.uuid4().hex}", new_folder(spark, label)
        made.append((name, path))
        frame.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by).option("path", path).saveAsTable(name)
        return spark.table(name)

    try:
        yield store
    finally:
        for name, path in made:
            spark.sql(f"drop table if exists {name}")
            drop(spark, path)
