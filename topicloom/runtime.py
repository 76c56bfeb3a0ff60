"""Session services: shared scratch space, lineage cuts, checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` wins. Where it is unset a local master gets its
    own folder; a cluster without one is an error, since executors could not
    see each other's files.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="topicloom-")
    sc.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, for tables one run writes and reads."""
    run = spark.sparkContext.applicationId
    return os.path.join(checkpoint_root(spark), "topicloom", run, f"{name}-{uuid.uuid4().hex}")


_watchers: list[list[str]] = []

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile takes its shuffle files along when it ends.

    Else they stay until the driver happens to collect its garbage, and pile up
    over the steps of a job.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it from there.

    As lasting as a checkpoint, but computed once, and later reads see only
    the columns they need. The shuffle files of the writing go with it.
    """
    path = scratch(df.sparkSession, "cut")
    with _shuffles_deleted(df.sparkSession):
        df.write.parquet(path)
    for watcher in _watchers:
        watcher.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


@contextmanager
def watched_cuts() -> Iterator[list[str]]:
    """The paths of the tables that ``cut`` writes meanwhile."""
    paths: list[str] = []
    _watchers.append(paths)
    try:
        yield paths
    finally:
        _watchers.remove(paths)


def delete_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of the shared folder, wherever that is."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder of the shared file system; none if there is no such folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []


def discard(cut_table: DataFrame) -> None:
    """Delete a table that ``cut`` returned, once all that reads it is written itself."""
    delete_paths(cut_table.sparkSession, [cut_table._cut_path])


def _width(field: T.StructField):
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(field.dataType, T.ArrayType):
        return F.greatest(F.size(c), F.lit(0)) * 16 + 16
    return F.lit(16)


def measure(df: DataFrame) -> tuple[int, int]:
    """Rows of ``df`` and their size in memory, from the real string lengths."""
    row = sum((_width(f) for f in df.schema.fields), F.lit(32))
    got = df.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row.cast("long")), F.lit(0)).alias("b")
    ).first()
    return got["n"], got["b"]


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """``df`` with a broadcast hint if its measured size allows one.

    The caller is told which way it went and needs another plan for ``False``.
    """
    fits = measure(df)[1] <= limit
    return (F.broadcast(df) if fits else df), fits


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if it is read in too few pieces to use them.

    For work that is heavy per row on a small input, such as one file with one
    row group. A scan with enough splits is left alone, so a large table is not
    shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or 2 * df.rdd.getNumPartitions() > cores:
        return df
    return df.repartition(cores)
