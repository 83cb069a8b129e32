"""Checkpoints in the folder that all executors share, and what may be broadcast."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder: the one that spark.checkpoint.dir names. Where it is unset a session of one process gets a folder that goes at its end; a cluster must name one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if context.master.split("[")[0] != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="framequarry-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of whatever store its path names."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_made: list[list[str]] = []


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the checkpoints that cut() made within; what needs them must be written by then."""
    _made.append([])
    try:
        yield
    finally:
        for folder in _made.pop():
            remove(spark, folder)


#: Bytes of an Arrow batch while a checkpoint is computed, since a batch of texts becomes several times as large in Python.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and held in the shared checkpoint folder, so that lost executors cost no recomputation. The session's settings are as before when it returns."""
    shared_dir(df.sparkSession)
    conf, (name, value) = df.sparkSession.conf, BATCH
    before = conf.get(name)
    conf.set(name, value)
    try:
        held = df.checkpoint()
    finally:
        conf.set(name, before)
    if _made:
        file = held._jdf.queryExecution().logical().rdd().getCheckpointFile()
        _made[-1] += [file.get()] if file.isDefined() else []
    return held


def small_side(df: DataFrame, most: int = 32 << 20) -> DataFrame:
    """df marked for broadcast if its measured bytes are at most ``most``; otherwise as it is, for a shuffled join.

    A row of a broadcast table counts 32 bytes and 8 a number, the lengths of strings, and of arrays 8 bytes for each number in them.
    """
    def leaves(kind: T.DataType) -> int:
        return sum(leaves(f.dataType) for f in kind) if isinstance(kind, T.StructType) else 1

    size = F.lit(32 + 8 * len(df.columns))
    for f in df.schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            size = size + F.coalesce(F.size(f.name), F.lit(0)) * (8 * leaves(f.dataType.elementType) + 8)
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most else df
