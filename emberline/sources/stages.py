"""Tables between pipeline stages, kept where every executor can read them, and their removal."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders of stage tables by open scope, innermost last.
_open: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where it is unset."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="emberline-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def track(path: str) -> str:
    """The path, to be removed with the stage tables of the innermost scope."""
    if _open:
        _open[-1].append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a stage's table as Parquet and read it back: later stages start from a plain scan."""
    spark = df.sparkSession
    path = track(f"{shared_folder(spark)}/stage-{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _store(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, whatever kind of store the path is in."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _checkpoints(spark: SparkSession) -> set[str]:
    """The folders of this session's checkpoints."""
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not at.isDefined():
        return set()
    store, folder = _store(spark, at.get())
    return {str(x.getPath().toString()) for x in store.listStatus(folder)} if store.exists(folder) else set()


@contextmanager
def stages(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, the stage tables and checkpoints that were made within, also after a failure.

    Results must be written or collected before the end; frames that still read these tables fail after it.  Scopes may be
    nested.  Two scopes at one time in one session would take each other's tables for their own.
    """
    before = _checkpoints(spark)
    made: list[str] = []
    _open.append(made)
    try:
        yield
    finally:
        _open.remove(made)
        for path in [*made, *sorted(_checkpoints(spark) - before)]:
            store, folder = _store(spark, path)
            store.delete(folder, True)
