"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (local tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    set_ = sc._jsc.sc().getCheckpointDir()
    if set_.isDefined():
        return set_.get()
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="coursewright-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: a cut in the lineage that survives lost executors.

    The table goes when the driver's JVM ends, or with ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder(spark, path, lambda fs, at: fs.deleteOnExit(at))
    read = spark.read.schema(df.schema).parquet(path)
    read.stored_at = path
    return read


@contextmanager
def shuffles_deleted(spark: SparkSession):
    """What is written in here deletes the files of its shuffles at its end: nothing reads them again."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def discard(stored_df: DataFrame) -> None:
    """Delete a table of ``stored`` that nothing will read again."""
    folder(stored_df.sparkSession, stored_df.stored_at, lambda fs, at: fs.delete(at, True))


def folder(spark: SparkSession, path: str, act) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    act(at.getFileSystem(spark._jsc.hadoopConfiguration()), at)
