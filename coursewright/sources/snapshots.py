"""Snapshots stored for comparison: tables in buckets by their keys, so that comparing two of them shuffles nothing.

A snapshot is (elements, lessons, retired) as operators.identity takes it. Elements and retirements are
stored in buckets by (set, stable_id), lessons by set, and every snapshot that is to be compared
has the same number of buckets: the joins and counts of V1 to V6 then run bucket by bucket, straight from the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coursewright.operators.identity import KEY
from coursewright.scratch import folder

BUCKETS = 64
PARTS = {"elements": KEY, "lessons": ["set"], "retired": KEY}
#: Joins on (set, filename) may use the buckets by set: a set's files then meet in one task, as they do in V4 anyway.
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


def write_snapshot(snapshot: tuple[DataFrame, DataFrame, DataFrame], name: str, root: str | None = None, buckets: int = BUCKETS) -> None:
    """Stores the three tables as NAME_elements, NAME_lessons and NAME_retired, below the folder ``root`` or in the warehouse; they must be new.

    Each bucket is one file of a task, sorted by its key.
    """
    for df, (part, keys) in zip(snapshot, PARTS.items(), strict=True):
        writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").mode("errorifexists")
        (writer.option("path", f"{root.rstrip('/')}/{name}_{part}") if root else writer).saveAsTable(f"{name}_{part}")


def open_snapshot(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables of a stored snapshot."""
    spark.conf.set(CO_PARTITION, "false")
    elements, lessons, retired = (spark.table(f"{name}_{part}") for part in PARTS)
    return elements, lessons, retired


def drop_snapshot(spark: SparkSession, name: str, root: str | None = None) -> None:
    """Forgets the tables, and deletes what is below ``root``."""
    for part in PARTS:
        spark.sql(f"DROP TABLE IF EXISTS {name}_{part}")
        if root:
            folder(spark, f"{root.rstrip('/')}/{name}_{part}", lambda fs, at: fs.delete(at, True))
