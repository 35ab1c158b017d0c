"""Lessons that land in a folder, judged as they come: an addition to the batch operators.

The rules of a lesson are row-local, so the stream runs the same plan as a batch. Those of a set need
what landed before: the state of a key (set, stable_id) is its number of places and the first of
them, whatever the number, and it is kept for good, as an identity is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from coursewright.operators.identity import KEY
from coursewright.plans.rules import stable_elements
from coursewright.plans.validate import computed, exploded, validate_lessons
from coursewright.schemas import LESSON
from coursewright.sources.lessons import file_of, set_of


def landed(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.readStream.option("wholetext", "true").option("pathGlobFilter", "*.json").text(folder)
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))


def judge(spark: SparkSession, folder: str, out: str, checkpoint: str, registry: dict | None = None) -> StreamingQuery:
    """Writes the issues of what is there now to a new Parquet folder, each file once, and stops."""
    issues = exploded(validate_lessons(landed(spark, folder), registry), "file")
    return issues.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def repeated_ids(files: DataFrame) -> DataFrame:
    """set, stable_id, n, first (lesson, kind, element) of the ids that a set has more than once; from lessons (name, raw), a stream or not.

    A name is a path whose first three components are the set. Lessons that aren't JSON have no ids.
    """
    lesson = F.when(F.json_object_keys("raw").isNotNull(), F.from_json("raw", LESSON))
    rows = computed(files.select("raw", set_of(F.col("name")).alias("set"), file_of(F.col("name")).alias("file")), lesson=lesson)
    each = rows.select("set", "file", F.explode(stable_elements(F.col("lesson"))).alias("e")).select(
        "set", F.col("e.stable_id").alias("stable_id"), F.struct(F.col("file").alias("lesson"), F.col("e.kind").alias("kind"), F.col("e.element").alias("element")).alias("place")
    )
    return each.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("place").alias("first")).filter("n > 1")


def watch_ids(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes what each batch of a stream of lessons (name, raw) changes in ``repeated_ids``, and stops when all that is there is read.

    A batch has a folder of its own, which a batch that runs again replaces.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch}")

    return repeated_ids(files).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def repeated_so_far(spark: SparkSession, out: str) -> DataFrame:
    """What ``repeated_ids`` gives over all batches that ``watch_ids`` has written."""
    changes = spark.read.parquet(out)
    last = changes.groupBy(*KEY).agg(F.max_by(F.struct("n", "first"), "batch").alias("now"))
    return last.select(*KEY, "now.n", "now.first")
