"""Reading raw lessons and snapshots of trees, and writing results to new folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coursewright.schemas import LESSON
from coursewright.sources.manifests import manifests


def read_raw(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """path, raw of all files below a folder; many small files share a partition as Spark packs them."""
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def read_wanted(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """path, raw of the wanted files (name relative to the folder); a file that isn't there has null raw and an error."""
    found = read_raw(spark, path, "*").withColumn("name", relative(F.col("path"), path))
    return wanted.join(found, "name", "left").withColumn("error", F.when(F.col("path").isNull(), F.concat(F.lit("no such file: "), "name")))


def relative(file: Column, root: str) -> Column:
    tail = root.rstrip("/").split("://")[-1].rsplit("/", 1)[-1]
    return F.regexp_replace(file, rf"\A.*?/\Q{tail}\E/", "")


def set_of(path: Column) -> Column:
    """The first three components of a relative path."""
    return F.array_join(F.slice(F.split(path, "/"), 1, 3), "/")


def file_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_lesson(path: Column) -> Column:
    return path.contains("/lessons/") & path.endswith(".json")


def is_set_manifest(path: Column) -> Column:
    return (F.size(F.split(path, "/")) == 4) & path.rlike(r"/manifest\.ya?ml\z")


def typed(raw: DataFrame) -> DataFrame:
    """With ``lesson``, typed; what is not JSON is null."""
    return raw.withColumn("lesson", F.from_json("raw", LESSON))


def snapshot(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lessons (set, filename, lesson) and set manifests (set, raw) of a tree (name, raw)."""
    lessons = typed(files.filter(is_lesson(F.col("name")))).select(set_of(F.col("name")).alias("set"), file_of(F.col("name")).alias("filename"), "lesson")
    manifests = files.filter(is_set_manifest(F.col("name"))).select(set_of(F.col("name")).alias("set"), "raw")
    return lessons, manifests


def write_texts(rows: DataFrame, folder: str, text: str = "raw") -> None:
    """path and text of the rows, in a new folder: the files that were read are never written over."""
    rows.select("path", F.col(text).alias("text")).write.mode("errorifexists").parquet(folder)


def inventory_of(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """elements, lessons (set, filename) and retired (set, stable_id) of a tree (name, raw), as operators.identity takes them."""
    from coursewright.operators.identity import inventory

    lessons, sets = snapshot(files)
    read = manifests(sets.select(F.col("set").alias("path"), "raw"))
    ids = F.expr("try_variant_get(try_parse_json(raw), '$.metadata.retired_ids', 'array<variant>')")
    texts = F.transform(F.filter(ids, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.variant_get(v, "$", "string"))
    retired = read.select(F.col("path").alias("set"), F.explode(texts).alias("stable_id")).filter("stable_id <> ''")
    return inventory(lessons), lessons.select("set", "filename"), retired


def listed_elements(files: DataFrame, root: str = "manifest.yaml") -> tuple[DataFrame, DataFrame]:
    """Sets of the root manifest (set, its path) and their elements (set, lesson, has_id), as identity.coverage takes them.

    A lesson that a set lists and that isn't there has one element without an id.
    """
    sets = manifests(files.filter(F.col("name") == root).select(F.col("name").alias("path"), "raw")).select(F.explode("manifest.sets").alias("s"))
    sets = sets.filter("coalesce(s.path, '') <> ''").select(F.col("s.path").alias("set"))
    own = manifests(files.filter(F.col("name").endswith("/manifest.yaml")).select(F.regexp_replace("name", r"/manifest\.yaml\z", "").alias("path"), "raw"))
    names = own.select(F.col("path").alias("set"), F.explode(F.expr("try_variant_get(try_parse_json(raw), '$.metadata.lessons', 'array<string>')")).alias("lesson"))
    listed = sets.join(names, "set").withColumn("name", F.concat_ws("/", "set", F.lit("lessons"), "lesson"))
    found = listed.join(typed(files).select("name", "raw", "lesson").withColumnRenamed("lesson", "content"), "name", "left")
    ids = F.concat(
        F.transform(F.coalesce("content.cards", F.array()), lambda c: F.coalesce(c["stable_id"], F.lit("")) != ""),
        F.transform(F.filter(F.coalesce("content.steps", F.array()), lambda s: s["exercise"].isNotNull()), lambda s: F.coalesce(s["exercise"]["stable_id"], F.lit("")) != ""),
    )
    has = F.when(F.col("raw").isNull(), F.array(F.lit(False))).otherwise(ids)
    return sets, found.select("set", "lesson", F.explode_outer(has).alias("has_id"))
