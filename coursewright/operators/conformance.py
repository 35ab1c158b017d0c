"""Corpus conformance: tallies over judged lessons, the first faults of each, and repositories without lessons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Faults told of a lesson, and in all.
PER_LESSON, SHOWN = 4, 60


def tally(rows: DataFrame, kind: str) -> DataFrame:
    """Number of rows of each kind, by name."""
    return rows.groupBy(kind).agg(F.count("*").alias("n")).orderBy(kind)


def first_of_each(rows: DataFrame, owner: list[str], order: list[str], most: int = PER_LESSON) -> DataFrame:
    """The first ``most`` rows of each owner; Spark keeps no more of an owner than that while it sorts."""
    within = Window.partitionBy(*owner).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(within)).filter(F.col("place") <= most)


def summary(repos: DataFrame, judged: DataFrame) -> DataFrame:
    """One row: repos, sets, lessons, parse_errors, invalid, empty_repos, ok; from repos (repo), judged (repo, set, ok_json, valid)."""
    empty = repos.join(judged.select("repo"), "repo", "left_anti").agg(F.count("*").alias("empty_repos"))
    counts = judged.agg(
        F.count_distinct("repo").alias("repos"),
        F.count_distinct("repo", "set").alias("sets"),
        F.count("*").alias("lessons"),
        F.count_if(~F.col("ok_json")).alias("parse_errors"),
        F.count_if(F.col("ok_json") & ~F.col("valid")).alias("invalid"),
    )
    ok = (F.col("lessons") > 0) & (F.col("parse_errors") == 0) & (F.col("invalid") == 0) & (F.col("empty_repos") == 0)
    return counts.crossJoin(empty).withColumn("ok", ok)  # of one row each


def totals(repos: DataFrame, judged: DataFrame) -> DataFrame:
    """level (corpus, repo, set), repo, set, repos, sets, lessons, parse_errors, invalid, empty_repos, ok: a row for the corpus, each repository and each set.

    From repos (repo), which may have no lessons, and judged (repo, set, ok_json, valid). Lessons are
    counted by set with map-side combine; one rollup of these counts gives all three levels. A repository
    without lessons fails, and with it the corpus; a corpus without lessons fails.
    """
    counts = judged.groupBy("repo", "set").agg(
        F.count("*").alias("lessons"), F.count_if(~F.col("ok_json")).alias("parse_errors"), F.count_if(F.col("ok_json") & ~F.col("valid")).alias("invalid")
    )
    listed = repos.select("repo").distinct().select("repo", F.lit(None).cast(judged.schema["set"].dataType).alias("set"), *[F.lit(0).cast("long").alias(c) for c in ("lessons", "parse_errors", "invalid")])
    every = counts.withColumn("has", F.lit(True)).unionByName(listed.withColumn("has", F.lit(False)))
    by_repo = every.withColumn("real", F.when(F.col("has"), F.col("repo")))
    rolled = by_repo.rollup("repo", F.struct("set", "has").alias("part")).agg(
        F.grouping_id().alias("g"),
        F.count_distinct("real").alias("repos"),
        F.count_if("has").alias("sets"),
        *[F.sum(c).alias(c) for c in ("lessons", "parse_errors", "invalid")],
        F.count_distinct("repo").alias("listed"),
    )
    empty = F.col("listed") - F.col("repos")
    level = F.when(F.col("g") == 3, "corpus").when(F.col("g") == 1, "repo").otherwise("set")
    ok = (F.col("lessons") > 0) & (F.col("parse_errors") == 0) & (F.col("invalid") == 0) & (empty == 0)
    shown = rolled.filter("g > 0 OR part.has")
    return shown.select(level.alias("level"), "repo", F.col("part.set").alias("set"), "repos", "sets", "lessons", "parse_errors", "invalid", empty.alias("empty_repos"), ok.alias("ok"))


def exercises_by_type(lessons: DataFrame) -> DataFrame:
    """type, n over all exercises of lessons (lesson)."""
    drills = lessons.select(F.explode("lesson.steps").alias("s")).filter("s.exercise IS NOT NULL").select(F.coalesce("s.exercise.type", F.lit("?")).alias("type"))
    return tally(drills, "type")


def discrepancies(judged: DataFrame) -> DataFrame:
    """path, place, id, issue_path, message: up to PER_LESSON issues of each invalid lesson, SHOWN in all."""
    rows = judged.filter(~F.col("valid")).select("path", F.posexplode("errors").alias("ord", "e"))
    rows = rows.select("path", "ord", F.col("e.id").alias("id"), F.col("e.path").alias("issue_path"), F.col("e.message").alias("message"))
    return first_of_each(rows, ["path"], ["ord"]).orderBy("path", "place").limit(SHOWN)
