"""Quality minimums: thresholds read as data, what each lesson lacks, and a gate on metrics of the same pass.

A measure gives the places of a lesson where a minimum counts, with the number found there; a
minimum that the number falls short of is a shortfall. Judging is row by row, and the gate's
numbers are observed while the rows go by: there is no second pass over the lessons.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from coursewright.functions.textsem import count_of, is_true
from coursewright.plans.validate import computed

#: The published minimums.
MINIMUMS = {"minExerciseTypes": 2, "minExercisesPerLesson": 5, "minFreeTextAccepts": 2, "minMatchingPairs": 3, "minTheorySteps": 1}

SHORTFALLS = "array<struct<rule string, path string, found bigint, minimum bigint>>"


def steps_of(lesson: Column) -> Column:
    return F.coalesce(lesson["steps"], F.array())


def drills(lesson: Column) -> Column:
    """(path, ex) of the exercises, in order."""
    each = F.transform(steps_of(lesson), lambda s, i: F.struct(F.concat(F.lit("/steps/"), i.cast("string"), F.lit("/exercise")).alias("path"), s["exercise"].alias("ex"), s["type"].alias("kind")))
    return F.filter(each, lambda d: is_true(d["kind"] == "exercise") & d["ex"].isNotNull())


def whole(path: str, found: Column) -> Column:
    return F.array(F.struct(F.lit(path).alias("path"), found.cast("long").alias("found")))


def per_drill(lesson: Column, kind: str, found: Callable[[Column], Column]) -> Column:
    own = F.filter(drills(lesson), lambda d: is_true(d["ex"]["type"] == kind))
    return F.transform(own, lambda d: F.struct(d["path"].alias("path"), found(d["ex"]).cast("long").alias("found")))


#: The (path, found) places of a lesson at which a minimum counts.
MEASURES: dict[str, Callable[[Column], Column]] = {
    "minExerciseTypes": lambda lesson: whole("/steps", F.size(F.array_distinct(F.transform(drills(lesson), lambda d: d["ex"]["type"])))),
    "minExercisesPerLesson": lambda lesson: whole("/steps", F.size(drills(lesson))),
    "minFreeTextAccepts": lambda lesson: per_drill(lesson, "free_text", lambda ex: count_of(ex["accept"])),
    # pairs that come from cards are as many as the cards
    "minMatchingPairs": lambda lesson: per_drill(lesson, "matching", lambda ex: F.when(is_true(ex["from_cards"]), count_of(ex["card_ids"])).otherwise(count_of(ex["pairs"]))),
    "minTheorySteps": lambda lesson: whole("/steps", F.size(F.filter(steps_of(lesson), lambda s: is_true(s["type"] == "theory")))),
}


def checked(minimums: dict[str, int]) -> dict[str, int]:
    """The minimums by name, if every one has a measure and is a whole number."""
    for name, least in minimums.items():
        if name not in MEASURES:
            raise ValueError(f"no measure for the minimum {name}")
        if not isinstance(least, int) or isinstance(least, bool) or least < 0:
            raise ValueError(f"the minimum {name} must be a whole number: {least!r}")
    return dict(sorted(minimums.items()))


def read_minimums(spark: SparkSession, path: str) -> dict[str, int]:
    """The minimums of a JSON file with an object ``rules``."""
    (row,) = spark.read.text(path, wholetext=True).collect()  # one small file of settings
    return checked(json.loads(row["value"])["rules"])


def shortfalls(lesson: Column, minimums: dict[str, int]) -> Column:
    """The shortfalls of a lesson by rule, then place; null for a null lesson."""

    def short(rule: str, least: int) -> Column:
        under = F.filter(MEASURES[rule](lesson), lambda m: m["found"] < least)
        return F.transform(under, lambda m: F.struct(F.lit(rule).alias("rule"), m["path"].alias("path"), m["found"].alias("found"), F.lit(least).cast("long").alias("minimum")))

    none = F.array().cast(SHORTFALLS)
    return F.when(lesson.isNotNull(), F.concat(none, *[short(rule, least) for rule, least in checked(minimums).items()]))


def judged(lessons: DataFrame, minimums: dict[str, int] = MINIMUMS) -> DataFrame:
    """The rows with ``shortfalls`` of their column ``lesson``; a lesson that could not be read has null and fails."""
    return computed(lessons, shortfalls=shortfalls(F.col("lesson"), minimums))


def observed(judged: DataFrame, minimums: dict[str, int] = MINIMUMS) -> tuple[DataFrame, Observation]:
    """The judged rows and what is counted while they are written or shown: lessons, good ones, unread ones, and those short of each minimum."""
    seen = Observation()
    each = [F.count_if(F.coalesce(F.exists("shortfalls", lambda s: s["rule"] == rule), F.lit(False))).alias(rule) for rule in checked(minimums)]
    unread, good = F.count_if(F.col("shortfalls").isNull()), F.count_if(F.size("shortfalls") == 0)
    return judged.observe(seen, F.count(F.lit(1)).alias("lessons"), good.alias("good"), unread.alias("unread"), *each), seen


def gate(metrics: dict[str, int]) -> tuple[bool, list[str]]:
    """Whether all lessons have the minimums (there must be one), and the lines of a report."""
    lessons, good, unread = (metrics[k] for k in ("lessons", "good", "unread"))
    lines = [f"{lessons} lesson(s), {good} with all minimums, {unread} unread"]
    lines += [f"{rule}: {n} lesson(s) short" for rule, n in sorted(metrics.items()) if rule in MEASURES and n]
    return lessons > 0 and good == lessons, lines
