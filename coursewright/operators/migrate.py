"""Rewrites of cloze exercises with a choice to multiple choice, as Columns, with an audit row per exercise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursewright.functions.textsem import falsy, is_true
from coursewright.operators.rewrite import edit, rewritten
from coursewright.plans.rules import array_of
from coursewright.plans.validate import validate_lessons

OPTIONS = "array<struct<text string, correct boolean>>"


def merged_prompt(ex: Column) -> Column:
    prompt, sentence = F.coalesce(ex["prompt"], F.lit("")), F.coalesce(ex["sentence"], F.lit(""))
    bare = (sentence == "") | (sentence == "___")
    return F.when(bare, F.when(prompt == "", sentence).otherwise(prompt)).otherwise(F.when(prompt == "", sentence).otherwise(F.concat(prompt, F.lit("\n\n"), sentence)))


def choices(right: Column, distractors: Column) -> Column:
    """Options of the right texts, then of the distractors that aren't among them."""
    marked = F.transform(right, lambda t: F.struct(t.alias("text"), F.lit(True).alias("correct")))
    wrong = F.filter(array_of(distractors), lambda d: ~is_true(F.array_contains(right, d)))
    return F.concat(marked.cast(OPTIONS), F.transform(wrong, lambda t: F.struct(t.alias("text"), F.lit(None).cast("boolean").alias("correct"))).cast(OPTIONS))


def _single(ex: Column) -> Column:
    return array_of(ex["blanks"][0]["accept"])


def convertible(ex: Column) -> Column:
    select = is_true(ex["cloze_mode"] == "select") & is_true(F.size(ex["blanks"]) == 1) & ~falsy(F.get(_single(ex), F.lit(0)))
    multi = is_true(ex["cloze_mode"] == "multiselect") & (F.size(array_of(ex["accept"])) > 0)
    return is_true(ex["type"] == "cloze") & (select | multi)


def converted(ex: Column) -> Column:
    multi = is_true(ex["cloze_mode"] == "multiselect")
    right = F.when(multi, array_of(ex["accept"])).otherwise(F.slice(_single(ex), 1, 1))
    done = (
        ex.withField("type", F.lit("multiple_choice"))
        .withField("prompt", merged_prompt(ex))
        .withField("options", choices(right, ex["distractors"]))
        .withField("multiple", F.when(multi, True).otherwise(ex["multiple"]))
    )
    for name, kind in (("cloze_mode", "string"), ("sentence", "string"), ("blanks", None), ("accept", "array<string>"), ("distractors", "array<string>")):
        done = done.withField(name, F.lit(None).cast(kind) if kind else F.when(F.lit(False), ex["blanks"]))
    return F.when(convertible(ex), done).otherwise(ex)


def audit(ex: Column) -> Column:
    """id, status, reason, notes of an exercise that a migration looks at; null for others."""
    text = lambda x: F.lit(x)
    chosen = is_true(ex["type"] == "cloze") & is_true(ex["cloze_mode"].isin("select", "multiselect"))
    select = is_true(ex["cloze_mode"] == "select")
    blanks = F.when(ex["blanks"].isNull(), 0).otherwise(F.size(ex["blanks"]))
    reason = (
        F.when(select & (blanks != 1), F.concat(text("select with "), blanks.cast("string"), text(" blanks - only single-blank selects map onto one multiple_choice question")))
        .when(select & falsy(F.get(_single(ex), F.lit(0))), text("blank has no accept entries"))
        .when(~select & (F.size(array_of(ex["accept"])) == 0), text("multiselect has no accept entries"))
    )
    right = F.when(select, F.slice(_single(ex), 1, 1)).otherwise(array_of(ex["accept"]))
    others = F.when(select & (F.size(_single(ex)) > 1), F.slice(_single(ex), 2, 1 << 20)).otherwise(F.array().cast("array<string>"))
    notes = F.concat(
        F.transform(others, lambda a: F.concat(text("dropped alternate accept '"), a, text("' (multiple_choice options have exactly one text)"))),
        F.transform(F.filter(array_of(ex["distractors"]), lambda d: is_true(F.array_contains(right, d))), lambda d: F.concat(text("dropped distractor '"), d, text("' (equals a correct option)"))),
    )
    row = F.struct(
        F.coalesce(ex["id"], text("?")).alias("id"),
        F.when(reason.isNull(), "converted").otherwise("skipped").alias("status"),
        reason.alias("reason"),
        F.when(reason.isNull() & (F.size(notes) > 0), notes).alias("notes"),
    )
    return F.when(chosen, row)


def changes(lesson: Column) -> Column:
    """The audit rows of a lesson, in order."""
    return F.filter(F.transform(F.coalesce(lesson["steps"], F.array()), lambda s: audit(s["exercise"])), lambda a: a.isNotNull())


def converted_count() -> Column:
    return F.size(F.filter("changes", lambda c: c["status"] == "converted"))


def migrate(lessons: DataFrame) -> DataFrame:
    """Lessons (path, lesson) rewritten, with changes (audit rows in order) and converted (their number)."""
    step = lambda s: F.when(s["exercise"].isNotNull(), s.withField("exercise", converted(s["exercise"]))).otherwise(s)
    done = F.when(F.col("lesson.steps").isNull(), F.col("lesson")).otherwise(F.col("lesson").withField("steps", F.transform("lesson.steps", step)))
    return lessons.withColumn("changes", changes(F.col("lesson"))).withColumn("converted", converted_count()).withColumn("lesson", done)


STRIPPED = ["cloze_mode", "sentence", "blanks", "accept", "distractors"]


def edits(lesson: Column) -> Column:
    """What a migration changes in the raw text: an edit for each exercise that it converts."""

    def one(s: Column, i: Column) -> Column:
        new = converted(s["exercise"])
        put = F.struct(new["type"].alias("type"), new["prompt"].alias("prompt"), new["options"].alias("options"), F.when(is_true(s["exercise"]["cloze_mode"] == "multiselect"), True).alias("multiple"))
        return F.when(s["exercise"].isNotNull() & convertible(s["exercise"]), edit(i, put, STRIPPED))

    return F.array_compact(F.transform(F.coalesce(lesson["steps"], F.array()), one))


def migrated_and_valid(lessons: DataFrame) -> DataFrame:
    """As migrate, from rows (path, raw, lesson), with the new text in ``raw`` and its verdict, judged without any extension;
    only valid rows are to be written. What a migration doesn't change stays as it was written."""
    done = lessons.withColumn("changes", changes(F.col("lesson"))).withColumn("converted", converted_count())
    return validate_lessons(rewritten(done, edits(F.col("lesson"))))
