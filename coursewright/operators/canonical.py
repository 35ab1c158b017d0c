"""Canonical records: set entries from manifests, context into lessons, pairs from cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursewright.functions.textsem import blank, is_true
from coursewright.plans.rules import array_of
from coursewright.schemas import LESSON


def or_else(x: Column, default) -> Column:
    return F.coalesce(x, default if isinstance(default, Column) else F.lit(default))


def base_path(s: Column) -> Column:
    return F.coalesce(s["path"], F.concat(F.lit("sets/"), s["id"]))


def set_entries(manifests: DataFrame, status: str = "active") -> DataFrame:
    """A row of 23 fields, with base_path, per set; from rows (source, branch, manifest) and, where present, cached_version and downloaded_at of the set.

    ``manifests`` may have a map column ``cached`` from set id to struct (version, downloaded_at).
    """
    s = F.col("s")
    cached = F.element_at("cached", s["id"]) if "cached" in manifests.columns else F.lit(None).cast("struct<version string, downloaded_at string>")
    target = F.coalesce(s["target_language"], s["language"], F.lit(""))
    book = s["book"]
    return manifests.withColumn("s", F.explode("manifest.sets")).withColumn("cache", cached).select(
        "source",
        "branch",
        s["id"].alias("id"),
        s["title"].alias("title"),
        s["title_native"].alias("title_native"),
        target.alias("language"),
        target.alias("target_language"),
        or_else(s["source_language"], "en").alias("source_language"),
        s["level"].alias("level"),
        or_else(s["domain"], "language").alias("domain"),
        s["version"].alias("version"),
        s["lesson_count"].alias("lesson_count"),
        s["description"].alias("description"),
        array_of(s["tags"]).alias("tags"),
        s["cover_image"].alias("cover_image"),
        F.col("cache.version").alias("cached_version"),
        (F.col("cache.version").isNotNull() & ~F.col("cache.version").eqNullSafe(s["version"])).alias("update_available"),
        F.col("cache.downloaded_at").alias("downloaded_at"),
        F.lit(status).alias("status"),
        F.when(~blank(book["title"]), book).alias("book"),
        F.when(is_true(s["visibility"] == "hidden"), "hidden").otherwise("visible").alias("visibility"),
        F.when(is_true(s["review_status"].isin("generated", "reviewed")), s["review_status"]).otherwise("authored").alias("review_status"),
        s["attribution"].alias("attribution"),
        base_path(s).alias("base_path"),
    )


def inject_context(lessons: DataFrame, entries: DataFrame, key: str = "set") -> DataFrame:
    """Lessons with language pair and domain of their set where they have none of their own; from lessons (key, lesson), entries (key, ...)."""
    context = entries.select(key, F.col("target_language").alias("__target"), F.col("source_language").alias("__source"), F.col("domain").alias("__domain"))
    filled = (
        F.col("lesson")
        .withField("target_language", F.coalesce("lesson.target_language", "__target"))
        .withField("source_language", F.coalesce("lesson.source_language", "__source"))
        .withField("domain", F.coalesce("lesson.domain", "__domain"))
    )
    return lessons.join(context, key, "left").withColumn("lesson", filled).drop("__target", "__source", "__domain")


def pairs_from_cards(ids: Column, cards: Column) -> Column:
    """(left, right) of the named cards in the order of the ids; unknown ids are skipped, of cards with one id the last counts."""
    of = lambda i: F.filter(cards, lambda c: c["id"] == i)
    found = F.filter(F.transform(array_of(ids), lambda i: F.slice(F.reverse(of(i)), 1, 1)), lambda c: F.size(c) > 0)
    return F.transform(found, lambda c: F.struct(c[0]["front"].alias("left"), c[0]["back"].alias("right")))


def resolve_from_cards(lesson: Column) -> Column:
    cards = F.coalesce(lesson["cards"], F.array())

    def step(s: Column) -> Column:
        ex = s["exercise"]
        drawn = is_true(ex["type"] == "matching") & is_true(ex["from_cards"])
        done = ex.withField("pairs", pairs_from_cards(ex["card_ids"], cards)).withField("from_cards", F.lit(None).cast("boolean"))
        return F.when(drawn, s.withField("exercise", done)).otherwise(s)

    return F.when(lesson["steps"].isNull(), lesson).otherwise(lesson.withField("steps", F.transform(lesson["steps"], step)))


def parse_lessons(raw: DataFrame, entries: DataFrame | None = None, adapter=None, resolvers=()) -> DataFrame:
    """Canonical lessons of raw rows (set, raw): adapter, context, pairs from cards, then each extension's resolver.

    ``adapter`` turns rows with ``raw`` into rows with ``lesson``, typed JSON by default; a
    resolver maps a lesson Column to another.
    """
    rows = adapter(raw) if adapter else raw.withColumn("lesson", F.from_json("raw", LESSON))
    rows = inject_context(rows, entries, "set") if entries is not None else rows
    lesson = resolve_from_cards(F.col("lesson"))
    for resolve in resolvers:
        lesson = resolve(lesson)
    return rows.withColumn("lesson", lesson)


def pairs_by_order(refs: DataFrame, cards: DataFrame, owner: str) -> DataFrame:
    """The relational form: owner, pairs (text, in order); from refs (owner, ord, card_id), cards (card_id, front, back), card_id unique."""
    found = refs.join(cards, "card_id")
    one = F.struct("ord", F.concat_ws("=", "front", "back").alias("pair"))
    return found.groupBy(owner).agg(F.sort_array(F.collect_list(one)).alias("pairs")).select(owner, F.array_join(F.transform("pairs", lambda p: p["pair"]), ", ").alias("pairs"))
