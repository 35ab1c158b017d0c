"""Stable identities across a corpus: duplicates, two snapshots compared (V1 to V6), coverage and its gate.

Tables: elements (set, stable_id, kind, type, lesson, ord), lessons (set, filename), retired
(set, stable_id). Keys are (set, stable_id); no rule collapses repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursewright.functions.textsem import falsy

KEY = ["set", "stable_id"]


def inventory(lessons: DataFrame) -> DataFrame:
    """set, lesson, stable_id, kind, type, element, ord of all elements with an id, cards first; from rows (set, filename, lesson)."""
    cards = lessons.select("set", F.col("filename").alias("file"), F.posexplode("lesson.cards").alias("at", "e")).select(
        "set", "file", F.lit(0).alias("part"), "at", F.lit("card").alias("kind"), F.lit("card").alias("type"), F.col("e.id").alias("element"), F.col("e.stable_id").alias("stable_id")
    )
    drills = lessons.select("set", F.col("filename").alias("file"), F.posexplode("lesson.steps").alias("at", "s")).filter("s.exercise IS NOT NULL")
    drills = drills.select(
        "set", "file", F.lit(1).alias("part"), "at", F.lit("exercise").alias("kind"), F.coalesce("s.exercise.type", F.lit("?")).alias("type"), F.col("s.exercise.id").alias("element"), F.col("s.exercise.stable_id").alias("stable_id")
    )
    found = cards.unionByName(drills).filter(~falsy(F.col("stable_id")))
    return found.select("set", F.col("file").alias("lesson"), "stable_id", "kind", "type", F.coalesce("element", F.lit("?")).alias("element"), F.struct("part", "at").alias("ord"))


def duplicate_ids(elements: DataFrame, key: list[str], order: str = "ord") -> DataFrame:
    """``key``, n and places (elements in order) of the keys that several rows have."""
    rest = [c for c in elements.columns if c not in key]
    return elements.groupBy(*key).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(order, *[c for c in rest if c != order]))).alias("places")).filter("n > 1")


def duplicate_counts(elements: DataFrame, key: list[str]) -> DataFrame:
    """As duplicate_ids without the places: nothing of a key is gathered."""
    return elements.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def disappeared(base: DataFrame, head: DataFrame, retired: DataFrame) -> DataFrame:
    """V1: base elements that head neither has nor retires."""
    return base.join(head.select(*KEY), KEY, "left_anti").join(retired.select(*KEY), KEY, "left_anti")


def moved(base: DataFrame, head: DataFrame, order: str = "ord") -> DataFrame:
    """V3: base elements whose id stands for another kind or type in head, with the first such (now_kind, now_type).

    What head has of an id is counted down to its kinds and types first, which are few.
    """
    kinds = head.groupBy(*KEY, F.col("kind").alias("now_kind"), F.col("type").alias("now_type")).agg(F.min(order).alias("first"))
    others = kinds.groupBy(*KEY).agg(F.collect_list(F.struct("first", "now_kind", "now_type")).alias("others_"))
    different = F.filter("others_", lambda o: (F.col("kind") != o["now_kind"]) | (F.col("type") != o["now_type"]))
    found = base.join(others, KEY).withColumn("now_", F.array_min(different)).filter("now_ IS NOT NULL")
    return found.select(*base.columns, "now_.now_kind", "now_.now_type")


def unretired(base_retired: DataFrame, head_retired: DataFrame) -> DataFrame:
    """V5: retirements that were taken back."""
    return base_retired.join(head_retired.select(*KEY), KEY, "left_anti")


def retired_alive(head_retired: DataFrame, head: DataFrame) -> DataFrame:
    """V6: retirements whose element is still there."""
    return head_retired.join(head.select(*KEY), KEY, "left_semi")


def lost_files(base: DataFrame, head: DataFrame) -> DataFrame:
    """V4: files that are gone from a set that still has files."""
    return base.join(head.select("set"), "set", "left_semi").join(head.select("set", "filename"), ["set", "filename"], "left_anti")


def violations(base: tuple[DataFrame, DataFrame, DataFrame], head: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """rule, set, message of all violations, from (elements, lessons, retired) of both snapshots.

    phase and ord give their order: V1 and V3 as the base's elements stand, then V2, V5, V6, V4.
    """
    base_elements, base_files, base_retired = base
    head_elements, head_files, head_retired = head
    said = lambda *parts: F.concat(*[F.lit(p) if p[:1] != "$" else F.coalesce(F.col(p[1:]).cast("string"), F.lit("?")) for p in parts])

    def told(df: DataFrame, rule: str, phase: int, order, *parts: str) -> DataFrame:
        return df.select(F.lit(phase).alias("phase"), order.cast("string").alias("ord"), F.lit(rule).alias("rule"), "set", said(*parts).alias("message"))

    place = F.to_json(F.struct("lesson", "ord"))
    gone = told(disappeared(base_elements, head_elements, head_retired), "V1", 0, place, "stable_id '", "$stable_id", "' (", "$kind", " in ", "$lesson", ") disappeared without being declared in the set's retired_ids; declare the retirement or restore the element")
    other = told(moved(base_elements, head_elements), "V3", 0, place, "stable_id '", "$stable_id", "' moved from ", "$kind", "/", "$type", " to ", "$now_kind", "/", "$now_type", " (id reuse)")
    twice = duplicate_ids(head_elements, KEY).withColumn("where", F.array_join(F.transform("places", lambda p: F.concat(p["kind"], F.lit(" in "), p["lesson"])), ", "))
    twice = told(twice, "V2", 1, F.col("stable_id"), "stable_id '", "$stable_id", "' is used ", "$n", " times in this set (", "$where", ")")
    back = told(unretired(base_retired, head_retired), "V5", 2, F.col("stable_id"), "retired_id '", "$stable_id", "' left the set's retired_ids list; a published retirement is never un-declared")
    alive = told(retired_alive(head_retired, head_elements), "V6", 3, F.col("stable_id"), "retired_id '", "$stable_id", "' is declared retired but still present in the set; a consumer resolves it as living, so the retirement would be silently ignored - remove the element or the declaration")
    lost = told(lost_files(base_files, head_files), "V4", 4, F.col("filename"), "lesson file '", "$filename", "' is gone while its set survives; the filename is the lesson's identity for progress joins")
    return gone.unionByName(other).unionByName(twice).unionByName(back).unionByName(alive).unionByName(lost)


def checked(base: tuple[DataFrame, DataFrame, DataFrame], head: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """One row of six counts, and whether the base is credible: not empty while the head isn't."""
    names = ["ids", "lessons", "retired"]
    counts = [df.agg(F.count("*").alias(f"{side}_{name}")) for side, dfs in (("base", base), ("head", head)) for name, df in zip(names, dfs, strict=True)]
    row = counts[0]
    for other in counts[1:]:  # of one row each
        row = row.crossJoin(other)
    return row.withColumn("credible", ~((F.col("head_lessons") > 0) & (F.col("base_lessons") == 0))).withColumn("head_empty", (F.col("base_lessons") > 0) & (F.col("head_lessons") == 0))


def coverage(sets: DataFrame, elements: DataFrame) -> DataFrame:
    """set, lessons, covered for each listed set; from sets (set), elements (set, lesson, has_id).

    A lesson without elements is a row with has_id null: it is covered, but a set without any
    lesson is not.
    """
    per = elements.groupBy("set").agg(F.count_distinct("lesson").alias("lessons"), F.coalesce(F.bool_and("has_id"), F.lit(True)).alias("all_ids"))
    return sets.join(per, "set", "left").select("set", F.coalesce("lessons", F.lit(0)).cast("long").alias("lessons"), F.coalesce(F.col("all_ids") & (F.col("lessons") > 0), F.lit(False)).alias("covered"))


def gate(covered: DataFrame, baseline: int) -> DataFrame:
    """rule, message of the failures of a coverage table against the baseline; no rows: the gate is open."""
    total = covered.agg(
        F.count("*").alias("total"),
        F.count_if("covered").alias("covered"),
        F.array_join(F.sort_array(F.collect_list(F.when(~F.col("covered"), F.col("set").cast("string")))), ", ").alias("names"),
    ).withColumn("missing", F.col("total") - F.col("covered"))
    rule = lambda name, condition, message: F.when(condition, F.struct(F.lit(name).alias("rule"), message.alias("message")))
    n, b = F.col("covered").cast("string"), F.lit(str(baseline))
    some = F.col("total") > 0
    found = F.array(
        rule("NO_SETS", ~some, F.lit("the root manifest lists no sets; a run over nothing is never fully covered")),
        rule("REGRESSION", some & (F.col("covered") < baseline), F.concat(F.lit("coverage "), n, F.lit(" below baseline "), b, F.lit(" (regression)"))),
        rule("UNDECLARED_RAISE", some & (F.col("covered") > baseline), F.concat(F.lit("coverage "), n, F.lit(" above baseline "), b, F.lit("; raise it deliberately"))),
        rule("INCOMPLETE", some & (F.col("missing") > 0), F.concat(F.col("missing").cast("string"), F.lit(" listed set(s) carry no complete stable_id coverage: "), F.col("names"))),
    )
    return total.select(F.explode(F.array_compact(found)).alias("f")).select("f.*")
