"""Lesson order within a set: ids sort as text, and three lints find sets whose numbers then read wrongly.

``ordering_rules`` works on one list of ids; ``divergence``, ``mixed_prefixes`` and
``prefix_widths`` on a table (set, id, position) by joins and aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursewright.functions.textsem import code_unit_key, natural_key
from coursewright.operators.ranking import ranked
from coursewright.plans.rules import issue, none
from coursewright.schemas import ISSUES

PREFIX = r"\A([0-9]+)-"


def _by(ids: Column, key) -> Column:
    """The ids in order of a key; equal keys keep their order."""
    rows = F.array_sort(F.transform(ids, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))))
    return F.transform(rows, lambda r: r["x"])


def ordering_rules(ids: Column) -> Column:
    """Issues of one list of lesson ids."""
    bare = F.filter(ids, lambda x: ~x.rlike(PREFIX))
    mixed = F.when(
        (F.size(bare) > 0) & (F.size(bare) < F.size(ids)),
        F.array(
            issue(
                "W-SET-ORDER-MIXED-PREFIX",
                "",
                F.concat(
                    F.lit("some lesson ids carry an NN- ordering prefix and some do not ("),
                    F.array_join(bare, ", "),
                    F.lit("); consumers sort ids lexicographically, so the unprefixed ids land wherever their first character falls"),
                ),
                "lesson-ordering",
            )
        ).cast(ISSUES),
    ).otherwise(none())
    prefixed = F.filter(ids, lambda x: x.rlike(PREFIX))
    widths = F.array_sort(F.array_distinct(F.transform(prefixed, lambda x: F.length(F.regexp_extract(x, PREFIX, 1)))))
    width = F.when(
        F.size(widths) > 1,
        F.array(
            issue(
                "W-SET-ORDER-PREFIX-WIDTH",
                "",
                F.concat(
                    F.lit("NN- ordering prefixes have different digit widths ("),
                    F.array_join(widths.cast("array<string>"), " and "),
                    F.lit("); lexicographic sorting puts '10-' before '2-', so zero-pad every prefix to one fixed width"),
                ),
                "lesson-ordering",
            )
        ).cast(ISSUES),
    ).otherwise(none())
    both = F.filter(F.arrays_zip(_by(ids, code_unit_key).alias("shown"), _by(ids, natural_key).alias("meant")), lambda p: p["shown"] != p["meant"])
    numeric = F.when(
        F.size(both) > 0,
        F.array(
            issue(
                "W-SET-ORDER-NUMERIC",
                "",
                F.concat(
                    F.lit("the display order diverges from the numeric reading: consumers sort '"),
                    both[0]["shown"],
                    F.lit("' before '"),
                    both[0]["meant"],
                    F.lit("'; zero-pad the embedded numbers to a fixed width"),
                ),
                "lesson-ordering",
            )
        ).cast(ISSUES),
    ).otherwise(none())
    return F.when(F.size(ids) >= 2, F.concat(mixed, width, numeric)).otherwise(none())


def divergence(ids: DataFrame) -> DataFrame:
    """set, rank, shown, meant: the first rank where the two orders of a set differ; from rows (set, id, position).

    Both orders are ranked by sorted ranges, so that a set may have any number of ids.
    """
    keyed = ids.select("set", "id", "position", code_unit_key(F.col("id")).alias("shown_key"), natural_key(F.col("id")).alias("meant_key"))
    shown = ranked(keyed.select("set", "shown_key", "position", F.col("id").alias("shown")), ["set"], ["shown_key", "position"]).select("set", "rank", "shown")
    meant = ranked(keyed.select("set", "meant_key", "position", F.col("id").alias("meant")), ["set"], ["meant_key", "position"]).select("set", "rank", "meant")
    apart = shown.join(meant, ["set", "rank"]).filter("shown <> meant")
    return apart.groupBy("set").agg(F.min("rank").alias("rank"), F.min_by("shown", "rank").alias("shown"), F.min_by("meant", "rank").alias("meant"))


def mixed_prefixes(ids: DataFrame) -> DataFrame:
    """set, bare, total of the sets where some ids have a number before a dash and some have not."""
    bare = F.count_if(~F.col("id").rlike(PREFIX))
    return ids.groupBy("set").agg(bare.alias("bare"), F.count("*").alias("total")).filter("bare > 0 AND bare < total")


def prefix_widths(ids: DataFrame) -> DataFrame:
    """set, widths: the sets whose prefixes differ in width, the widths in ascending order."""
    width = F.when(F.col("id").rlike(PREFIX), F.length(F.regexp_extract("id", PREFIX, 1)))
    return ids.groupBy("set").agg(F.array_sort(F.collect_set(width)).alias("widths")).filter("size(widths) > 1").withColumn("widths", F.array_join(F.col("widths").cast("array<string>"), " and "))
