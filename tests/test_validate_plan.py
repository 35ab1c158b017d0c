"""Each lesson's JSON is read once, however many rules look at it."""

import copy
import random

from pyspark.sql import functions as F

from coursewright.operators import quality
from coursewright.operators.extensions import REGISTRY
from coursewright.plans import catalog_jobs, catalog_lessons, structural
from coursewright.plans.validate import computed, validate_lessons

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rules_share_one_reading(spark):
    lessons = catalog_lessons.part_lessons(spark, SF)
    for registry in ({}, REGISTRY):
        judged = plan(validate_lessons(lessons, registry))
        assert judged.count("from_json") == 1
        assert judged.count("try_variant_get") < 200


def test_declared_extensions_are_read_once(spark):
    judged = plan(validate_lessons(catalog_lessons.extension_lessons(spark, SF), REGISTRY).select("k", "issues"))
    assert judged.count("regexp_extract(") == 2  # type and major


def test_a_fine_value_is_one_without_faults():
    """The test of a whole lesson or manifest agrees with the walk that tells its faults, whatever is changed in it."""
    exercise = {"id": "e1", "type": "cloze", "prompt": "p", "stable_id": "abcdefgh", "card_ids": ["c1"], "blanks": [{"accept": ["a"], "hint": None}], "multiple": True, "images": [{"label": "l", "src": "s"}], "accept_orderings": [[0, 1.0]], "cloze_mode": "type", "ext_payload": {"x": 1}}
    lesson = {"id": "l1", "title": "T", "estimated_minutes": 5, "domain": None, "cards": [{"id": "c1", "front": "f", "back": "b", "difficulty": 2, "tags": ["t"]}], "steps": [{"id": "s1", "type": "exercise", "exercise": exercise}]}
    one = {"id": "x", "title": "T", "target_language": "de", "level": "A1", "version": "1", "lesson_count": 3, "visibility": "visible", "book": {"title": "b", "more": 1}, "assets": [{"path": "p", "size_kb": 4}]}
    odd = [None, "", "a b", "ext:a-b", "x" * 501, 0, -1, 1.5, float("nan"), True, [], {}, [None], {"id": 1}, "data:image/png;base64,"]
    rng = random.Random(35)
    fine = 0

    def places(value):
        for key in list(value) if isinstance(value, dict) else range(len(value)):
            yield value, key
            if isinstance(value[key], (dict, list)):
                yield from places(value[key])

    for whole, rule, test in ((lesson, structural.LESSON, structural.FINE_LESSON), ({"name": "n", "metadata": {"any": 1}, "sets": [one]}, structural.MANIFEST, structural.FINE_MANIFEST)):
        for _ in range(1500):
            value = copy.deepcopy(whole)
            at, key = rng.choice(list(places(value)))
            how = rng.randrange(3)
            if how == 0:
                del at[key]
            elif how == 1 and isinstance(at, dict):
                at[f"{key}2"] = 1
            else:
                at[key] = rng.choice(odd)
            found = []
            structural._faults(value, rule, "", found)
            assert test(value) is (not found)
            fine += not found
    assert 300 < fine < 2700


def test_computed_columns_keep_rows_and_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    got = computed(df, z=F.upper("y"), x=F.col("x") + 1)
    assert got.columns == ["y", "z", "x"] and sorted(map(tuple, got.collect()), key=str) == [("a", "A", 2), (None, None, 3)]


def test_quality_scans_each_table_once(spark):
    text = plan(quality.observed(quality.judged(catalog_jobs.order_lessons(spark, SF)))[0])
    assert text.count("Relation [") + text.count("Relation[") == 2  # lineitem, part


def test_one_large_set_has_no_window(spark):
    assert "Window" not in plan(catalog_jobs.one_set(spark, SF))
