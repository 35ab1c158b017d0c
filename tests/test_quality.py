import json

import pytest
from pyspark.sql import functions as F

from coursewright.operators import quality
from coursewright.schemas import LESSON


def drill(kind, **kw):
    return {"id": "s", "type": "exercise", "exercise": {"id": "x", "type": kind, "prompt": "p", **kw}}


THEORY = {"id": "t", "type": "theory", "body": "b"}
PAIR = {"left": "l", "right": "r"}
GOOD = [THEORY, *[drill("cloze")] * 3, drill("free_text", accept=["a", "b"]), drill("matching", pairs=[PAIR] * 3)]


def rows(spark, *lessons):
    raw = spark.createDataFrame([(i, x if isinstance(x, str) else json.dumps({"id": "l", "title": "t", "steps": x})) for i, x in enumerate(lessons)], "i int, raw string")
    return raw.withColumn("lesson", F.when(F.col("raw") != "no", F.from_json("raw", LESSON)))


def test_minimums_at_and_below_their_bounds(spark):
    short = [
        [],
        [drill("free_text", accept=["a"]), drill("free_text"), drill("matching", pairs=[PAIR] * 2), drill("matching", from_cards=True, card_ids=["a", "b", "c"]), drill("matching", from_cards=True, pairs=[PAIR] * 9)],
        [{**THEORY, "exercise": {"id": "x", "type": "free_text"}}, {"id": "s", "type": "exercise"}],
        "no",
    ]
    got = {r.i: r.shortfalls and [tuple(s) for s in r.shortfalls] for r in quality.judged(rows(spark, GOOD, *short)).collect()}
    assert got[0] == []
    assert got[1] == [("minExerciseTypes", "/steps", 0, 2), ("minExercisesPerLesson", "/steps", 0, 5), ("minTheorySteps", "/steps", 0, 1)]
    assert got[2] == [
        ("minFreeTextAccepts", "/steps/0/exercise", 1, 2),
        ("minFreeTextAccepts", "/steps/1/exercise", 0, 2),
        ("minMatchingPairs", "/steps/2/exercise", 2, 3),
        ("minMatchingPairs", "/steps/4/exercise", 0, 3),
        ("minTheorySteps", "/steps", 0, 1),
    ]
    # an exercise of a theory step counts for nothing, nor does an empty exercise step
    assert got[3] == [("minExerciseTypes", "/steps", 0, 2), ("minExercisesPerLesson", "/steps", 0, 5)]
    assert got[4] is None


def test_gate_counts_in_the_pass_that_writes(spark):
    lessons = rows(spark, GOOD, GOOD, [], "no")
    out, seen = quality.observed(quality.judged(lessons))
    out.write.format("noop").mode("overwrite").save()
    ok, lines = quality.gate(seen.get)
    assert not ok and lines == ["4 lesson(s), 2 with all minimums, 1 unread", "minExerciseTypes: 1 lesson(s) short", "minExercisesPerLesson: 1 lesson(s) short", "minTheorySteps: 1 lesson(s) short"]
    out, seen = quality.observed(quality.judged(lessons.filter("i < 2")))
    out.write.format("noop").mode("overwrite").save()
    assert quality.gate(seen.get) == (True, ["2 lesson(s), 2 with all minimums, 0 unread"])
    out, seen = quality.observed(quality.judged(lessons.limit(0)))
    out.write.format("noop").mode("overwrite").save()
    assert not quality.gate(seen.get)[0]


def test_minimums_are_data(spark, tmp_path):
    (tmp_path / "rules.json").write_text(json.dumps({"rules": {"minTheorySteps": 2, "minMatchingPairs": 0}}))
    read = quality.read_minimums(spark, str(tmp_path / "rules.json"))
    assert read == {"minMatchingPairs": 0, "minTheorySteps": 2}
    assert [tuple(s) for s in quality.judged(rows(spark, GOOD), read).first().shortfalls] == [("minTheorySteps", "/steps", 1, 2)]
    for wrong in ({"minNothing": 1}, {"minTheorySteps": "1"}, {"minTheorySteps": True}, {"minTheorySteps": -1}):
        with pytest.raises(ValueError):
            quality.checked(wrong)
