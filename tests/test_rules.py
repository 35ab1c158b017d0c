import json

import pytest

from coursewright.operators.extensions import REGISTRY
from coursewright.plans.validate import exploded, parsed, validate_lessons

CARDS = [{"id": "c1", "front": "eins", "back": "one"}, {"id": "c2", "front": "zwei", "back": "two"}]


def lesson(*exercises, cards=CARDS, used=True, **more):
    drawn = [{"id": f"x{i}", "prompt": "p", **e} for i, e in enumerate(exercises)]
    if used and cards:
        drawn.append({"id": "all", "type": "free_text", "prompt": "p", "accept": ["a"], "card_ids": [c["id"] for c in cards]})
    steps = [{"id": f"s{i}", "type": "exercise", "exercise": e} for i, e in enumerate(drawn)]
    return {"id": "l", "title": "T", "cards": cards, "steps": steps, **more}


def judged(spark, *lessons, registry=None, permissive=False):
    rows = [(str(i), x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(lessons)]
    return validate_lessons(spark.createDataFrame(rows, "path string, raw string"), registry, permissive)


def ids(spark, *lessons, **kw):
    rows = judged(spark, *lessons, **kw).orderBy("path").select("path", "issues.id").collect()
    return [r[1] for r in rows]


PAIR = {"left": "a", "right": "b"}
IMAGE = {"label": "l", "src": "a.png"}
OPTION = {"text": "t"}
EXERCISES = [
    ({"type": "matching", "from_cards": True}, ["E-MATCH-FROMCARDS-CARDS"]),
    ({"type": "matching", "from_cards": True, "card_ids": ["c1"], "pairs": [PAIR]}, ["E-MATCH-FROMCARDS-PAIRS"]),
    ({"type": "matching"}, ["E-MATCH-PAIRS"]),
    ({"type": "matching", "pairs": [PAIR, {"left": " A ", "right": "b"}]}, ["E-MATCH-DUP-LEFT", "W-MATCH-AMBIG"]),
    ({"type": "matching", "pairs": [PAIR, {"left": "c", "right": "B"}]}, []),
    ({"type": "picture_choice", "images": [IMAGE]}, ["E-PIC-MIN"]),
    ({"type": "picture_choice", "images": [IMAGE, IMAGE]}, ["E-PIC-ONE-CORRECT"]),
    ({"type": "picture_choice", "images": [IMAGE | {"is_correct": "true"}, IMAGE]}, ["W-PIC-DUP-LABEL"]),
    ({"type": "picture_choice", "images": [IMAGE | {"is_correct": "true"}, {"label": "m", "src": "data:image/png;base64,aa"}]}, ["W-PIC-DATA-URI"]),
    ({"type": "picture_choice", "images": [IMAGE | {"is_correct": "true"}, {"label": "m", "src": "b"}]}, []),
    ({"type": "free_text"}, ["E-FREETEXT-ACCEPT"]),
    ({"type": "word_tiles", "tiles": ["a"]}, ["E-TILES-MIN"]),
    ({"type": "word_tiles", "tiles": ["a", "a"]}, ["W-TILES-DUP"]),
    ({"type": "word_tiles", "tiles": ["a", "a"], "accept_orderings": []}, []),
    ({"type": "word_tiles", "tiles": ["a", "b"], "accept_orderings": [[1, 0], [0, 2], [0]]}, ["E-TILES-ORDERING"] * 2),
    ({"type": "cloze", "cloze_mode": "multiselect"}, ["E-CLOZE-MS-SENTENCE", "E-CLOZE-MS-ACCEPT", "E-CLOZE-MS-DISTRACTORS"]),
    ({"type": "cloze", "cloze_mode": "multiselect", "sentence": "s", "accept": ["a", "a"], "distractors": ["a"]}, ["E-CLOZE-MS-DISJOINT"]),
    ({"type": "cloze"}, ["E-CLOZE-SENTENCE"]),
    ({"type": "cloze", "sentence": "___"}, ["E-CLOZE-BLANKS"]),
    ({"type": "cloze", "sentence": "___ ___", "blanks": [{"accept": ["a"]}]}, ["E-CLOZE-MARKERS"]),
    ({"type": "cloze", "cloze_mode": "select", "sentence": "a", "blanks": [{"accept": ["a"]}]}, ["E-CLOZE-MARKERS", "E-CLOZE-SELECT-DISTRACTORS"]),
    ({"type": "cloze", "cloze_mode": "select", "sentence": "___", "blanks": [{"accept": ["a"]}], "distractors": ["a"]}, ["W-DISTRACTOR-ANSWER"]),
    ({"type": "cloze", "cloze_mode": "type", "sentence": "___", "blanks": [{"accept": ["a"]}]}, []),
    ({"type": "multiple_choice", "options": [OPTION]}, ["E-MC-OPTIONS"]),
    ({"type": "multiple_choice", "multiple": True, "options": [OPTION, {"text": "u"}]}, ["E-MC-MIN-CORRECT"]),
    ({"type": "multiple_choice", "options": [OPTION, {"text": "u"}]}, ["E-MC-ONE-CORRECT"]),
    ({"type": "multiple_choice", "options": [OPTION | {"correct": True}, OPTION]}, ["E-MC-DUP-OPTION"]),
    ({"type": "multiple_choice", "options": [OPTION | {"correct": True}, {"text": "u"}]}, []),
    ({"type": "free_text", "accept": ["a"], "card_ids": ["c1", "no", "no"]}, ["E-CARD-REF", "E-CARD-REF"]),
    ({"type": "free_text", "accept": ["a"], "hint": "4 letters"}, ["W-HINT-LENGTH"]),
    ({"type": "ext:ref-ordering", "card_ids": ["no"]}, ["E-CARD-REF", "E-EXT-UNDECLARED"]),
]


def test_exercise_rules(spark):
    got = ids(spark, *[lesson(e) for e, _ in EXERCISES[:10]]) + ids(spark, *[lesson(e) for e, _ in EXERCISES[10:20]])
    for i in range(20, len(EXERCISES), 10):
        got += ids(spark, *[lesson(e) for e, _ in EXERCISES[i : i + 10]])
    want = [w for _, w in EXERCISES]
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    for e, w in EXERCISES[::7]:
        assert ids(spark, lesson(e)) == [w]


def step(**kw):
    return {"id": "l", "title": "T", "steps": [{"id": "s", **kw}]}


def test_step_rules(spark):
    drill = {"id": "x", "type": "free_text", "prompt": "p", "accept": ["a"]}
    got = ids(
        spark,
        step(type="theory"),
        step(type="theory", body="b", exercise=drill),
        step(type="exercise"),
        step(type="exercise", exercise=drill, body=""),
        step(type="theory", body="b"),
    )
    assert got == [["E-STEP-THEORY-BODY"], ["E-STEP-THEORY-EXERCISE"], ["E-STEP-EXERCISE-PAYLOAD"], ["E-STEP-EXERCISE-BODY"], []]


def test_lesson_rules_and_messages(spark):
    twice = [c | {"stable_id": "same-id-1"} for c in CARDS]
    got = judged(spark, lesson({"type": "free_text", "accept": ["a"]}, used=False, cards=CARDS), lesson(cards=twice), lesson({"type": "free_text", "accept": ["a"]}, title="a​b­", cards=[])).orderBy("path").select("issues").collect()
    (unused,), (dup,), (hidden,) = [r["issues"] for r in got]
    assert (unused["id"], unused["path"], unused["message"]) == ("W-CARD-UNUSED", "/cards", "2 cards are defined but never referenced by an exercise: c1, c2")
    assert dup["id"] == "E-STABLE-ID-DUP" and "(card 'c1', card 'c2')" in dup["message"]
    assert hidden["id"] == "W-INVISIBLE-CHAR"
    assert hidden["message"].startswith("lesson text contains invisible characters (U+00AD SOFT HYPHEN, U+200B ZERO WIDTH SPACE): 2 occurrences at /title. ")


def test_paths_are_zero_based_and_in_order(spark):
    two = lesson({"type": "free_text", "accept": ["a"]}, {"type": "matching", "pairs": [PAIR, PAIR, PAIR]}, cards=[])
    assert [r["ord"] for r in exploded(judged(spark, two).withColumnRenamed("path", "file"), "file").orderBy("ord").collect()] == [0, 1]
    found = judged(spark, two).select("issues").first()[0]
    assert found[0]["path"] == "/steps/1/exercise"
    assert found[0]["message"] == "MATCHING left value 'a' is repeated at positions 1, 2, 3; each left term must be unique (case-insensitive) so the pairing is solvable"


def test_theory_exercises_count_as_use(spark):
    x = {"id": "l", "title": "T", "cards": CARDS[:1], "steps": [{"id": "s", "type": "theory", "body": "b", "exercise": {"id": "x", "type": "free_text", "prompt": "p", "card_ids": ["c1"]}}]}
    assert ids(spark, x) == [["E-STEP-THEORY-EXERCISE"]]


def test_structure_comes_first(spark):
    bad = lesson({"type": "matching"}, extra=1)
    no_steps = {"id": "l", "title": "T", "steps": []}
    slug = {"id": "Not A Slug", "title": 5}
    rows = judged(spark, bad, no_steps, slug, "{not json").orderBy("path").select("issues", "valid", "ok_json").collect()
    assert [(i["id"], i["path"]) for i in rows[0]["issues"]] == [("E-UNKNOWN-FIELD", "/")]
    assert [(i["id"], i["path"]) for i in rows[1]["issues"]] == [("E-SCHEMA", "/steps")]
    assert {(i["id"], i["path"]) for i in rows[2]["issues"]} == {("E-SCHEMA", "/"), ("E-SCHEMA", "/id"), ("E-SCHEMA", "/title")}
    assert rows[3]["issues"] is None and not rows[3]["valid"] and not rows[3]["ok_json"]
    assert [r["valid"] for r in rows[:3]] == [False] * 3


def test_duplicate_keys_are_json(spark):
    raw = spark.createDataFrame([('{"id":"a","id":"b"}',), ("null",), ("[1",), ("",), (None,), ("1,2",), ('{"a":1} x',)], "raw string")
    assert [r[0] for r in parsed(raw).select("ok_json").collect()] == [True, True, False, False, False, False, False]
    odd = judged(spark, "1,2", "{'a': 1}", '{"a":1} x', "5").orderBy("path").select("ok_json", "valid", "issues.id").collect()
    assert [tuple(r) for r in odd] == [(False, False, None)] * 3 + [(True, False, ["E-SCHEMA"])]


def ext(kind, payload, declared="@1"):
    return lesson({"type": kind, "ext_payload": payload}, cards=[], requires_extensions=[kind + declared])


def test_extension_contract(spark):
    good = ext("ext:ref-ordering", {"items": ["a", "b"]})
    assert ids(spark, good) == [["E-EXT-UNSUPPORTED"]]
    assert ids(spark, good, registry=REGISTRY) == [[]]
    assert ids(spark, ext("ext:ref-ordering", {"items": ["a", "b"]}, "@2"), registry=REGISTRY) == [["E-EXT-UNSUPPORTED"]]
    assert ids(spark, ext("ext:other-kind", {}), registry=REGISTRY, permissive=True) == [[]]


PAYLOADS = {
    "ext:ref-ordering": [
        ({"items": [1]}, ["ITEMS"]), (None, ["ITEMS"]), ({"items": []}, ["MIN"]), ({"items": ["a", " ", "a"]}, ["EMPTY", "DUP"]), ({"items": ["a", "b"]}, []),
    ],
    "ext:ref-categorization": [
        ({"categories": [{"name": "a"}]}, ["SHAPE"]),
        ({"categories": []}, ["MIN"]),
        ({"categories": [{"name": "a", "items": []}, {"name": "a", "items": ["x", "x", ""]}]}, ["ITEMS", "EMPTY", "DUPNAME", "DUPITEM"]),
        ({"categories": [{"name": "a", "items": ["x"]}, {"name": "b", "items": ["y"]}]}, []),
    ],
    "ext:ref-error-correction": [
        ({"tokens": ["a"], "error_index": "0", "accept": []}, ["SHAPE"]),
        ({"tokens": ["a"], "error_index": 0, "accept": []}, ["TOKENS", "CORRECTION"]),
        ({"tokens": ["a", ""], "error_index": 0.5, "accept": ["b"]}, ["EMPTY", "INDEX"]),
        ({"tokens": ["a", "b"], "error_index": 1, "accept": ["b"]}, ["NOOP"]),
        ({"tokens": ["a", "b"], "error_index": 1, "accept": ["c"]}, []),
    ],
    "ext:ref-reading-comprehension": [
        ({"passage": 1, "questions": []}, ["SHAPE"]),
        ({"passage": " ", "questions": []}, ["PASSAGE", "QUESTIONS"]),
        (
            {"passage": "p", "questions": [{"prompt": " ", "type": "x"}, {"prompt": "p", "type": "x"}, {"prompt": "p", "type": "multiple_choice", "options": [{"text": "a"}]}, {"prompt": "p", "type": "free_text", "accept": [" "]}]},
            ["PROMPT", "QTYPE", "MC", "FT"],
        ),
        ({"passage": "p", "questions": [{"prompt": "p", "type": "free_text", "accept": ["a"]}]}, []),
    ],
    "ext:ref-graded-quiz": [
        ({"questions": [{"prompt": "p", "type": "free_text"}]}, ["SHAPE"]),
        ({"questions": [], "pass_threshold": 101}, ["QUESTIONS", "THRESHOLD"]),
        (
            {"questions": [{"prompt": "", "type": "x", "points": 1}, {"prompt": "p", "type": "x", "points": 1}, {"prompt": "p", "type": "multiple_choice", "points": 1}, {"prompt": "p", "type": "free_text", "points": 1}, {"prompt": "p", "type": "free_text", "accept": ["a"], "points": 0}]},
            ["PROMPT", "QTYPE", "MC", "FT", "POINTS"],
        ),
        ({"questions": [{"prompt": "p", "type": "free_text", "accept": ["a"], "points": 2.5}], "pass_threshold": 50}, []),
    ],
    "ext:ref-dictation": [({"audio": 1, "accept": []}, ["SHAPE"]), ({"audio": " ", "accept": [" "]}, ["AUDIO", "ACCEPT"]), ({"audio": "a", "accept": ["b"]}, [])],
    "ext:ref-image-description": [({"src": "a", "accept": [1]}, ["SHAPE"]), ({"src": "", "accept": []}, ["SRC", "ACCEPT"]), ({"src": "a", "accept": ["b"]}, [])],
}
PREFIX = dict(zip(PAYLOADS, ["REFORDER", "REFCATEG", "REFERRCORR", "REFRC", "REFGQ", "REFDICT", "REFIMGDESC"], strict=True))


@pytest.mark.parametrize("kind", PAYLOADS)
def test_payload_rules(spark, kind):
    version = {k: v for k, v in REGISTRY.items() if k[0] == kind}
    got = ids(spark, *[ext(kind, p) for p, _ in PAYLOADS[kind]], registry=version)
    assert got == [[f"E-EXT-{PREFIX[kind]}-{w}" for w in want] for _, want in PAYLOADS[kind]]
