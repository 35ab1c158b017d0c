import json

from pyspark.sql import functions as F

from coursewright.operators import canonical, conformance, extensions, identity, migrate, mint, ordering, parity, reports, wiring
from coursewright.plans.validate import known_domain, known_level, validate_lessons, validate_manifests
from coursewright.schemas import EXERCISE, LESSON, MANIFEST
from coursewright.sources import lessons as source
from coursewright.sources import manifests, qti

ELEMENT = "set string, stable_id string, kind string, type string, lesson string, ord int"


def typed(spark, *rows):
    raw = spark.createDataFrame([(f"p{i}", json.dumps(r)) for i, r in enumerate(rows)], "path string, raw string")
    return raw.withColumn("lesson", F.from_json("raw", LESSON))


def drill(i, **kw):
    return {"id": f"s{i}", "type": "exercise", "exercise": {"id": f"x{i}", "type": "free_text", "prompt": "p", **kw}}


def test_inventory_and_violations(spark):
    cards = [{"id": "c", "stable_id": "id-1"}, {"id": "d", "stable_id": ""}]
    base = {"id": "l", "cards": cards, "steps": [drill(0, stable_id="id-2"), drill(1, stable_id="id-3"), {"id": "t", "type": "theory", "exercise": {"stable_id": "id-4"}}]}
    head = {"id": "l", "cards": [{"id": "c", "stable_id": "id-2"}, {"id": "e", "stable_id": "id-2"}], "steps": [drill(1, stable_id="id-9")]}

    def side(x, file):
        rows = typed(spark, x).select(F.lit("s").alias("set"), F.lit(file).alias("filename"), "lesson")
        return identity.inventory(rows), rows.select("set", "filename")

    none = spark.createDataFrame([], "set string, stable_id string")
    retired = spark.createDataFrame([("s", "id-3"), ("s", "id-9")], "set string, stable_id string")
    was = spark.createDataFrame([("s", "id-0")], "set string, stable_id string")
    (be, bf), (he, hf) = side(base, "a.json"), side(head, "b.json")
    assert [r.type for r in be.orderBy("ord").collect()] == ["card", "free_text", "free_text", "?"]
    got = identity.violations((be, bf, was), (he, hf, retired)).orderBy("phase", "ord", "rule").collect()
    assert [(r.rule, r.message.split("'")[1]) for r in got] == [("V1", "id-1"), ("V3", "id-2"), ("V1", "id-4"), ("V2", "id-2"), ("V5", "id-0"), ("V6", "id-9"), ("V4", "a.json")]
    assert "moved from exercise/free_text to card/card" in got[1].message
    assert "is used 2 times in this set (card in b.json, card in b.json)" in got[3].message
    row = identity.checked((be, bf, was), (he, hf.limit(0), none)).first()
    assert (row.base_ids, row.head_ids, row.base_retired, row.head_lessons, row.credible, row.head_empty) == (4, 3, 1, 0, True, True)


def test_repeated_base_rows_are_each_told(spark):
    rows = spark.createDataFrame([("s", "a", "card", "card", "l", 0)] * 2 + [("t", "a", "card", "card", "l", 1)], ELEMENT)
    other = spark.createDataFrame([("t", "a", "card", "card", "l", 0)], ELEMENT)
    assert identity.disappeared(rows, other, rows.limit(0)).count() == 2


def test_coverage_and_gate(spark):
    sets = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "set string")
    elements = spark.createDataFrame([("a", "l", True), ("a", "m", True), ("b", "l", True), ("b", "m", False), ("c", "l", None)], "set string, lesson string, has_id boolean")
    got = identity.coverage(sets, elements)
    assert {r.set: r.covered for r in got.collect()} == {"a": True, "b": False, "c": True, "d": False}
    rules = lambda base, df=got: [(r.rule, r.message) for r in identity.gate(df, base).collect()]
    assert [r for r, _ in rules(3)] == ["REGRESSION", "INCOMPLETE"]
    assert rules(1)[0][0] == "UNDECLARED_RAISE" and rules(2) == [("INCOMPLETE", "2 listed set(s) carry no complete stable_id coverage: b, d")]
    assert [r for r, _ in rules(0, got.limit(0))] == ["NO_SETS"]
    assert rules(2, got.filter("covered")) == []


def orders(spark, *lists):
    rows = spark.createDataFrame([(x,) for x in lists], "ids array<string>")
    return [[i.id for i in r[0]] for r in rows.select(ordering.ordering_rules(F.col("ids"))).collect()]


def test_ordering_rules(spark):
    got = orders(spark, ["a"], ["01-a", "b"], ["1-a", "10-b"], ["1-a", "2-b"], ["k-10", "k-2"], ["k-01", "k-1"], [])
    assert got == [[], ["W-SET-ORDER-MIXED-PREFIX"], ["W-SET-ORDER-PREFIX-WIDTH"], [], ["W-SET-ORDER-NUMERIC"], [], []]
    rows = spark.createDataFrame([("s", "k-10", 0), ("s", "k-2", 1), ("t", "a", 0)], "set string, id string, position int")
    assert [tuple(r) for r in ordering.divergence(rows).collect()] == [("s", 1, "k-10", "k-2")]


def test_wiring(spark):
    x = {
        "id": "l",
        "cards": [{"id": c, "front": f, "back": b} for c, f, b in [("a", "Haus", "house"), ("b", "Baum", ""), ("c", "Hund", "dog"), ("d", "Maus", "")]],
        "steps": [drill(0, prompt="Das Haus", accept=["house"]), drill(1, prompt="Baum und Haus?", card_ids=["d"]), drill(2, prompt="x", tiles=["Hund"], blanks=[{"accept": ["dog"]}])],
    }
    rows = typed(spark, x)
    found = {r.card_id: r for r in wiring.suggest(rows).collect()}
    assert set(found) == {"a", "b", "c"}
    assert found["a"].candidates == ["x0", "x1"] and found["a"].reason.startswith("ambiguous: verbatim match in 2 exercises")
    assert found["b"].suggestion_id == "b:x1" and [e.field for e in found["b"].evidence] == ["prompt"]
    assert [(e.field, e.card_side) for e in found["c"].evidence] == [("blanks[0].accept[0]", "back"), ("tiles[0]", "front")]
    wanted = spark.createDataFrame([("b:x1",), ("no:no",)], "suggestion_id string")
    done = wiring.apply_suggestions(rows, wiring.suggest(rows), wanted).first()
    assert done.lesson.steps[1].exercise.card_ids == ["d", "b"] and done.lesson.steps[0].exercise.card_ids is None and done.wired == 1
    assert [r[0] for r in wiring.unmatched(wanted, wiring.suggest(rows)).collect()] == ["no:no"]


def test_containment_by_first_characters(spark):
    cards = spark.createDataFrame([(1, "abc d"), (2, "b"), (3, ""), (4, "zz"), (5, "ünd")], "card_id long, text string")
    quotes = spark.createDataFrame([(1, "xabc d"), (2, "abcd"), (3, None), (4, "rund ründ z"), (5, "b\nabc dz z")], "exercise_id long, quote string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(wiring.keyed_containment(cards, quotes)) == rows(wiring.containment(F.broadcast(cards), quotes, [])) != []


def test_reports(spark):
    x = {"id": "l", "title": "T", "cards": [{"id": "a", "front": "Haus", "back": "h"}, {"id": "b", "front": "Q", "back": "q"}], "steps": [drill(0, prompt="Haus"), drill(1, prompt="x")]}
    (row,) = reports.wiring(wiring.suggest(typed(spark, x))).collect()
    assert row.lines == ["OK    p0: 1 suggestion(s), 1 card(s) for manual review", "  suggest a:x0", "    front 'Haus' appears in prompt: \"Haus\"", "  manual  b - no verbatim match in any exercise text field"]
    select = {"type": "cloze", "cloze_mode": "select", "sentence": "___", "blanks": [{"accept": ["x"]}], "distractors": ["y"]}
    rows = migrate.migrated_and_valid(typed(spark, {"id": "l", "title": "T", "steps": [drill(0, **select), drill(1, **(select | {"blanks": []}))]}, {"id": "m", "title": "T", "steps": [drill(0, **select)]}))
    one, two = [r.lines for r in reports.migration(rows).orderBy("path").collect()]
    assert one[0] == "ERROR p0: migrated lesson fails validation (not written)" and "[E-CLOZE-BLANKS]" in one[1]
    assert two == ["OK    p1: would convert 1 exercise(s)", "  converted x0"]
    minted = mint.mint(spark.createDataFrame([("p", '{"cards": [{"id": "a"}]}'), ("q", "{")], "path string, raw string"))
    assert [r.lines[0][:24] for r in reports.minting(minted).orderBy("path").collect()] == ["MINT p: 1 of 1 eligible ", "ERROR q: invalid JSON - "]
    assert reports.minting_total(minted).first()[0] == ["total: 1 stable_id(s) across 2 file(s)"]
    covered = spark.createDataFrame([("a", True), ("b", False)], "set string, covered boolean")
    lines = [r.line for r in reports.coverage(covered, identity.gate(covered, 1), 1).orderBy("ord").collect()]
    assert lines == ["stable-id coverage: 1 of 2 set(s) fully minted, baseline 1", "FAIL INCOMPLETE: 1 listed set(s) carry no complete stable_id coverage: b"]
    rows = spark.createDataFrame([("s", "a", "card", "card", "l", 0)], ELEMENT)
    files = spark.createDataFrame([("s", "l")], "set string, filename string")
    side = rows, files, rows.select("set", "stable_id").limit(0)
    gone = rows.limit(0), files, side[2]
    lines = [r.line for r in reports.stability(identity.checked(side, gone), identity.violations(side, gone)).orderBy("phase", "ord").collect()]
    assert lines[0].startswith("checked: 1 base id(s) / 0 head id(s), 1 base lesson(s) / 1 head") and lines[1] == "FAIL: 1 stability violation(s)" and lines[2].startswith("  V1 s: stable_id 'a'")


def test_parse_lessons(spark):
    raw = spark.createDataFrame([("s", json.dumps({"id": "l", "cards": [{"id": "c", "front": "f", "back": "b"}], "steps": [drill(0, type="matching", from_cards=True, card_ids=["c"])]}))], "set string, raw string")
    entries = spark.createDataFrame([("s", "de", "en", "math")], "set string, target_language string, source_language string, domain string")
    titled = lambda lesson: lesson.withField("title", F.lit("by an extension"))
    got = canonical.parse_lessons(raw, entries, resolvers=[titled]).first().lesson
    assert (got.domain, got.title, got.steps[0].exercise.pairs[0].right) == ("math", "by an extension", "b")


def test_migrate(spark):
    select = {"type": "cloze", "cloze_mode": "select", "sentence": "a ___", "blanks": [{"accept": ["x", "y"]}], "distractors": ["x", "z", "z"]}
    multi = {"type": "cloze", "cloze_mode": "multiselect", "sentence": "___", "prompt": "", "accept": ["x", "y"], "distractors": ["z"]}
    rows = typed(
        spark,
        {"id": "l", "title": "T", "steps": [drill(0, **select), drill(1, **multi), drill(2, **(select | {"blanks": []})), drill(3, accept=["a"])]},
        {"id": "m", "title": "T", "steps": [drill(0, **(select | {"distractors": ["z"]}))]},
    )
    one, two = migrate.migrated_and_valid(rows).orderBy("path").collect()
    assert [(c.id, c.status) for c in one.changes] == [("x0", "converted"), ("x1", "converted"), ("x2", "skipped")]
    assert one.changes[0].notes == ["dropped alternate accept 'y' (multiple_choice options have exactly one text)", "dropped distractor 'x' (equals a correct option)"]
    assert one.changes[2].reason.startswith("select with 0 blanks") and one.converted == 2
    first, second = one.lesson.steps[0].exercise, one.lesson.steps[1].exercise
    assert (first.type, first.prompt, first.sentence, [o.text for o in first.options]) == ("multiple_choice", "p\n\na ___", None, ["x", "z", "z"])
    assert (second.prompt, second.multiple, [o.correct for o in second.options]) == ("___", True, [True, True, None])
    assert not one.valid and {e.id for e in one.errors} == {"E-MC-DUP-OPTION", "E-CLOZE-BLANKS"}
    assert two.valid and "cloze" not in two.raw and "blanks" not in two.raw


def test_mint(spark):
    raw = '{\n  "id": "l",\n  "cards": [\n    {\n      "id": "a",\n      "front": "\\"id\\": {"\n    },\n    { "front": "x", "id": "b" },\n    { "id": "c", "stable_id": "kept-id-1" }\n  ],\n  "steps": [ { "id": "s", "exercise": { "id": "e", "card_ids": ["a", "b"], "pairs": [{"id": 1}] } }, { "id": "t" } ]\n}'
    rows = spark.createDataFrame([("p", raw), ("q", '{"cards": [{"front": "no id"}]}'), ("r", "{"), ("s", '{"id": "x"}'), ("t", '{"cards": [{"id": "a", "stable_id": ""}]}')], "path string, raw string")
    got = {r.path: r for r in mint.mint(rows).collect()}
    ok = got["p"]
    assert (ok.ok, ok.minted, ok.eligible) == (True, 3, 3)
    new = json.loads(ok.new_text)
    ids = [new["cards"][0]["stable_id"], new["cards"][1]["stable_id"], new["steps"][0]["exercise"]["stable_id"]]
    assert len(set(ids)) == 3 and all(8 <= len(i) <= 64 for i in ids) and new["cards"][2]["stable_id"] == "kept-id-1"
    assert f'"id": "a",\n      "stable_id": "{ids[0]}",\n      "front"' in ok.new_text and f'"id": "b", "stable_id": "{ids[1]}" }}' in ok.new_text
    assert ok.new_text == mint.mint_text("p", raw)[4]
    bare = ok.new_text
    for i in ids:
        bare = bare.replace(f'\n      "stable_id": "{i}",', "").replace(f', "stable_id": "{i}"', "")
    assert bare == raw
    assert not got["q"].ok and got["q"].error.startswith("incomplete mint: the scanner found 0 of 1")
    assert not got["r"].ok and got["s"].ok and got["s"].new_text is None and got["t"].minted == 1


def exercise(spark, payload, kind):
    return spark.createDataFrame([(json.dumps({"type": kind, "prompt": "P", "ext_payload": payload}),)], "raw string").select(F.from_json("raw", EXERCISE).alias("ex"))


def graded(spark, payload, kind, grade):
    return exercise(spark, payload, kind).select(grade(F.col("ex"))).first()[0]


def test_grading(spark):
    cats = {"categories": [{"name": "A", "items": ["x", "y"]}, {"name": "B", "items": ["z"]}]}
    put = lambda **m: F.create_map(*[F.lit(v) for kv in m.items() for v in kv])
    assert graded(spark, cats, "ext:ref-categorization", lambda e: extensions.grade_categorization(e, put(x="A", y="A", z="B", w="B")))
    assert not graded(spark, cats, "ext:ref-categorization", lambda e: extensions.grade_categorization(e, put(x="A", z="B")))
    fix = {"tokens": ["a", "b"], "error_index": 1, "accept": ["Bee"]}
    assert graded(spark, fix, "ext:ref-error-correction", lambda e: extensions.grade_error_correction(e, F.lit(1), F.lit(" bee ")))
    assert not graded(spark, fix, "ext:ref-error-correction", lambda e: extensions.grade_error_correction(e, F.lit(0), F.lit("bee")))
    assert graded(spark, fix, "ext:ref-error-correction", extensions.canonical_correction) == "Bee"
    heard = {"audio": "a.mp3", "accept": ["", "Guten Tag"]}
    assert graded(spark, heard, "ext:ref-dictation", lambda e: extensions.grade_text(e, "$.audio", F.lit("guten tag")))
    assert not graded(spark, heard, "ext:ref-dictation", lambda e: extensions.grade_text(e, "$.audio", F.lit("")))
    asked = {"passage": "p", "questions": [{"prompt": "q", "type": "multiple_choice", "options": [{"text": "A", "correct": True}, {"text": "B"}]}, {"prompt": "q", "type": "free_text", "accept": ["Ja"]}]}
    answers = lambda *a: F.array(*[F.lit(x) for x in a])
    assert tuple(graded(spark, asked, "ext:ref-reading-comprehension", lambda e: extensions.grade_reading(e, answers("A", "ja")))) == (2, 2)
    assert tuple(graded(spark, asked, "ext:ref-reading-comprehension", lambda e: extensions.grade_reading(e, answers("a")))) == (0, 2)


def test_quiz(spark):
    options = [{"text": t, "correct": t in "AB"} for t in "ABC"]
    one = {"prompt": "q", "type": "multiple_choice", "points": 4, "partial_credit": True, "options": options}
    two = {"prompt": "q", "type": "multiple_choice", "points": 2, "options": options}
    three = {"prompt": "q", "type": "free_text", "points": 1, "accept": ["ja"]}
    pick = lambda *lists: F.array(*[F.array(*[F.lit(x) for x in y]).cast("array<string>") for y in lists])
    grade = lambda payload, *lists: tuple(graded(spark, payload, "ext:ref-graded-quiz", lambda e: extensions.grade_quiz(e, pick(*lists))))
    quiz = {"questions": [one, two, three], "pass_threshold": 50}
    assert grade(quiz, ["A", "A"], ["B", "A"], [" JA"]) == (5.0, 7.0, True)
    assert grade(quiz, ["A", "C"], ["A"], []) == (0.0, 7.0, False)
    assert grade(quiz | {"questions": []}, []) == (0.0, 0.0, False)
    assert grade({"questions": [three]}, ["nein"]) == (0.0, 1.0, True)
    assert grade({"questions": [{"prompt": 1}]}, []) == (0.0, 0.0, False)


def test_render(spark):
    shown = lambda kind, payload: graded(spark, payload, kind, extensions.render)
    assert shown("ext:ref-ordering", {"items": ["a", "b"]}) == "P\n1. a\n2. b"
    assert shown("ext:ref-ordering", {"items": 1}) == "P"
    assert shown("ext:ref-categorization", {"categories": [{"name": "A", "items": ["x"]}, {"name": "B", "items": ["y"]}]}) == "P\nKategorien: A | B\nItems: x, y"
    quiz = {"questions": [{"prompt": "q", "type": "free_text", "points": 2.5}], "pass_threshold": 60}
    assert shown("ext:ref-graded-quiz", quiz) == "P\n1. q (2.5 P.)\nBestehensschwelle: 60%"
    assert shown("ext:ref-dictation", {"audio": "a", "accept": []}) == "P\n[audio] a"


YAML = """
name: Repo
schema_version: "1.11"
metadata: {note: no, lessons: [k-10.json, k-2.json, 3], retired_ids: [a, b, a, b, a]}
sets:
  - {id: de, title: Deutsch, language: no, level: a1, version: "1.10", lesson_count: 2}
  - {id: dogs, title: Dogs, target_language: de, domain: Dog-Training, level: none, version: "1", lesson_count: 0, path: x/dogs, visibility: hidden, review_status: odd, book: {title: " "}}
  - {id: odd, title: Odd, target_language: de, domain: odd, level: none of these, version: "2", lesson_count: 0, book: {title: B}}
"""


def test_manifests(spark):
    files = spark.createDataFrame([("a", YAML), ("b", ""), ("c", "a: [")], "path string, raw string")
    rows = {r.path: r for r in manifests.manifests(files).collect()}
    assert json.loads(rows["a"].raw)["sets"][0]["language"] == "no" and rows["b"].raw is None and rows["c"].error
    some = manifests.manifests(files).filter("path = 'a'").withColumn("source", F.lit("r")).withColumn("branch", F.lit("main"))
    cache = F.create_map(F.lit("de"), F.struct(F.lit("1.9").alias("version"), F.lit("t").alias("downloaded_at")))
    de, dogs, odd = canonical.set_entries(some.withColumn("cached", cache)).orderBy("id").collect()
    assert (de.target_language, de.language, de.source_language, de.domain, de.base_path, de.update_available, de.tags, de.visibility) == ("no", "no", "en", "language", "sets/de", True, [], "visible")
    assert (dogs.visibility, dogs.review_status, dogs.book, dogs.base_path, dogs.update_available, dogs.cached_version) == ("hidden", "authored", None, "x/dogs", False, None)
    assert odd.book.title == "B"
    fit = spark.createDataFrame([("a", YAML.replace("review_status: odd, ", ""))], "path string, raw string")
    judged = validate_manifests(manifests.manifests(fit).drop("manifest")).first()
    assert judged.valid
    assert [(i.id, i.path) for i in judged.issues] == [
        ("W-SET-ORDER-NUMERIC", "/metadata/lessons"), ("W-DOMAIN-UNKNOWN", "/sets/2/domain"), ("W-LEVEL-UNKNOWN", "/sets/2/level"), ("W-RETIRED-IDS-DUP", "/metadata/retired_ids"),
    ]
    assert "retired_ids lists 'a', 'b' more than once" in judged.issues[-1].message


def test_manifest_faults(spark):
    one = {"id": "a", "title": "t", "target_language": "de", "level": "A1", "version": "1", "lesson_count": 1}
    rows = [
        {"name": "r", "metadata": {"retired_ids": None}},
        {"name": "r", "metadata": {"retired_ids": ["a", 1]}},
        {"name": "r", "sets": [one | {"lesson_count": -1, "more": 1}]},
        {"name": "", "sets": []},
        {"name": "r", "metadata": {"x": 1}, "sets": [one]},
        {"name": "r", "metadata": {"retired_ids": []}},
    ]
    raw = spark.createDataFrame([(str(i), json.dumps(r)) for i, r in enumerate(rows)], "path string, raw string")
    got = [sorted({(i.id, i.path) for i in r.issues}) for r in validate_manifests(raw).orderBy("path").collect()]
    wrong = [("E-RETIRED-IDS-TYPE", "/metadata/retired_ids")]
    assert got == [wrong, wrong, [("E-SCHEMA", "/sets/0/lesson_count"), ("E-UNKNOWN-FIELD", "/sets/0")], [("E-SCHEMA", "/name")], [], []]


def test_vocabulary(spark):
    rows = spark.createDataFrame([(None, "a1 "), ("Math", "NONE"), (" math", "C3"), ("", "none")], "d string, l string")
    got = rows.select(known_domain(F.col("d")), known_level(F.col("d"), F.col("l"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (True, True), (False, False), (True, False)]


def test_context_and_cards(spark):
    rows = typed(spark, {"id": "a", "domain": "math"}, {"id": "b"}).withColumn("set", F.lit("s"))
    entries = spark.createDataFrame([("s", "de", "en", "language")], "set string, target_language string, source_language string, domain string")
    got = canonical.inject_context(rows, entries).orderBy("path").select("lesson.target_language", "lesson.source_language", "lesson.domain").collect()
    assert [tuple(r) for r in got] == [("de", "en", "math"), ("de", "en", "language")]
    cards = [{"id": "a", "front": "1", "back": "x"}, {"id": "b", "front": "2", "back": "y"}, {"id": "a", "front": "3", "back": "z"}]
    x = {"id": "l", "cards": cards, "steps": [drill(0, type="matching", from_cards=True, card_ids=["b", "no", "a", "b"]), drill(1, type="matching", from_cards=False, card_ids=["a"])]}
    done = typed(spark, x).select(canonical.resolve_from_cards(F.col("lesson")).alias("l")).first().l
    assert [(p.left, p.right) for p in done.steps[0].exercise.pairs] == [("2", "y"), ("3", "z"), ("2", "y")]
    assert done.steps[0].exercise.from_cards is None and done.steps[1].exercise.pairs is None


def item(body, more="", response='<correctResponse><value>A</value></correctResponse>', card="single", ident="i1"):
    return f'<q:assessmentItem xmlns:q="u" identifier="{ident}" title="Titel"><q:responseDeclaration identifier="RESPONSE" cardinality="{card}">{response.replace("<", "<q:").replace("<q:/", "</q:")}</q:responseDeclaration><q:itemBody>{body}</q:itemBody>{more}</q:assessmentItem>'


def test_qti_import(spark):
    choice = '<q:choiceInteraction responseIdentifier="RESPONSE"><q:prompt>Wä <q:b>s</q:b>?</q:prompt><q:simpleChoice identifier="A"> ja </q:simpleChoice><q:simpleChoice identifier="B">nein</q:simpleChoice></q:choiceInteraction>'
    entry = '<q:p>Hauptstadt?</q:p><q:textEntryInteraction/>'
    keys = '<correctResponse><value>Bern</value></correctResponse><mapping><mapEntry mapKey="bern"/></mapping>'
    match = '<q:matchInteraction responseIdentifier="RESPONSE"><q:simpleMatchSet><q:simpleAssociableChoice identifier="L">l</q:simpleAssociableChoice></q:simpleMatchSet><q:simpleMatchSet><q:simpleAssociableChoice identifier="R">r</q:simpleAssociableChoice></q:simpleMatchSet></q:matchInteraction>'
    test = f'<assessmentTest identifier="t1" title="Test">{item(choice)}{item(entry, response=keys, ident="i2")}{item(match, response="<correctResponse><value>L R</value></correctResponse>", ident="i3")}</assessmentTest>'
    docs = {
        "ok": test, "multi": item(choice, card="multiple"), "order": item("<q:orderInteraction/>"), "none": "<assessmentTest/>", "bad": "<", "two": item(choice + entry), "empty": item("x"), "lone": "<assessmentItem/>",
    }
    got = {r.path: r for r in qti.import_qti(spark.createDataFrame(list(docs.items()), "path string, xml string")).collect()}
    ok = json.loads(got["ok"].raw)
    assert (ok["id"], ok["title"]) == ("t1", "Test")
    a, b, c = [s["exercise"] for s in ok["steps"]]
    assert (a["type"], a["prompt"], a["options"]) == ("multiple_choice", "Wä s?", [{"text": "ja", "correct": True}, {"text": "nein"}])
    assert (b["type"], b["prompt"], b["accept"]) == ("free_text", "Hauptstadt?", ["Bern", "bern"])
    assert (c["type"], c["prompt"], c["pairs"]) == ("matching", "Titel", [{"left": "l", "right": "r"}])
    assert json.loads(got["multi"].raw)["steps"][0]["exercise"]["multiple"] is True
    assert "i1: orderInteraction (unsupported QTI interaction)" in got["order"].error and got["none"].error.endswith("contains no assessmentItem elements")
    assert got["bad"].error.endswith("no root element") and "choiceInteraction+textEntryInteraction" in got["two"].error and "no interaction element found" in got["empty"].error
    assert "assessmentItem has no itemBody" in got["lone"].error and not any(got[p].ok for p in docs if p not in ("ok", "multi"))


def test_qti_round_trip(spark):
    x = {
        "id": "l-1",
        "title": 'A & "B" <ü>',
        "steps": [
            {"id": "t", "type": "theory", "body": "b"},
            drill(0, type="multiple_choice", multiple=True, prompt="x < y & z", options=[{"text": "a&b", "correct": True}, {"text": "<c>"}]),
            drill(1, accept=["ja", 'j"a', "j&a"]),
            drill(2, type="matching", pairs=[{"left": "1", "right": "eins"}, {"left": "2", "right": "zwei"}]),
        ],
    }
    out = qti.export_qti(typed(spark, x, {"id": "m", "title": "t", "steps": [drill(0, type="word_tiles")]})).orderBy("path").collect()
    assert out[1].xml is None and out[1].unmappable == ["x0"] and out[1].error.endswith("x0 (word_tiles)")
    back = qti.import_qti(spark.createDataFrame([("p", out[0].xml)], "path string, xml string")).first()
    assert back.ok, back.error
    got = json.loads(back.raw)
    assert (got["id"], got["title"]) == (x["id"], x["title"])
    assert [s["exercise"] for s in got["steps"]] == [s["exercise"] for s in x["steps"][1:]]


def test_parity_and_conformance(spark):
    names = lambda col, *xs: spark.createDataFrame([(x,) for x in xs], f"{col} string")
    got = parity.release_gaps(names("tag", "v0.1.0", "v1.0.0", "v1.0.0\n", "x", "v2.0.0"), names("tag", "v1.0.0"), names("version", "2.0.0"))
    assert sorted(map(tuple, got.collect())) == [("v0.1.0", "page"), ("v1.0.0", "version"), ("v2.0.0", "page")]
    rows = typed(spark, {"id": "l", "title": "T", "steps": [drill(i, type="matching") for i in range(6)]}, {"id": "m", "title": "T", "steps": [drill(0, accept=["a"])]}).drop("lesson")
    judged = validate_lessons(rows).withColumn("repo", F.lit("r")).withColumn("set", F.lit("s"))
    row = conformance.summary(names("repo", "r", "q"), judged).first()
    assert (row.repos, row.lessons, row.invalid, row.empty_repos, row.ok) == (1, 2, 1, 1, False)
    assert conformance.discrepancies(judged).count() == 4
    assert [tuple(r) for r in conformance.exercises_by_type(judged).collect()] == [("free_text", 1), ("matching", 6)]
    shown = [r.lines for r in reports.lint(judged).orderBy("path").collect()]
    assert shown[0][0] == "ERROR p0" and shown[0][1].startswith("  [E-MATCH-PAIRS] /steps/0/exercise MATCHING") and shown[0][1].endswith("(see matching)") and shown[1] == ["OK    p1"]
    assert reports.failed(judged, "valid").first()[0] == 1


def test_files_and_stream(spark, tmp_path):
    from coursewright.streaming.landing import judge

    root = tmp_path / "tree"
    (root / "sets/a/de/lessons").mkdir(parents=True)
    lesson = {"id": "l", "title": "T", "cards": [{"id": "c", "front": "f", "back": "b", "stable_id": "id-12345"}], "steps": [drill(0, accept=["a"])]}
    (root / "sets/a/de/lessons/01.json").write_text(json.dumps(lesson))
    (root / "sets/a/de/manifest.yaml").write_text("name: x")
    files = source.read_raw(spark, str(root), "*").withColumn("name", source.relative(F.col("path"), str(root)))
    lessons, sets = source.snapshot(files)
    assert [tuple(r) for r in lessons.select("set", "filename", "lesson.id").collect()] == [("sets/a/de", "01.json", "l")] and sets.count() == 1
    wanted = spark.createDataFrame([("sets/a/de/lessons/01.json",), ("no.json",)], "name string")
    got = {r.name: r.error for r in source.read_wanted(spark, str(root), wanted).collect()}
    assert got == {"sets/a/de/lessons/01.json": None, "no.json": "no such file: no.json"}
    judge(spark, str(root / "sets/a/de/lessons"), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    assert [r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["W-CARD-UNUSED"]


def test_schemas_parse(spark):
    for ddl in (LESSON, MANIFEST, EXERCISE):
        assert spark.sql("SELECT '{}' AS raw").select(F.from_json("raw", ddl)).first()[0] is not None
