import json

import pytest

from coursewright import jobs


def drill(i, **kw):
    return {"id": f"s{i}", "type": "exercise", "exercise": {"id": f"x{i}", "type": "free_text", "prompt": "p", "accept": ["a"], **kw}}


def tree(root, lessons, retired=(), listed=None):
    home = root / "sets/a/de"
    (home / "lessons").mkdir(parents=True)
    for name, x in lessons.items():
        (home / "lessons" / name).write_text(x if isinstance(x, str) else json.dumps(x))
    (home / "manifest.yaml").write_text(json.dumps({"name": "x", "metadata": {"retired_ids": list(retired), "lessons": list(listed or lessons)}}))
    (root / "manifest.yaml").write_text("name: r\nsets:\n  - {id: de, path: sets/a/de}\n  - {id: no}\n")
    return str(root)


CARDS = [{"id": "c", "front": "Haus", "back": "house", "stable_id": "id-00001"}]


def run(spark, capsys, *argv):
    code = jobs.main(list(argv), spark)
    return code, capsys.readouterr().out.splitlines()


def test_lint_and_mint(spark, tmp_path, capsys):
    where = tree(tmp_path / "t", {"1.json": {"id": "l", "title": "T", "steps": [drill(0)]}, "2.json": "{"})
    code, lines = run(spark, capsys, "lint", where)
    assert code == 1 and lines[0].startswith("OK    ") and lines[1].endswith("2.json: invalid JSON - not JSON")
    code, lines = run(spark, capsys, "mint", where, "--write", "--out", str(tmp_path / "minted"))
    assert code == 1 and "total: 1 stable_id(s) across 2 file(s)" in lines
    assert spark.read.parquet(str(tmp_path / "minted")).count() == 1


def test_migrate_and_wiring(spark, tmp_path, capsys):
    select = {"type": "cloze", "cloze_mode": "select", "sentence": "das Haus ___", "accept": None, "blanks": [{"accept": ["x"]}], "distractors": ["y"]}
    where = tree(tmp_path / "t", {"1.json": {"id": "l", "title": "T", "cards": CARDS, "steps": [drill(0, **select)]}})
    code, lines = run(spark, capsys, "migrate", where)
    assert code == 0 and "would convert 1 exercise(s)" in lines[0] and lines[-1].startswith("dry run")
    code, lines = run(spark, capsys, "suggest-wiring", where)
    assert code == 0 and "  suggest c:x0" in lines
    code, lines = run(spark, capsys, "suggest-wiring", where, "--write", "--out", str(tmp_path / "w"), "--accept", "c:x0", "--accept", "no:no")
    assert code == 1 and lines[-1].startswith("ERROR --accept no:no")
    assert json.loads(spark.read.parquet(str(tmp_path / "w")).first()["text"])["steps"][0]["exercise"]["card_ids"] == ["c"]
    for argv in (["migrate", where, "--write"], ["suggest-wiring", where, "--accept", "a"], ["nothing"]):
        with pytest.raises(SystemExit):
            jobs.arguments(argv)


def test_snapshots_and_coverage(spark, tmp_path, capsys):
    one = {"id": "l", "title": "T", "cards": CARDS, "steps": [drill(0, stable_id="id-00002")]}
    base = tree(tmp_path / "base", {"1.json": one})
    same = tree(tmp_path / "same", {"1.json": one})
    gone = tree(tmp_path / "gone", {"1.json": one | {"cards": []}, "2.json": {"id": "m", "title": "T", "steps": [drill(0)]}}, listed=["1.json", "3.json"])
    ok = tree(tmp_path / "ok", {"1.json": one | {"cards": []}}, retired=["id-00001"])
    none = tree(tmp_path / "none", {})
    assert run(spark, capsys, "check-stable-ids", base, same)[0] == 0
    code, lines = run(spark, capsys, "check-stable-ids", base, gone)
    assert code == 1 and lines[1] == "FAIL: 1 stability violation(s)" and lines[2].startswith("  V1 sets/a/de: stable_id 'id-00001' (card in 1.json)")
    assert run(spark, capsys, "check-stable-ids", base, ok)[0] == 0
    assert run(spark, capsys, "check-stable-ids", base, none)[1][-1].startswith("FAIL: the base carries lessons")
    assert run(spark, capsys, "check-stable-ids", none, base)[0] == 1
    assert run(spark, capsys, "check-stable-ids", none, base, "--allow-empty-base")[0] == 0
    assert run(spark, capsys, "check-stable-id-coverage", base, "--baseline", "1") == (0, ["stable-id coverage: 1 of 1 set(s) fully minted, baseline 1", "ok: every listed set is fully minted and the baseline matches"])
    code, lines = run(spark, capsys, "check-stable-id-coverage", gone)
    assert code == 1 and lines[1] == "FAIL INCOMPLETE: 1 listed set(s) carry no complete stable_id coverage: sets/a/de"


def test_rewrites_keep_what_they_do_not_change(spark, tmp_path, capsys):
    select = {"id": "e", "type": "cloze", "prompt": "q", "hint": None, "cloze_mode": "select", "sentence": "a ___", "blanks": [{"accept": ["x"]}], "distractors": ["y"], "card_ids": ["c"]}
    ext = {"id": "x", "type": "ext:a-b", "prompt": "p", "ext_payload": {"z": 1.50, "a": None}}
    lesson = {"title": "T", "id": "l", "cards": CARDS, "steps": [{"id": "s1", "type": "exercise", "exercise": select}, {"id": "s2", "type": "theory", "body": "b"}], "description": None}
    where = tree(tmp_path / "t", {"1.json": lesson})
    code, _ = run(spark, capsys, "migrate", where, "--write", "--out", str(tmp_path / "out"))
    text = next(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect())
    new = json.loads(text)
    assert code == 1 or code == 0
    assert list(new) == list(lesson) and new["description"] is None and new["steps"][1] == lesson["steps"][1] and new["cards"] == lesson["cards"]
    assert new["steps"][0]["exercise"] == {"id": "e", "type": "multiple_choice", "prompt": "q\n\na ___", "hint": None, "card_ids": ["c"], "options": [{"text": "x", "correct": True}, {"text": "y"}]}
    assert text == json.dumps(new, ensure_ascii=False, indent=2) + "\n" and ext["ext_payload"]["a"] is None


def test_the_baseline_of_a_file(spark, tmp_path, capsys):
    where = tree(tmp_path / "t", {"1.json": {"id": "l", "title": "T", "steps": [drill(0)]}})
    (tmp_path / "baseline.txt").write_text("7\n")
    (tmp_path / "odd.txt").write_text("seven")
    code, lines = run(spark, capsys, "check-stable-id-coverage", where, "--baseline-file", str(tmp_path / "baseline.txt"))
    assert code == 1 and any("below baseline 7" in line for line in lines)
    code, lines = run(spark, capsys, "check-stable-id-coverage", where, "--baseline-file", str(tmp_path / "odd.txt"))
    assert code == 2 and lines == [f"the baseline in {tmp_path / 'odd.txt'} is not a number"]
    assert run(spark, capsys, "check-stable-id-coverage", where, "--baseline-file", str(tmp_path / "none.txt"), "--baseline", "3")[0] == 1


def test_files_are_written_back_as_files(spark, tmp_path, capsys):
    select = {"type": "cloze", "cloze_mode": "select", "sentence": "das Haus ___", "accept": None, "blanks": [{"accept": ["x"]}], "distractors": ["y"]}
    lessons = {"1.json": {"id": "l", "title": "T", "cards": CARDS, "steps": [drill(0, **select)]}, "2.json": {"id": "m", "title": "T", "steps": [drill(0)]}}
    where = tree(tmp_path / "t", lessons)
    code, _ = run(spark, capsys, "migrate", where, "--write", "--files", "--out", str(tmp_path / "m"))
    made = {str(p.relative_to(tmp_path / "m")): p.read_text() for p in (tmp_path / "m").rglob("*") if p.is_file()}
    assert code == 0 and list(made) == ["sets/a/de/lessons/1.json"]  # the other needs no change
    text = made["sets/a/de/lessons/1.json"]
    assert text.endswith("}\n") and json.loads(text)["steps"][0]["exercise"]["type"] == "multiple_choice"
    run(spark, capsys, "mint", where, "--write", "--files", "--out", str(tmp_path / "n"))
    minted = tmp_path / "n/sets/a/de/lessons/2.json"
    assert "stable_id" in minted.read_text() and len([p for p in (tmp_path / "n").rglob("*") if p.is_file()]) == 2
    run(spark, capsys, "suggest-wiring", where, "--write", "--files", "--out", str(tmp_path / "w"), "--accept", "c:x0")
    assert json.loads((tmp_path / "w/sets/a/de/lessons/1.json").read_text())["steps"][0]["exercise"]["card_ids"] == ["c"]


def test_quality_job(spark, tmp_path, capsys):
    theory = {"id": "t", "type": "theory", "body": "b"}
    good = {"id": "l", "title": "T", "steps": [theory, *[drill(i, accept=["a", "b"]) for i in range(4)], drill(5, type="matching", pairs=[{"left": x, "right": x} for x in "abc"])]}
    where = tree(tmp_path / "t", {"1.json": good, "2.json": good | {"steps": [theory]}, "3.json": "{"})
    code, lines = run(spark, capsys, "quality", where)
    assert code == 1 and lines[-3:] == ["3 lesson(s), 1 with all minimums, 1 unread", "minExerciseTypes: 1 lesson(s) short", "minExercisesPerLesson: 1 lesson(s) short"]
    assert lines[0].startswith("SHORT ") and lines[1] == "  minExerciseTypes at /steps: 0 of 2" and "  cannot be read" in lines
    (tmp_path / "own.json").write_text(json.dumps({"rules": {"minTheorySteps": 1}}))
    one = tree(tmp_path / "u", {"1.json": good})
    assert run(spark, capsys, "quality", one, "--minimums", str(tmp_path / "own.json")) == (0, ["1 lesson(s), 1 with all minimums, 0 unread"])
