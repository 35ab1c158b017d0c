"""Files that no reader can take: a fault of their row, and nothing else stops."""

import json

from coursewright.operators.mint import mint
from coursewright.plans.validate import validate_lessons, validate_manifests
from coursewright.sources.manifests import manifests
from coursewright.sources.qti import import_qti

GOOD = json.dumps({"id": "a", "title": "t", "steps": [{"id": "s", "type": "theory", "body": "b"}]})
DEEP = "[" * 200_000 + "]" * 200_000


def test_lessons(spark):
    rows = [("good", GOOD), ("infinite", GOOD[:-1] + ', "estimated_minutes": 1e999}'), ("deep", DEEP), ("deep hidden", GOOD[:-1] + ', "x": ' + DEEP + "}"), ("no", None), ("cut", GOOD[:20])]
    judged = {r.path: r for r in validate_lessons(spark.createDataFrame(rows, "path string, raw string")).select("path", "valid", "issues").collect()}
    assert [p for p, r in judged.items() if r.valid] == ["good"]
    assert [(i.id, i.path) for i in judged["infinite"].issues] == [("E-SCHEMA", "/estimated_minutes")]
    assert all(i.id == "E-SCHEMA" for p in ("deep", "deep hidden") for i in judged[p].issues or [])


def test_manifests(spark):
    rows = [("good", json.dumps({"name": "m"})), ("deep", DEEP), ("infinite", '{"name": "m", "sets": [{"lesson_count": 1e999}]}')]
    judged = {r.path: r.valid for r in validate_manifests(spark.createDataFrame(rows, "path string, raw string")).select("path", "valid").collect()}
    assert judged == {"good": True, "deep": False, "infinite": False}


def test_yaml(spark):
    laughs = "a0: &a0 [x, x]\n" + "".join(f"a{i}: &a{i} [*a{i - 1}, *a{i - 1}, *a{i - 1}, *a{i - 1}]\n" for i in range(1, 30))
    rows = [("good", "name: m"), ("binary", "name: !!binary aGVsbG8="), ("deep", "[" * 5000 + "]" * 5000), ("laughs", laughs), ("itself", "&a [*a]"), ("nan", "name: .nan"), ("none", None), ("key", "? [a]\n: b")]
    found = {r.path: r for r in manifests(spark.createDataFrame(rows, "path string, raw string")).collect()}
    assert {p for p, r in found.items() if r.error} == {"binary", "deep", "laughs", "itself", "nan", "key"}
    assert found["good"].manifest.name == "m" and found["none"].raw is None


def test_qti(spark):
    item = '<assessmentItem identifier="i"><itemBody><p>{}</p><textEntryInteraction/></itemBody></assessmentItem>'
    rows = [("good", item.format("x")), ("entity", '<!DOCTYPE x [<!ENTITY a "aaaa">]>' + item.format("&a;")), ("deep", "<a>" * 100_000 + "</a>" * 100_000), ("no", None)]
    found = {r.path: r.error for r in import_qti(spark.createDataFrame(rows, "path string, xml string")).collect()}
    assert found["entity"] == found["no"] == "QTI document has no root element" and found["deep"]


def test_mint(spark):
    rows = [("good", json.dumps({"cards": [{"id": "c"}]})), ("deep", DEEP), ("list", "[1]"), ("no", None)]
    assert {r.path for r in mint(spark.createDataFrame(rows, "path string, raw string")).collect() if not r.ok} == {"deep", "list", "no"}
