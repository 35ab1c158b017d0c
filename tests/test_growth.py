"""Work of a row is done once and by all tasks, however the rows are filed."""

from pathlib import Path

import pytest
import yaml

from coursewright.operators import wiring
from coursewright.plans import catalog, catalog_content, catalog_jobs, catalog_lessons
from coursewright.scratch import shared_dir
from coursewright.sources import manifests
from coursewright.streaming import landing

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("rows", [catalog_content.yaml_manifests, catalog_lessons.manifests, catalog_lessons.graded_exercises, catalog_content.wiring_lessons, catalog_content.qti_documents])
def test_one_file_is_work_for_all_tasks(spark, rows):
    assert rows(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_lesson_is_read_once_a_row(spark):
    for name in ("q22_from_cards", "q38_suggestions"):
        assert plan_of(catalog.QUERIES[name](spark, SF)).count("from_json(") == 1
    assert plan_of(landing.repeated_ids(catalog_jobs.customer_lessons(spark, SF))).count("from_json(") == 1
    assert plan_of(catalog_lessons.graded_exercises(spark, SF).selectExpr("asked.ext_payload AS a", "asked.ext_payload AS b")).count("parse_json(") <= 4
    assert plan_of(catalog_lessons.manifest_issues(spark, SF)).count("try_parse_json") <= 1


def test_terms_of_a_matching_are_folded_once(spark):
    assert plan_of(catalog.order_issues(spark, SF)).count("regexp_replace(") == 1


def test_plain_yaml_is_read_alike_by_libyaml(monkeypatch):
    texts = ["a: 1\nb:\n  - x\n  - y: no\n    z: 0x1F\n", "t: >-\n  one\n  two\n", 'v: "1.10"', "", "a: b: c", "t: >#x\n", "x: [1, 2", "k: 'it''s'\n", "- - - - a\n", "n: ~\nd: 2024-01-01\n"]
    seen, real = [], yaml.load
    monkeypatch.setattr(yaml, "load", lambda text, loader: seen.append(loader is manifests.loader(True)) or real(text, loader))
    got = [manifests.to_json(t) for t in texts]
    assert sum(seen) == 7 and [i for i, t in enumerate(texts) if manifests.ODD.search(t)] == [5, 6, 8]
    monkeypatch.setattr(manifests, "loaded", lambda text: real(text, manifests.loader()))
    assert got == [manifests.to_json(t) for t in texts]


def test_hits_of_short_cards_go_on_in_bounded_batches(spark, monkeypatch):
    cards = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "card_id long, text string")
    quotes = spark.createDataFrame([(7, "a b"), (7, "a"), (8, None), (9, "b")], "exercise_id long, quote string")
    monkeypatch.setattr(wiring, "HITS", 1)
    found = wiring.contained_short(cards, quotes, 3, 3)
    assert sorted(map(tuple, found.collect())) == [(1, 7, 2), (2, 7, 1), (2, 9, 1), (3, 7, 2)]
    assert "hashpartitioning(card_id" not in found._jdf.queryExecution().executedPlan().toString()  # counted where an exercise's hits meet


def test_landed_lessons_are_written_by_all_tasks(spark):
    before = set(Path(shared_dir(spark).removeprefix("file:")).glob("landed-*"))
    catalog_jobs.landed_ids(spark, SF)
    (new,) = set(Path(shared_dir(spark).removeprefix("file:")).glob("landed-*")) - before
    assert len(list(new.glob("lessons/*.parquet"))) > 3 and len(list(new.glob("changes/batch=*"))) == 3
