import re

import pytest

from coursewright.operators import identity
from coursewright.plans import catalog, catalog_jobs
from coursewright.sources import snapshots

SF = "/root/testdata/sf0.001"


@pytest.fixture
def without_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)
    spark.conf.set(snapshots.CO_PARTITION, "true")


def exchanges(df):
    return re.findall(r"Exchange \w+", df._jdf.queryExecution().executedPlan().toString())


def test_stored_snapshots_are_compared_without_a_shuffle(spark, without_broadcast):
    live = identity.violations(*catalog.snapshots(spark, SF))
    stored = identity.violations(*catalog_jobs.stored_snapshots(spark, SF))
    assert exchanges(live) and not exchanges(stored)
    rows = lambda df: sorted(map(tuple, df.select("rule", "set", "message").collect()))
    assert rows(stored) == rows(live) and {r[0] for r in rows(live)} >= {"V1", "V3", "V4", "V5", "V6"}


def test_a_snapshot_is_never_written_over(spark, tmp_path):
    base, _ = catalog.snapshots(spark, SF)
    snapshots.write_snapshot(base, "one", str(tmp_path), buckets=2)
    with pytest.raises(Exception, match="one_elements"):
        snapshots.write_snapshot(base, "one", str(tmp_path), buckets=2)
    assert [df.count() for df in snapshots.open_snapshot(spark, "one")] == [df.count() for df in base]
    snapshots.drop_snapshot(spark, "one", str(tmp_path))
    assert not list(tmp_path.iterdir()) and not spark.catalog.tableExists("one_elements")
    spark.conf.set(snapshots.CO_PARTITION, "true")


def test_the_first_other_kind_of_a_repeated_id(spark):
    key = "set string, stable_id string, kind string, type string, ord long"
    base = spark.createDataFrame([("s", "a", "card", "card", 0), ("s", "a", "card", "card", 0), ("s", "b", "exercise", "cloze", 1), ("s", "c", "card", None, 2), (None, "a", "card", "card", 3)], key)
    head = spark.createDataFrame([("s", "a", "card", "card", 9), ("s", "a", "exercise", "z", 5), ("s", "a", "exercise", "y", 7), ("s", "b", "exercise", "cloze", 1), ("s", "c", "card", "card", 1), ("t", "b", "card", "card", 0)], key)
    got = sorted(tuple(r) for r in identity.moved(base, head).collect())
    assert got == [("s", "a", "card", "card", 0, "exercise", "z")] * 2
