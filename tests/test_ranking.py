import random

import pytest
from pyspark.sql import functions as F

from coursewright.operators.ranking import ranked


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_places_are_those_of_a_sort(spark, parts):
    rng = random.Random(parts)
    # one group of a third of all rows, many small ones, nulls, ties and repeated rows
    rows = [(None if rng.random() < 0.1 else "hot" if rng.random() < 0.33 else f"s{rng.randrange(60)}", rng.randrange(50), i % 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "set string, v long, other long").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = ranked(df, ["set"], [F.col("v").desc(), F.col("other")]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    by: dict = {}
    for r in got:
        by.setdefault(r["set"], []).append((r["rank"], -r.v, r.other))
    want: dict = {}
    for s, v, o in rows:
        want.setdefault(s, []).append((-v, o))
    assert {s: [x[1:] for x in sorted(xs)] for s, xs in by.items()} == {s: sorted(xs) for s, xs in want.items()}
    assert all([x[0] for x in sorted(xs)] == list(range(1, len(xs) + 1)) for xs in by.values())


def test_without_groups_and_without_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = ranked(df, [], ["v"], "at")
    assert got.columns == ["v", "at"] and all(r["at"] == r.v + 1 for r in got.collect())
    equal = ranked(spark.range(500).select(F.lit(1).alias("v")), [], ["v"]).collect()
    assert sorted(r["rank"] for r in equal) == list(range(1, 501))
    assert ranked(df.limit(0), [], ["v"]).collect() == []
    assert "Window" not in ranked(df, ["v"], ["v"])._jdf.queryExecution().optimizedPlan().toString()
