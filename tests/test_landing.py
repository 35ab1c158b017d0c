import json

from coursewright.streaming import landing


def lesson(*ids):
    return json.dumps({"id": "l", "title": "T", "cards": [{"id": f"c{i}", "front": "f", "back": "b", "stable_id": x} for i, x in enumerate(ids)], "steps": []})


BATCHES = [
    [("a/b/c/lessons/2.json", lesson("one", "two")), ("a/b/d/lessons/1.json", lesson("one"))],
    [("a/b/c/lessons/3.json", lesson("two", "three")), ("a/b/c/lessons/4.json", "{"), ("a/b/c/lessons/5.json", lesson(None, ""))],
    [("a/b/c/lessons/1.json", lesson("two", "three", "three")), ("a/b/d/lessons/2.json", lesson("four"))],
]
SCHEMA = "name string, raw string"


def rows(df):
    return sorted((r["set"], r.stable_id, r.n, r["first"].lesson, r["first"].element) for r in df.collect())


def test_batches_give_what_one_batch_gives(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("lessons", "out", "state"))
    whole = landing.repeated_ids(spark.createDataFrame(sum(BATCHES, []), SCHEMA))
    want = [("a/b/c", "three", 3, "1.json", "c1"), ("a/b/c", "two", 3, "1.json", "c0")]
    assert rows(whole) == want
    seen = []
    for batch in BATCHES:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        landing.watch_ids(stream, out, state).awaitTermination()  # starts again from its checkpoint
        seen.append([r[:3] for r in rows(landing.repeated_so_far(spark, out))])
    assert seen[:2] == [[], [("a/b/c", "two", 2)]] and rows(landing.repeated_so_far(spark, out)) == want
