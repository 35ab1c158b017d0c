from pyspark.sql import functions as F

import corpus_pipeline
from coursewright.llm import decontaminate, langid, mixing, neardup, sharding
from coursewright.llm.common import documents, table
from tests.llm.conftest import SF
from tests.llm.test_neardup import brute_force


def test_stages_and_run(spark):
    docs = documents(spark, SF)
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "shards":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
            sizes.append(docs.count())
    rows = sorted(map(tuple, out.collect()), key=str)
    assert sizes[0] > sizes[1] > 0.9 * sizes[0] or sizes[0] == sizes[1]
    assert rows == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()), key=str)


def test_run_is_that_of_plain_steps(spark):
    """The same decisions, made on plain rows: language and classes by brute force, the mix by its query."""
    docs = documents(spark, SF)
    dictionaries = langid.learn(docs)
    told = {r.doc_id for r in langid.predict(docs, dictionaries, ["doc_id"]).collect() if not r.rejected}
    rows = [r for r in docs.orderBy("doc_id").collect() if r.doc_id in told]
    kept = spark.createDataFrame(rows, docs.schema)
    first = brute_force([r.text for r in rows], neardup.common_shingles(kept))
    rows = [r for i, r in enumerate(rows) if first[i] == i]
    leaks = {r.doc_id for r in decontaminate.query(spark.createDataFrame(rows, docs.schema), table(spark, SF, "benchmark")).collect()}
    rows = [r for r in rows if r.doc_id not in leaks]
    mixed = mixing.mixed(spark.createDataFrame(rows, docs.schema))
    want = sharding.query(mixed).select("doc_id", "size", "text_crc32", "shard").collect()
    got = corpus_pipeline.run(spark, SF).select("doc_id", "size", "text_crc32", "shard").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_no_rows(spark):
    none = documents(spark, SF).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_odd_rows(spark, odd):
    """Nulls in all columns, empty, blank and very long texts, repeated rows and ids, clashing columns: through all stages."""
    learned = documents(spark, SF).limit(100)
    for c in odd.columns:
        if c not in learned.columns:
            learned = learned.withColumn(c, F.lit("y"))
    docs = odd.unionByName(learned.withColumn("doc_id", F.col("doc_id") + 1000)).repartition(3)
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "shards":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
            kept.append({r.doc_id for r in docs.collect()})
    assert not {3, 4, 5, 7} & kept[0]  # null, empty, blank, without a letter
    texts = [r.text for r in docs.collect()]
    assert all(texts) and sorted(r.slot for r in out.filter("shard = 0").collect()) == list(range(out.filter("shard = 0").count()))
    assert len({r.doc_id for r in out.collect()} - kept[3]) == 0
