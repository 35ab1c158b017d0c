"""Every operator on odd rows and on no rows."""

import pytest

from coursewright.llm import decontaminate, fingerprints, langid, licenses, mixing, neardup, passages, sharding, toxicity


def items(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "the cat sat on the mat and the dog"), (None, "x")], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(1, None, 1), (2, 1, None), (8, 1, 0), (8, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


PER_ROW = {
    "fingerprints": lambda spark, d: fingerprints.query(d),
    "licenses": lambda spark, d: licenses.query(d),
    "sharding": lambda spark, d: sharding.query(d),
    "neardup": lambda spark, d: neardup.query(d),
    "langid": lambda spark, d: langid.query(d),
    "toxicity": lambda spark, d: toxicity.query(d, labels(spark)),
    "mixing": lambda spark, d: mixing.query(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_a_row_for_each_row(spark, odd, name):
    got = PER_ROW[name](spark, odd)
    rows = got.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in odd.collect())
    assert len({tuple(r) for r in rows if r.doc_id == 1 and name in ("licenses", "langid", "toxicity", "neardup")}) < 2
    none = PER_ROW[name](spark, odd.limit(0))
    assert none.collect() == [] and none.columns == got.columns


def test_operators_that_find(spark, odd):
    assert {(r.doc_id, r.item_id) for r in decontaminate.query(odd, items(spark)).collect()} == {(8, 3)}
    assert decontaminate.query(odd, items(spark).limit(0)).count() == 0 and decontaminate.query(odd.limit(0), items(spark)).count() == 0
    assert passages.query(odd).count() == 0 and passages.query(odd.limit(0)).count() == 0


def test_filters_keep_columns(spark, odd):
    dictionaries = langid.learn(odd)
    for kept in (langid.accepted(odd, dictionaries), neardup.representatives(odd), decontaminate.clean(odd, items(spark)), mixing.mixed(odd)):
        assert kept.schema.names == odd.schema.names
        assert kept.count() <= 2 * odd.count()
    assert neardup.representatives(odd).filter("doc_id = 1").count() == 1
    assert neardup.representatives(odd.limit(0)).count() == 0 and langid.accepted(odd.limit(0), []).count() == 0
