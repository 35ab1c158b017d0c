import hashlib
import math
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from coursewright.llm import importance
from coursewright.llm.common import table
from tests.duck import same
from tests.llm.conftest import SF

COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]


def features(text):
    words = re.findall(importance.WORD, (text or "").translate(str.maketrans(importance.UPPER, importance.LOWER)))
    grams = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), Counter(zlib.crc32(g.encode()) % importance.BUCKETS for g in grams)


def plain(docs, target):
    """Rows from (doc_id, text) and texts of the target."""
    found = [(i, *features(t)) for i, t in docs]
    s = sum((f for _, _, f in found), Counter())
    t = sum((features(x)[1] for x in target), Counter())
    all_s, all_t = (sum(x.values()) + importance.BUCKETS for x in (s, t))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t)))
    rows = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(b) * k for b, k in f.items())
        rows.append([i, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    can = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(can[: 5 * len(can) // 100], 1):
        r[4] = place
    return [tuple(r[:5]) for r in rows]


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_gives_the_plain_rows(spark, docs):
    target = table(spark, SF, "benchmark")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert rows_of(importance.query(docs.repartition(7), target)) == sorted(want, key=str)
    assert sum(r[4] is not None for r in want) > 5


def test_query_gives_the_rows_of_its_sql(spark):
    same(importance.query(table(spark, SF, "documents"), table(spark, SF, "benchmark")), importance.ORACLE, SF)


def test_odd_rows(spark, odd):
    target = spark.createDataFrame([(None,), ("",), ("The CAT sat on the ÉÄ mat",)], "text string")
    clash = odd.withColumnRenamed("bits", "g1").withColumnRenamed("whole", "pos").withColumnRenamed("runs", "word")
    # equal documents differ in nothing but who comes first
    many = clash.unionAll(clash.withColumn("doc_id", clash.doc_id + 100)).unionAll(clash)
    want = plain([(r.doc_id, r.text) for r in many.collect()], [r.text for r in target.collect()])
    assert rows_of(importance.query(many, target)) == sorted(want, key=str)
    assert importance.query(odd.limit(0), target).collect() == []
    assert rows_of(importance.query(odd, target.limit(0))) == sorted(plain([(r.doc_id, r.text) for r in odd.collect()], []), key=str)


def test_the_position_table_is_not_shuffled(spark, docs):
    plan = importance.ngrams(table(spark, SF, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate") < plan.index("Exchange hashpartitioning")


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aZé9 -\x7f\x00́_`{@[/:Ä\n"), max_size=30))
def test_words_are_of_letters_digits_and_other_characters(text):
    allowed = lambda c: c.isascii() and c.isalnum() or ord(c) > 127
    lower = text.translate(str.maketrans(importance.UPPER, importance.LOWER))
    assert "".join(re.findall(importance.WORD, lower)) == "".join(c for c in lower if allowed(c))
