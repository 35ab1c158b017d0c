from pyspark.sql import functions as F

from coursewright.llm import mixing
from coursewright.llm.common import documents, word_count
from tests.duck import same
from tests.llm.conftest import SF


def test_query_gives_the_rows_of_its_sql(spark):
    same(mixing.query(documents(spark, SF)), mixing.ORACLE, SF)


def plain_targets(sizes: dict, weights=(3, 1, 2)):
    """Shares by weight; what is over a cap is shared again until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    free, left, out = set(names), 1.5 * sum(sizes.values()), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_targets_stop_and_are_reshared(spark):
    for sizes in ({"a": 1, "b": 1000, "c": 10, "ä": 300, None: 5}, {"a": 7}, {"a": 0, "b": 0}, {"b": 10, "a": 10, "c": 10}):
        rows = spark.createDataFrame([(f"{s}", s, n) for s, n in sizes.items()], "key string, source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
        want = plain_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_taken_words(spark):
    docs = documents(spark, SF)
    rows = mixing.query(docs)
    per = rows.groupBy("source_size").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert all(abs(r.target - r.taken) <= 1 for r in per)
    assert rows.filter("taken > 2 * size").count() == 0
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, mixing.query(docs.repartition(9)).collect()))


def test_permutation_takes_each_block_once(spark):
    sources = spark.createDataFrame([("sa", 10_000, 14_999.6), ("sb", 37, 20.0), ("sc", 5, 10.0)], "key string, source_size long, target double")
    dealt = mixing.slots(sources, block_words=16, shard_slots=100).cache()
    assert dealt.groupBy("key", "turn", "block").count().filter("count > 1").count() == 0
    assert {r.key: r.n for r in dealt.groupBy("key").agg(F.sum("len").alias("n")).collect()} == {"sa": 15_000, "sb": 20, "sc": 10}
    # every pass but the last is over all blocks, and slots are numbered without gaps, shard after shard
    rows = dealt.filter("key = 'sa'").orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(len(rows))) and [r.shard for r in rows] == sorted(r.shard for r in rows)
    assert {r.block for r in rows if r.turn == 0} == set(range(625))


def test_permutations_of_all_small_sizes(spark):
    rows = spark.range(1, 120).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id") - 1)).alias("at"))
    got = rows.select("n", "at", mixing.permuted(F.col("at"), F.col("n"), 3, F.lit("sa"), F.lit(1)).alias("to")).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.n, {})[r.at] = r.to
    assert all(sorted(to.values()) == list(range(n)) for n, to in by.items())
    far = [abs(by[100][i] - by[100][i + 1]) for i in range(99)]
    assert sum(far) / 99 > 20 and by[100] != by[99]


def test_shard_counts_are_drawn_and_sum_to_the_slots(spark):
    per = spark.createDataFrame([("sa", 30_000), ("sb", 10_000), ("sc", 7)], "key string, n long")
    counts = mixing.shard_counts(per, shard_slots=1000).toPandas()
    assert counts.groupby("key").k.sum().to_dict() == {"sa": 30_000, "sb": 10_000, "sc": 7}
    assert set(counts.shard) <= set(range(41))
    for key, n in (("sa", 30_000), ("sb", 10_000)):
        some = counts[counts.key == key].k
        expected = n / 41
        chi = ((some - expected) ** 2 / expected).sum()
        drawn = 40 * (1 - n / 40_007)  # 40 degrees of freedom, less what the other sources' shares fix
        assert len(some) == 41 and 0.375 * drawn < chi < 2 * drawn
    again = mixing.shard_counts(per.repartition(3), shard_slots=1000).toPandas()
    order = ["key", "shard"]
    assert counts.sort_values(order).values.tolist() == again.sort_values(order).values.tolist()


def test_mixed_documents_hold_the_words_taken(spark):
    docs = documents(spark, SF)
    twice = docs.unionByName(docs.filter("doc_id % 5 = 0"))
    for rows in (docs, twice):
        want = {r.doc_id: r.n for r in mixing.query(rows).groupBy("doc_id").agg(F.sum("taken").alias("n")).collect() if r.n}
        got = {r.doc_id: r.n for r in mixing.mixed(rows).groupBy("doc_id").agg(F.sum(word_count(F.col("text"))).alias("n")).collect()}
        assert got == want


def test_every_shard_is_a_draw_of_fixed_size(spark):
    """Each shard has as many slots, the sources in proportion to what they have, as drawing without putting back gives them."""
    n, size = {"sa": 6000, "sb": 3000, "sn": 1000, "sz": 7}, 100
    per = spark.createDataFrame(list(n.items()), "key string, n long")
    by = {}
    for r in mixing.shard_counts(per, shard_slots=size).collect():
        by.setdefault(r.shard, {})[r.key] = r.k
    whole = sum(n.values())
    shards = -(-whole // size)
    sizes = [sum(by[s].values()) for s in range(shards)]
    assert sorted(by) == list(range(shards)) and max(sizes) - min(sizes) <= 1 and sum(sizes) == whole
    for key, count in n.items():
        got = [by[s].get(key, 0) for s in range(shards)]
        assert sum(b.get(key, 0) for b in by.values()) == count
        share = count / whole
        mean, spread = sum(got) / len(got), (sum((x - size * share) ** 2 for x in got) / len(got)) ** 0.5
        expected = (size * share * (1 - share) * (whole - size) / (whole - 1)) ** 0.5
        assert abs(mean - size * share) < 2 and 0.75 * expected < spread < 1.3 * expected
    other = mixing.shard_counts(per, seed=1, shard_slots=size).filter("shard = 0").collect()
    assert {r.key: r.k for r in other} != by[0]
