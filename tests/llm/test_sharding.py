import zlib

import numpy as np
import pytest

from coursewright.llm import sharding
from coursewright.llm.common import documents


def table_of(spark, df):
    return sharding.query(df).toPandas()


@pytest.mark.parametrize("sf, slack", [("sf0.001", 0.08), ("sf0.01", 0.015)])
def test_shards_are_even_and_slots_gapless(spark, sf, slack):
    docs = documents(spark, f"/root/testdata/{sf}")
    p = table_of(spark, docs)
    want = {r.doc_id: (len(r.text.encode()) + 1, zlib.crc32(r.text.encode())) for r in docs.collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in p.itertuples()} == want
    load = p.groupby("shard")["size"].sum()
    assert len(load) == 16 and load.max() / load.mean() - 1 < slack and 1 - load.min() / load.mean() < slack
    for _, slots in p.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))
    assert p.groupby("text_crc32").shard.nunique().max() == 1


def test_a_hot_group_is_split(spark):
    rows = spark.createDataFrame([(i, "the same text" if i % 3 == 0 else f"text {i} " * (i % 50)) for i in range(6000)], "doc_id long, text string")
    p = table_of(spark, rows)
    load = p.groupby("shard")["size"].sum()
    assert load.max() / load.min() < 1.05


def test_light_groups_are_packed_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "TASK_ITEMS", 300)
    monkeypatch.setattr(sharding, "TASK_ROWS", 400)
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, "x" * int(rng.integers(0, 60))) for i in range(9000)], "doc_id long, text string")
    base = rows.selectExpr("doc_id", "cast(length(text) + 1 as long) AS bytes", "cast(1 as long) AS tokens", "cast(doc_id as string) AS gkey", "doc_id AS salt")
    p = sharding.pack(base, heavy=8).toPandas()
    load = p.groupby("shard")[["bytes"]].sum()
    assert len(p) == 9000 and (load.max() / load.mean() - 1).max() < 0.02


def test_placing_follows_the_dot_product():
    vectors = np.array([[0.5, 0.1, 0.1], [0.4, 0.3, 0.1], [0.1, 0.1, 0.1]])
    residual = np.ones((2, 3))
    got = sharding.place(vectors, residual.copy())
    want, left = [], residual.copy()
    for v in vectors:
        s = int(np.argmax([(r * sharding.IMPORTANCE) @ v for r in left]))
        left[s] -= v
        want.append(s)
    assert got.tolist() == want == [0, 1, 1]


def plain_pack(rows: list[tuple[str, int, int]], shards: int, heavy: int) -> dict[str, int]:
    """Shard of each group, from rows (group, bytes, tokens): heavy ones first, then the others against what these left."""
    groups: dict = {}
    for g, b, t in rows:
        v = groups.setdefault(g, [0, 0, 0])
        groups[g] = [v[0] + b, v[1] + t, v[2] + 1]
    cap = [max(sum(v[d] for v in groups.values()), 1) / shards for d in range(3)]
    weight = {g: max(v[d] / cap[d] for d in range(3)) for g, v in groups.items()}
    order = sorted(groups, key=lambda g: (-weight[g], g))
    share = {g: [v[d] / cap[d] for d in range(3)] for g, v in groups.items()}
    left, out = [[1.0] * 3 for _ in range(shards)], {}

    def put(some, left):
        for g in some:
            dots = [sum(r * x * i for r, x, i in zip(row, share[g], sharding.IMPORTANCE, strict=True)) for row in left]
            best = max(range(shards), key=lambda s: (round(dots[s], 12), -s))
            out[g] = best
            left[best] = [r - x for r, x in zip(left[best], share[g], strict=True)]

    put([g for g in order if weight[g] > 1 / heavy], left)
    light = [g for g in order if weight[g] <= 1 / heavy]
    rest = [1 - sum(share[g][d] for g in out) / shards for d in range(3)]
    own = [sum(share[g][d] for g in light) / shards for d in range(3)]
    put(light, [[row[d] * own[d] / (rest[d] if rest[d] > 1e-12 else 1) for d in range(3)] for row in left])
    return out


@pytest.mark.parametrize("heavy", [8, 100_000])
def test_pack_is_that_of_a_plain_reader(spark, heavy):
    rng = np.random.default_rng(2)
    rows = [(f"g{i:03}", int(n) + 1, int(n) // 6) for i in range(150) for n in [rng.lognormal(6, 1)] for _ in range(int(rng.integers(1, 4)))]
    base = spark.createDataFrame(rows, "gkey string, bytes long, tokens long").selectExpr("*", "xxhash64(gkey) AS salt").repartition(4)
    got = {r.gkey: r.shard for r in sharding.pack(base, shards=5, heavy=heavy).collect()}
    assert got == plain_pack(rows, 5, heavy)


def test_rows_without_an_id_are_numbered_in_many_buckets(spark):
    rows = spark.createDataFrame([(None, f"text {i}") for i in range(3000)], "doc_id long, text string")
    p = table_of(spark, rows)
    for _, slots in p.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))
