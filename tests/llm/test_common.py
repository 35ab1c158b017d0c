import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from coursewright.llm.common import Words, blocks, by_filter, key_filter, word_count
from coursewright.llm.components import components

WORD = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab É-1 \n,👍", max_size=12)), max_size=8))
def test_words_are_those_of_a_plain_reader(texts):
    words = Words(pa.array(texts, pa.string()))
    plain = [WORD.findall((t or "").lower()) for t in texts]
    assert words.text.tolist() == [i for i, w in enumerate(plain) for _ in w]
    same: dict[str, int] = {}
    for word, h in zip([w for ws in plain for w in ws], words.hash.tolist(), strict=True):
        assert same.setdefault(word, h) == h
    assert len(set(same.values())) == len(same)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abc ", max_size=24), min_size=1, max_size=6), st.integers(1, 5))
def test_grams(texts, n):
    words = Words(pa.array(texts))
    gram, at = words.grams(n)
    plain = []
    for i, t in enumerate(texts):
        w = WORD.findall(t)
        plain += [(i, tuple(w[k : k + n])) for k in range(max(1, len(w) - n + 1))] if w else []
    assert words.text[at].tolist() == [i for i, _ in plain]
    of: dict[tuple, int] = {}
    for (_, g), h in zip(plain, gram.tolist(), strict=True):
        assert of.setdefault(g, h) == h


def test_blocks_keep_all_rows():
    texts = ["a" * n for n in (5, 0, 30, 1, 1, 9)] + [None]
    batch = pa.record_batch([pa.array(texts), pa.array(range(7))], ["text", "i"])
    parts = list(blocks(iter([batch]), limit=10))
    assert [i for p in parts for i in p.column("i").to_pylist()] == list(range(7))
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= 10 for p in parts)


def test_word_count(spark):
    rows = spark.createDataFrame([("a\tb  c\x0bd",), ("",), (None,), (" x",)], "text string")
    assert [r[0] for r in rows.select(word_count(F.col("text"))).collect()] == [4, 0, 0, 1]


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(i, i + 1) for i in range(200, 230)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_key_filter_misses_no_key(spark):
    keys, rows = spark.range(0, 40_000, 7).toDF("k"), spark.range(0, 40_000).toDF("k")
    bits = key_filter(keys, "k")
    inside, outside = by_filter(rows, "k", bits, True), by_filter(rows, "k", bits, False)
    assert bits.count() == 1 and outside.join(keys, "k", "left_semi").count() == 0
    assert keys.count() <= inside.count() < 1.1 * keys.count() and inside.count() + outside.count() == 40_000
    none = key_filter(keys.limit(0), "k")
    assert by_filter(rows, "k", none, True).count() == 0 and by_filter(rows, "k", none, False).count() == 40_000
