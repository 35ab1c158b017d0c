import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from coursewright.llm import decontaminate as dc
from coursewright.llm.common import Words, documents, table
from tests.llm.conftest import SF

WORD = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")


def plain_score(a, b) -> int:
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1][j + 1] = max(0, h[i][j] + (dc.MATCH if x == y else dc.MISS), h[i][j + 1] + dc.GAP, h[i + 1][j] + dc.GAP)
    return max(map(max, h))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.lists(st.integers(0, 3), min_size=1, max_size=14))
def test_alignment(a, b):
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    score, first, last = dc.aligned(x, y)
    assert score == plain_score(a, b)
    if score:
        assert plain_score(a, b[first : last + 1]) == score


def test_documents_that_hold_an_item(spark):
    docs, items = documents(spark, "/root/testdata/sf0.01"), table(spark, "/root/testdata/sf0.01", "benchmark")
    got = {(r.doc_id, r.item_id) for r in dc.query(docs, items).collect()}
    texts, wanted = docs.collect(), items.collect()
    assert got >= {(d.doc_id, i.item_id) for d in texts for i in wanted if i.text in d.text}
    kept = dc.clean(docs, items)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {d.doc_id for d in texts} - {d for d, _ in got}


def test_edited_copies_and_frequent_items(spark):
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(1 << 30)}"
    item = [word() for _ in range(40)]
    noise = lambda n: [word() for _ in range(n)]

    def paraphrased(share):
        return [word() if rng.random() < share else w for w in item if rng.random() > share / 4]

    rows = [(i, " ".join(noise(80) + paraphrased(0.15) + noise(80))) for i in range(300)]  # in almost all documents
    rows += [(1000 + i, " ".join(noise(200))) for i in range(60)]
    rows += [(2000, " ".join(item[:12] + noise(40))), (2001, " ".join(noise(10) + item[5:35]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item)), (8, "too short")], "item_id long, text string")
    got = {r.doc_id: r for r in dc.query(docs, items).collect()}
    assert not [d for d in got if 1000 <= d <= 2000] and 2001 in got
    assert sum(i in got for i in range(300)) >= 297
    for d in (0, 1, 2001):
        words = WORD.findall(dict(rows)[d])
        inside = words[got[d].first_word : got[d].last_word + 1]
        assert len(set(inside) & set(item)) >= 0.8 * len(set(words) & set(item))


def test_slices_find_what_one_slice_finds(spark, monkeypatch):
    docs, items = documents(spark, SF), table(spark, SF, "benchmark")
    whole = sorted(map(tuple, dc.query(docs, items).collect()))
    monkeypatch.setattr(dc.slices, "__defaults__", (1500,))
    assert len(list(dc.slices(items))) > 2
    assert sorted(map(tuple, dc.query(docs, items).collect())) == whole


def test_every_item_keeps_seeds():
    items = dc.Items([1, 2], ["a b c d e f g h", "x y"])
    items.keep_rare(np.full(len(items.seeds), 10**6), 10**6)
    assert set(items.item) == {0, 1} and len(items.gram) == 6
    assert [(t, i) for t, i, *_ in items.leaks(pa.array(["x y", "a b c d e f g h", "0 x y 0"]))] == [(0, 1), (1, 0)]
    items = dc.Items([1], ["a b c d e f g h"])
    items.keep_rare(np.where(items.seeds == items.seeds[2], 10**5, 50), 10**6)
    assert len(items.gram) == 4


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=9), st.lists(st.integers(0, 9), min_size=1, max_size=14))
def test_bound_of_the_score(a, b):
    assert dc.most(np.array(a, np.uint64), np.array(b, np.uint64)) >= plain_score(a, b)


def test_repeated_edited_and_partial_passages(spark):
    rng = np.random.default_rng(6)
    noise = lambda n: [f"w{i}" for i in rng.integers(1 << 40, size=n)]
    rows, want, items = [], set(), []

    def put(item, said, times):
        for _ in range(times):
            want.add((len(rows), item))
            rows.append((len(rows), " ".join(noise(30) + said + noise(30))))

    for times in (2, 50, 3000):
        for kind in ("edited", "partial", "edited beside whole", "partial beside others"):
            item = noise(40)
            items.append((len(items), " ".join(item)))
            said = item[:20] if kind.startswith("partial") else [f"e{i}" if i % 7 == 6 else w for i, w in enumerate(item)]
            put(len(items) - 1, said, times)
            if kind == "edited beside whole":  # the runs across the edits are in one document
                put(len(items) - 1, item, 1)
            if kind == "partial beside others":  # the second half's runs are in one document each
                rows.extend((len(rows) + i, " ".join(noise(30) + item[k : k + 9])) for i, k in enumerate(range(19, 32, 4)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = dc.query(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want


def test_query_finds_what_alignment_of_all_pairs_finds(spark):
    """Every document against every item as a whole: no leak is missing, none is made up."""
    docs, items = documents(spark, SF).collect(), table(spark, SF, "benchmark").collect()
    found = {(r.doc_id, r.item_id): r for r in dc.query(documents(spark, SF), table(spark, SF, "benchmark")).collect()}
    said = {d.doc_id: Words(pa.array([d.text])).hash for d in docs}
    want = {}
    for item in items:
        words = Words(pa.array([item.text])).hash
        whole = dc.MATCH * len(words)
        for d, text in said.items():
            if len(words) and np.isin(words, text).sum() >= dc.GRAM:
                best, _ = dc.local_score(words, text)
                if best >= max(dc.LEAST_SCORE * whole, min(whole, dc.MATCH * dc.LEAST_WORDS)):
                    want[d, item.item_id] = best / whole
    assert found.keys() == want.keys() and want
    assert all(abs(found[p].score - want[p]) < 1e-9 for p in want)
