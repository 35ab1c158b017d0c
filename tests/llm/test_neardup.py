from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from coursewright.llm import neardup as nd
from coursewright.llm.common import documents
from tests.duck import same
from tests.llm.conftest import SF


def brute_force(texts: list[str | None], idf: nd.Idf) -> list[int]:
    """The first index of each text's class, by all pairs that share a shingle."""
    text, shingle, tf = nd.shingles(pa.array(texts, pa.string()).fill_null(""))
    w = nd.weights(shingle, tf, idf).astype(float)
    total, by, shared = np.bincount(text, w, len(texts)), defaultdict(list), defaultdict(float)
    for i, s, x in zip(text.tolist(), shingle.tolist(), w.tolist(), strict=True):
        by[s].append((i, x))
    for some in by.values():
        for k, (j, y) in enumerate(some):
            for i, x in some[:k]:
                shared[i, j] += min(x, y)
    pairs = [p for p, v in shared.items() if v >= nd.SIMILAR * (total[p[0]] + total[p[1]] - v)]
    first: dict = {}
    pairs += [(first.setdefault(t, i), i) for i, t in enumerate(texts)]
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        a, b = sorted((top(i), top(j)))
        root[b] = a
    return [top(i) for i in range(len(texts))]


def compare(spark, texts, idf=None):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in nd.query(rows).collect()}
    want = brute_force(texts, idf or nd.common_shingles(rows))
    assert [got[i] for i in range(len(texts))] == want
    return want


def test_documents(spark):
    docs = documents(spark, "/root/testdata/sf0.01").orderBy("doc_id").limit(400)
    compare(spark, [r.text for r in docs.collect()])


def test_query_gives_the_rows_of_its_sql(spark):
    same(nd.query(documents(spark, SF)), nd.ORACLE, SF)


def edited(words, rng, n):
    out = list(words)
    for at in rng.choice(len(out), n, replace=False):
        out[at] = f"new{rng.integers(1 << 40)}"
    return " ".join(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_a_group_of_edited_copies(spark, seed):
    """Copies with so many edits that some pairs are links and others not, beside a common passage and exact copies."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 10_000, 150)]
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [edited(base, rng, int(n)) for n in rng.integers(0, 9, 120)]
    texts += [f"{passage} {' '.join(f'q{i}' for i in rng.integers(0, 1 << 40, 60))}" for _ in range(80)]
    texts += [texts[0]] * 30 + [None, None, "", "", "!!", "one two", "one two", "One, two!", "three"]
    want = compare(spark, texts)
    assert len(set(want[:120])) > 1 and len(set(want[120:200])) == 80


def test_weights_and_samples_agree_with_similarity():
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in range(400)]
    texts = pa.array([" ".join(base), edited(base, rng, 12), edited(base, rng, 60), "x y z"])
    idf = nd.Idf(np.zeros(0, np.int64), np.zeros(0))
    text, shingle, tf = nd.shingles(texts)
    drawn = nd.samples(text, shingle, nd.weights(shingle, tf, idf), 4)
    sims = nd.similarities(texts.take(pa.array([0, 0, 0])), texts.take(pa.array([1, 2, 3])), idf)
    same = [(drawn[0] == drawn[i]).mean() for i in (1, 2, 3)]
    assert all(abs(a - b) < 0.25 for a, b in zip(sims, same, strict=True)) and sims[0] > 0.7 > sims[1] and same[2] == 0


def plain_shares(texts: list[str]) -> dict[int, float]:
    """The share of each shingle, by candidate groups."""
    text, shingle, _ = nd.shingles(pa.array(texts))
    sets = [set(shingle[text == i].tolist()) for i in range(len(texts))]
    group = [min(nd.mix(np.array(sorted(s), np.uint64)).tolist()) >> 44 if s else None for s in sets]
    part = [1 / group.count(g) if g is not None else 0.0 for g in group]
    share: dict = defaultdict(float)
    for s, p in zip(sets, part, strict=True):
        for x in s:
            share[x] += p / sum(part)
    return share


def test_common_shingles_weigh_less(spark):
    """Boilerplate loses weight with its share; what copies of one text share does not."""
    rng = np.random.default_rng(1)
    noise = lambda n: " ".join(f"n{i}" for i in rng.integers(0, 1 << 40, n))
    half, tenth = "this half of all texts says so", "one in ten says this much here"
    texts = [f"{noise(30)} {half if i % 2 else ''} {tenth if i % 10 == 0 else ''}" for i in range(200)]
    copied = noise(80)
    texts += [copied] * 100 + [f"{copied} {noise(1)}" for _ in range(100)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    idf = nd.common_shingles(rows)
    want = plain_shares(texts)
    weight = lambda said: idf.of(nd.shingles(pa.array([said]))[1]).tolist()
    for said in (half, tenth, copied):
        expected = [np.log1p(1 / max(want[x], nd.LEAST_SHARE)) for x in nd.shingles(pa.array([said]))[1].tolist()]
        assert weight(said) == pytest.approx(expected, rel=1e-3)
    assert max(weight(half)) < max(weight(tenth)) < min(weight(copied)) and min(weight("never seen before at all")) == pytest.approx(np.log1p(1 / nd.LEAST_SHARE))


def test_links_are_told_and_verified(spark):
    docs = documents(spark, SF)
    said = {r.doc_id: r.text for r in docs.collect()}
    found = nd.found_links(docs).collect()
    idf = nd.common_shingles(docs)
    sims = nd.similarities(pa.array([said[r.doc_id] for r in found]), pa.array([said[r.other_id] for r in found]), idf)
    assert found and [r.similarity for r in found] == pytest.approx(sims.tolist()) and min(sims) >= nd.SIMILAR
    of = {r.doc_id: r.class_id for r in nd.query(docs).collect()}
    assert all(of[r.doc_id] == of[r.other_id] and said[r.doc_id] != said[r.other_id] for r in found)


def test_near_copies_on_rows_without_an_id(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(None, " ".join(words)), (None, " ".join([*words, "x"])), (None, "another text of six words altogether"), (4, " ".join([*words, "y"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.class_rows, str(r.class_id)) for r in nd.query(docs).collect()) == [(1, "None"), (3, "4"), (3, "4"), (3, "4")]
    assert sorted(map(str, (r.doc_id for r in nd.representatives(docs).collect()))) == ["4", "None"]


def test_blocks_of_sets_find_what_one_block_finds(spark, monkeypatch):
    monkeypatch.setattr(nd, "SET_BLOCK", 500)
    test_a_group_of_edited_copies(spark, 3)


def test_representatives_with_repeated_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "another text"), (2, "another text"), (3, None), (4, None), (None, "a b c d e f"), (None, "lone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, nd.representatives(docs).collect()), key=str)
    assert got == [(1, "a b c d e f"), (1, "another text"), (3, None), (None, "lone")]
