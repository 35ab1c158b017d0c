import math
import re
import zlib

import numpy as np
import pyarrow as pa

from coursewright.llm import toxicity as tx
from coursewright.llm.common import documents, table
from tests.llm.conftest import SF


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = tx.query(documents(spark, sf), table(spark, sf, "labels")).join(table(spark, sf, "labels"), "doc_id").toPandas()
    out = rows[rows.held_out]
    assert rows.score.between(0, 1).all()
    assert out[out.toxic == 1].predicted.mean() > 0.8
    assert out[out.toxic == 0].predicted.mean() < 0.02
    assert ((rows.score >= 0.7) == (rows.predicted == 1)).all()


def test_bits_are_counts_up_to_times():
    vocab = tx.Vocabulary(np.concatenate([tx.term_features("moron"), tx.term_features("nice")]))
    one, many, none = vocab.lists(pa.array(["a moron here", "Moron moron! MORON moron", "fine"]))
    assert set(one) < set(many) and len(many) == tx.TIMES * len(one) and not len(none)


def test_swaps_stay_in_their_group():
    (a, b), = list(tx.swaps("No one here. Some Women said so!"))
    assert a.strip() == "some women said so" and b.strip() == "some men said so"
    assert list(tx.swaps("nothing of this kind")) == []


def test_training_evens_out_identity_terms():
    """A term that stands beside abuse in the sample alone must not count by itself."""
    words = ["women", "men", "moron", "fine"]
    vocab = tx.Vocabulary(np.concatenate([tx.term_features(w) for w in words]))
    texts = ["women moron"] * 40 + ["men fine"] * 40 + ["fine"] * 40
    y = np.array([1] * 40 + [0] * 80, np.float32)
    x = np.zeros((len(texts), vocab.columns), np.float32)
    for i, on in enumerate(vocab.lists(pa.array(texts))):
        x[i, on] = 1
    change = np.zeros((1, vocab.columns), np.float32)
    change[0, vocab.lists(pa.array(["men"]))[0]] += 1
    change[0, vocab.lists(pa.array(["women"]))[0]] -= 1

    def score(w, text):
        return w[:-1][vocab.lists(pa.array([text]))[0]].sum()

    free = tx.fit(x, y, np.zeros((0, vocab.columns), np.float32), np.zeros(0, np.float32))
    held = tx.fit(x, y, change, np.ones(1, np.float32))
    gap = lambda w: abs(score(w, "women") - score(w, "men"))
    assert gap(held) < 0.2 * gap(free)
    assert score(held, "moron") > score(held, "fine")


def test_one_kind_of_label(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(9)], "doc_id long, toxic int")
    assert tx.query(docs, labels).filter("predicted = 1 OR score > 0.3").count() == 0
    assert {r.score for r in tx.query(docs, labels.limit(0)).collect()} == {0.5}


def plain_score(text: str, vocab: tx.Vocabulary, weights: np.ndarray) -> float:
    """Word by word: each feature's first, second and third place in the text count."""
    seen: dict = {}
    z = weights[-1]
    at = {int(f): i for i, f in enumerate(vocab.features)}
    for word in re.findall("[a-z0-9\x80-\U0010ffff]+", text.lower()):
        for f in tx.term_features(word).tolist():
            if f in at and seen.setdefault(f, 0) < tx.TIMES:
                z += weights[at[f] * tx.TIMES + seen[f]]
                seen[f] += 1
    return 1 / (1 + math.exp(-z))


def test_query_is_that_of_plain_scores(spark, docs):
    labels = table(spark, SF, "labels")
    got = {r.doc_id: r for r in tx.query(docs, labels).collect()}
    vocab, weights = tx.learn(docs.select("doc_id", "text"), labels.filter(~tx.held_out(labels)).select("doc_id", "toxic"))
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in sorted(rows, key=lambda r: len(r.text))[:150]:
        want = plain_score(r.text, vocab, weights)
        assert abs(got[r.doc_id].score - want) < 1e-6 and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.7)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_many_sentences_are_few_changes(spark):
    said = " ".join(f"The women of town {i} sang. Some men came! Young or old, {i} of them." for i in range(3000))
    rows = spark.createDataFrame([(1, said, 1), (2, said, 0)], "doc_id long, text string, toxic int")
    vocab = tx.Vocabulary(np.concatenate([tx.term_features(t) for t in tx.GROUP_OF]))
    change, often = tx.changes(rows, vocab)
    bare = sum(len(g) for g in tx.IDENTITY)
    assert len(change) - bare == 3 and often.sum() - bare == 2 * 3 * 3000
    bounded, _ = tx.changes(rows, vocab, bound=2)
    assert len(bounded) - bare == 2


def test_repeated_ids_do_not_grow_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {i % 3}") for i in range(500)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    assert sorted(map(tuple, tx.sample_of(docs, labels).collect())) == [(1, "text 0", 1), (2, "other", 0)]
