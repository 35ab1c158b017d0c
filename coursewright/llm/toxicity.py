"""Toxicity: a linear classifier, regularised by counterfactual sentences.

Features are words and word beginnings of PREFIXES bytes, each at least once, twice and
three times in a text. Spark counts them over the labelled sample, and the FEATURES of
highest chi-square form the vocabulary, with all identity terms. Training minimises
logistic loss + L2 + SWAP times the mean squared change of score when an identity term of a
labelled sentence is swapped for another of its group, so that neutral mentions of a group
don't count as toxic. A swap changes no features but those of the terms, so that Spark counts equal
changes and few different ones are left. Rows of label 1, the rarer, count POSITIVE times. Scoring
reads whole texts in the executors.

Bound of the sample: SAMPLE labelled documents in expectation, those of lowest hash, and the SWAPS
most frequent changes of their sentences. What reaches the driver is so many rows of
TIMES * (FEATURES + features of the identity terms) bits at most, however many rows there are.

Defined results: a null text is an empty one; an empty text scores what the intercept
gives. A very long text is scored whole. Of rows with one doc_id the least text is learned from, of
several labels the greater counts; features of equal chi-square are taken in order of their hash,
equally frequent changes in order of their features. Rows that repeat give rows that repeat; no
rows, no rows. Without labels of both kinds all scores are the share of label 1 (0.5 without any
label). Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursewright.llm.common import Words, blocks, in_arrow, spare

SAMPLE, SWAPS, FEATURES, LEAST_ROWS, LEAST_CHI = 6000, 2000, 800, 3, 20.0
PREFIXES, TIMES = (5, 6, 7, 8), 3
STEPS, L2, SWAP, POSITIVE = 400, 1e-4, 5.0, 6.0
THRESHOLD = 0.7

#: Groups of identity terms that stand for one another.
IDENTITY = [
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist"],
    ["gay", "lesbian", "straight", "bisexual", "transgender"],
    ["black", "white", "asian", "latino"],
    ["african", "european", "american", "arab", "mexican", "chinese", "indian"],
    ["young", "old", "elderly"],
    ["disabled", "deaf", "blind"],
    ["immigrant", "refugee", "native"],
    ["frauen", "männer", "mädchen", "jungen"],
    ["frau", "mann"],
    ["christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"],
    ["schwule", "lesben", "bisexuelle"],
    ["schwarze", "weiße", "asiaten"],
    ["afrikaner", "europäer", "amerikaner", "araber", "chinesen", "türken"],
    ["ausländer", "flüchtlinge", "einheimische"],
    ["behinderte", "gehörlose", "blinde"],
    ["femmes", "hommes", "filles", "garçons"],
    ["chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"],
    ["noirs", "blancs", "asiatiques"],
    ["africains", "européens", "américains", "arabes", "chinois"],
    ["immigrés", "réfugiés"],
    ["handicapés", "sourds", "aveugles"],
    ["mujeres", "hombres", "niñas", "niños"],
    ["cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"],
    ["negros", "blancos", "asiáticos"],
    ["africanos", "europeos", "americanos", "árabes", "chinos"],
    ["inmigrantes", "refugiados"],
    ["discapacitados", "sordos", "ciegos"],
]
GROUP_OF = {term: group for group in IDENTITY for term in group}
TERMS = re.compile(rf"\b({'|'.join(sorted(GROUP_OF, key=lambda t: (-len(t), t)))})\b")


def word_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of all words and word beginnings, with repetitions."""
    words = Words(texts)
    rows, found = [words.text], [words.hash]
    for k in PREFIXES:
        at = np.flatnonzero(words.end - words.start >= k)
        rows.append(words.text[at])
        found.append(words.prefix_hash(at, k))
    return np.concatenate(rows), np.concatenate(found)


def counted(rows: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, t - 1) for each t from 1 to TIMES that the feature has in the text."""
    order = np.lexsort((found, rows))
    rows, found = rows[order], found[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])
    starts = np.flatnonzero(new)
    place = np.arange(len(found)) - starts[np.cumsum(new) - 1] if len(found) else np.zeros(0, np.int64)
    kept = place < TIMES
    return rows[kept], found[kept], place[kept]


class Vocabulary:
    """Sorted features; columns of the model are (feature, t)."""

    def __init__(self, features: np.ndarray):
        self.features = np.unique(features)
        self.columns = TIMES * len(self.features)
        self.likely = np.zeros(1 << 20, bool)
        self.likely[(self.features >> np.uint64(44)).astype(np.int64)] = True

    def bits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, column) of all bits that are set."""
        rows, found = word_features(texts)
        near = np.flatnonzero(self.likely[(found >> np.uint64(44)).astype(np.int64)])
        rows, found = rows[near], found[near]
        at = np.minimum(np.searchsorted(self.features, found), len(self.features) - 1)
        hit = self.features[at] == found
        rows, at, place = counted(rows[hit], at[hit])
        return rows, at * TIMES + place

    def lists(self, texts: pa.Array) -> list[np.ndarray]:
        rows, columns = self.bits(texts)
        return np.split(columns, np.searchsorted(rows, np.arange(1, len(texts))))


def term_features(term: str) -> np.ndarray:
    return word_features(pa.array([term]))[1]


def sample_of(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """doc_id, text, toxic of ``bound`` labelled documents in expectation, by a join with a broadcast of that many rows."""
    known = labels.filter("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = known.filter(draw < min(1.0, bound / max(n, 1)))
    some = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("toxic").alias("toxic"))
    return some.select("doc_id", "text", (F.col("toxic") > 0).cast("int").alias("toxic"))


def vocabulary(sample: DataFrame, size: int = FEATURES) -> tuple[Vocabulary, int, int]:
    """The features of highest chi-square, and the sample's rows with label 0 and 1."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, told = [np.zeros((0, 2), np.uint64)], [np.zeros(0, np.int64)]
        for batch in blocks(batches):
            rows, found, place = counted(*word_features(batch.column("text")))
            keys.append(np.stack([found, place.astype(np.uint64)], 1))
            told.append(np.asarray(batch.column("toxic")).astype(np.int64)[rows])
        keys, told = np.concatenate(keys), np.concatenate(told)
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        keys, told = keys[order], told[order]
        if len(keys):
            new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            n = np.diff(np.r_[new, len(keys)])
            columns = [keys[new, 0].view(np.int64), keys[new, 1].astype(np.int64), n, np.add.reduceat(told, new)]
            for lo in range(0, len(n), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + (1 << 16)]) for c in columns], ["feature", "place", "n", "k"])

    seen = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = seen.get(0, 0), seen.get(1, 0)
    own = np.concatenate([term_features(t) for t in GROUP_OF])
    if not n0 or not n1:
        return Vocabulary(own), n0, n1
    counts = in_arrow(sample.select("text", "toxic"), work, "feature long, place long, n long, k long").groupBy("feature", "place").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    n, k, all_ = F.col("n"), F.col("k"), float(n0 + n1)
    chi = all_ * F.pow(k * all_ - n * float(n1), 2) / (n * (all_ - n + 1e-9) * float(n0) * n1)
    best = counts.filter(n >= LEAST_ROWS).groupBy("feature").agg(F.max(chi).alias("chi")).filter(F.col("chi") >= LEAST_CHI).orderBy(F.desc("chi"), "feature").limit(size).select("feature").collect()
    return Vocabulary(np.concatenate([np.array([r["feature"] for r in best], np.int64).view(np.uint64), own])), n0, n1


def swaps(text: str) -> Iterator[tuple[str, str]]:
    """Sentences with an identity term, each beside the sentence with the next term of the group."""
    for sentence in re.split(r"[.!?\n]+", text.lower()):
        if TERMS.search(sentence):
            yield sentence, TERMS.sub(lambda m: (g := GROUP_OF[m[0]])[(g.index(m[0]) + 1) % len(g)], sentence)


def examples(sample: DataFrame, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the sample's rows, and their labels."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(vocab.lists(batch.column("text")), pa.list_(pa.int32()))], ["toxic", "bits"])

    rows = in_arrow(sample.select("text", "toxic"), work, "toxic int, bits array<int>").collect()  # SAMPLE of them
    x = np.zeros((len(rows), vocab.columns), np.float32)
    for i, r in enumerate(rows):
        x[i, r["bits"]] = 1
    return x, np.array([r["toxic"] for r in rows], np.float32)


def changes(sample: DataFrame, vocab: Vocabulary, bound: int = SWAPS) -> tuple[np.ndarray, np.ndarray]:
    """The changes of bits under swaps, each different one once, and how often each occurs; the bare swaps of every group among them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            pairs = [p for t in batch.column("text").to_pylist() for p in swaps(t)]
            if pairs:
                one, other = (vocab.lists(pa.array([p[i] for p in pairs])) for i in (0, 1))
                told = [(np.setdiff1d(a, b), np.setdiff1d(b, a)) for a, b in zip(one, other, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([t[i] for t in told], pa.list_(pa.int32())) for i in (0, 1)], ["lost", "won"])

    counted_ = in_arrow(sample.select("text"), work, "lost array<int>, won array<int>").groupBy("lost", "won").agg(F.count("*").alias("n"))
    told = [(r["lost"], r["won"], r["n"]) for r in counted_.orderBy(F.desc("n"), "lost", "won").limit(bound).collect()]
    for group in IDENTITY:
        told += [(np.setdiff1d(a, b), np.setdiff1d(b, a), 1) for a, b in zip(vocab.lists(pa.array(group)), vocab.lists(pa.array(group[1:] + group[:1])), strict=True)]
    change = np.zeros((len(told), vocab.columns), np.float32)
    for i, (lost, won, _) in enumerate(told):
        change[i, won], change[i, lost] = 1, -1
    return change, np.array([n for _, _, n in told], np.float32)


def fit(x: np.ndarray, y: np.ndarray, change: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Weights and, last, the intercept, by Adam over the whole sample."""
    w = np.zeros(x.shape[1] + 1, np.float64)
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    m, v = np.zeros_like(w), np.zeros_like(w)
    grad = np.empty_like(w)
    weight = np.where(y > 0, POSITIVE, 1) / len(y)
    share = often / max(often.sum(), 1)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1].astype(np.float32) + w[-1], -30, 30)))
        miss = ((p - y) * weight).astype(np.float32)
        moved = change @ w[:-1].astype(np.float32) * share
        grad[:-1] = miss @ x + 2 * L2 * w[:-1] + 2 * SWAP * (moved @ change)
        grad[-1] = miss.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def learn(docs: DataFrame, labels: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary and the weights of its columns, the intercept last."""
    sample = sample_of(docs, labels)
    vocab, n0, n1 = vocabulary(sample)
    if not n0 or not n1:
        w = np.zeros(vocab.columns + 1)
        w[-1] = np.log((n1 + 0.5) / (n0 + 0.5))
        return vocab, w
    return vocab, fit(*examples(sample, vocab), *changes(sample, vocab))


def score(docs: DataFrame, vocab: Vocabulary, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of all rows, with the score."""
    (said,) = spare(keep, "said")
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias(said))
    fields = rows.schema.fields[:-1]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["score double"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, said):
            rows, columns = vocab.bits(batch.column(said))
            z = np.bincount(rows, weights[columns], len(batch)) + weights[-1]
            own = [batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*own, pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))], [f.name for f in fields] + ["score"])

    return in_arrow(rows, work, schema)


def held_out(docs: DataFrame, folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.pmod(F.crc32(docs["doc_id"].cast("string")), F.lit(folds)) == fold, F.lit(False))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    own = labels.filter(~held_out(labels)).select("doc_id", "toxic")
    vocab, weights = learn(docs.select("doc_id", "text"), own)
    scored = score(docs.select("doc_id", "text", held_out(docs).alias("held_out")), vocab, weights, ["doc_id", "held_out"])
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
