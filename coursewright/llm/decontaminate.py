"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman scores them.

The test items come in slices of SLICE_BYTES of text at most, a size that a task can hold;
however many items there are, the documents are read twice for each slice and never
shuffled. First the documents that have each run of GRAM words of an item are counted, over
all documents. An item's seeds are its runs of words that are rare: in RARE of the documents or
fewer, or in no more than ODD times as many as its median run among those that occur. The other
runs that occur are common seeds. The passages around a document's seeds, grouped by diagonal, are
aligned locally with the item: MATCH for an equal word, MISS for another, GAP for a missing
one. Where all seeds are common, a passage is aligned only if the words that it has in common
with the item, in any order, could score enough (an exact upper bound), so that how often a
leak is repeated never decides whether it is found. The score is a share of what the item scores against itself; LEAST_SCORE and
LEAST_WORDS equal words in net terms (or a whole shorter item) make a leak.

Defined results: a null or empty text or item matches nothing; an item of fewer than GRAM
words is matched by a text of as few words alone. A document and an item make one leak at most: the
passage of highest score, of equal ones the last. A very long text is read whole, in a block of its
own. Rows that repeat give rows that repeat; items with equal texts match on their own. No rows or
no items: no leaks. Other columns are not read, but for those a caller wants kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursewright.llm.common import Words, blocks, in_arrow

GRAM, SLICE_BYTES = 4, 16 << 20
RARE, ODD = 1e-5, 4
MATCH, MISS, GAP = 2, -1, -1
LEAST_SCORE, LEAST_WORDS = 0.4, 8


def local_score(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """The best Smith-Waterman score, and the index in the passage where its alignment ends."""
    ramp = np.arange(1, len(passage) + 1, dtype=np.int32) * -GAP
    row = np.zeros(len(passage) + 1, np.int32)
    best, end = 0, 0
    for word in item:
        gain = np.where(passage == word, MATCH, MISS).astype(np.int32)
        top = np.maximum(np.maximum(row[:-1] + gain, row[1:] + GAP), 0)
        top = np.maximum.accumulate(top + ramp) - ramp  # gaps in the item, from the left
        row[1:] = top
        at = int(top.argmax())
        if top[at] > best:
            best, end = int(top[at]), at
    return best, end


def aligned(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Score, first and last index of the aligned part of the passage."""
    best, end = local_score(item, passage)
    _, back = local_score(item[::-1], passage[: end + 1][::-1])
    return best, end - back, end


def most(item: np.ndarray, passage: np.ndarray) -> int:
    """An upper bound of their score: each word in an aligned part is in the other text too, or costs 1."""

    def best(words: np.ndarray, other: np.ndarray) -> int:
        own = np.sort(other)
        same = own[np.minimum(np.searchsorted(own, words), len(own) - 1)] == words
        total = np.cumsum(np.where(same, MATCH, -min(-MISS, -GAP)))
        return int((total - np.minimum.accumulate(np.r_[0, total[:-1]])).max())

    return max(0, min(best(passage, item), best(item, passage))) if len(item) and len(passage) else 0


class Seeds:
    """Runs of words, and the item and place of each."""

    def __init__(self, gram: np.ndarray, item: np.ndarray, place: np.ndarray):
        self.set_seeds(gram, item, place)

    def set_seeds(self, gram: np.ndarray, item: np.ndarray, place: np.ndarray) -> None:
        order = np.argsort(gram, kind="stable")
        self.gram, self.item, self.place = gram[order], item[order], place[order]
        self.seeds, first = np.unique(self.gram, return_index=True)
        self.first = np.r_[first, len(self.gram)]
        self.likely = np.zeros(1 << 22, bool)
        self.likely[(self.seeds >> np.uint64(42)).astype(np.int64)] = True

    def hits(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices in ``gram`` of the seeds, and which seeds they are."""
        near = np.flatnonzero(self.likely[(gram >> np.uint64(42)).astype(np.int64)]) if len(self.seeds) else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.seeds, gram[near]), max(len(self.seeds) - 1, 0))
        same = self.seeds[at] == gram[near]
        return near[same], at[same]

    def entries(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index in ``gram``, item and place in it, of all places of the seeds."""
        hit, seed = self.hits(gram)
        size = self.first[seed + 1] - self.first[seed]
        entry = np.repeat(self.first[seed], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.repeat(hit, size), self.item[entry], self.place[entry]


class Items(Seeds):
    """Words and seeds of a slice of items."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        self.ids = ids
        words = Words(pa.array([t or "" for t in texts], pa.string()))
        self.words = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        gram, at = words.grams(GRAM)
        super().__init__(gram, words.text[at], at - words.first[words.text[at]])
        self.common = Seeds(gram[:0], self.item[:0], self.place[:0])

    def keep_rare(self, df: np.ndarray, n_docs: int) -> None:
        """Leave the seeds that are rare, or not much more frequent than others of their item; set apart the others that occur."""
        seen = df[np.searchsorted(self.seeds, self.gram)]
        there = np.flatnonzero(seen)
        order = there[np.lexsort((seen[there], self.item[there]))]
        item = self.item[order]
        start = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.zeros(0, np.int64)
        size = np.diff(np.r_[start, len(item)])
        median = np.zeros(len(seen))
        median[order] = np.repeat(seen[order][start + (size - 1) // 2], size)
        keep = seen <= np.maximum(max(1, RARE * n_docs), ODD * median)
        self.common = Seeds(self.gram[~keep], self.item[~keep], self.place[~keep])
        self.set_seeds(self.gram[keep], self.item[keep], self.place[keep])

    def leaks(self, texts: pa.Array) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item, score, first word, last word) of the leaks."""
        words = Words(texts)
        gram, at = words.grams(GRAM)
        rare, common = self.entries(gram), self.common.entries(gram)
        hit, item, place = (np.concatenate(both) for both in zip(rare, common, strict=True))
        if not len(hit):
            return
        is_rare = np.arange(len(hit)) < len(rare[0])
        word = at[hit]
        text = words.text[word]
        diagonal = word - words.first[text] - place
        order = np.lexsort((diagonal, item, text))
        text, item, diagonal, is_rare = text[order], item[order], diagonal[order], is_rare[order]
        length = np.array([len(w) for w in self.words])
        slack = length[item] // 4 + 4
        border = np.ones(len(text), bool)
        border[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > 2 * slack[1:])
        start = np.flatnonzero(border)
        some_rare = np.logical_or.reduceat(is_rare, start).tolist()
        found: dict[tuple[int, int], tuple[float, int, int]] = {}
        for lo, hi, sure in zip(start.tolist(), np.r_[start[1:], len(text)].tolist(), some_rare, strict=True):
            t, i = int(text[lo]), int(item[lo])
            first, last = int(words.first[t]), int(words.first[t + 1])
            a = max(first, first + int(diagonal[lo]) - int(slack[lo]))
            b = min(last, first + int(diagonal[hi - 1]) + int(length[i]) + int(slack[lo]))
            whole = MATCH * int(length[i])
            enough = max(LEAST_SCORE * whole, min(whole, MATCH * LEAST_WORDS))
            if not sure and most(self.words[i], words.hash[a:b]) < enough:
                continue
            score, p, q = aligned(self.words[i], words.hash[a:b])
            if score >= enough:
                got = (score / whole, a - first + p, a - first + q)
                if got > found.get((t, i), (0.0, 0, 0)):
                    found[t, i] = got
        for (t, i), (score, p, q) in found.items():
            yield t, i, score, p, q


def slices(items: DataFrame, bound: int = SLICE_BYTES) -> Iterator[Items]:
    """The items, sorted by id, in slices of ``bound`` bytes or one item."""
    ids, texts, size = [], [], 0
    for row in items.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator():
        n = len((row["text"] or "").encode())
        if ids and size + n > bound:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += n
    if ids:
        yield Items(ids, texts)


def seed_counts(docs: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """How many documents have each seed, and the number of documents."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = shared.value, 0
        total = np.zeros(len(own.seeds), np.int64)
        for batch in blocks(batches):
            words = Words(batch.column("text"))
            gram, at = words.grams(GRAM)
            hit, seed = own.hits(gram)
            pairs = np.unique(words.text[at[hit]] * np.int64(len(own.seeds)) + seed)
            total += np.bincount(pairs % max(len(own.seeds), 1), minlength=len(own.seeds))
            n += len(batch)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some]), pa.array(np.r_[n, total[some]])], ["seed", "n"])

    rows = in_arrow(docs.select("text"), work, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()  # 16 bytes per seed of the slice
    seed, n = (rows.column(c).to_numpy() for c in ("seed", "n"))
    df = np.zeros(len(items.seeds), np.int64)
    df[seed[seed >= 0]] = n[seed >= 0]
    return df, int(n[seed < 0].sum())


def rare(docs: DataFrame, items: Items) -> Items:
    items.keep_rare(*seed_counts(docs, items))
    return items


LEAKS = "doc_id long, item_id long, score double, first_word long, last_word long"


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word (indices in the document) of each leak."""
    spark = docs.sparkSession
    found = None
    for part in slices(items):
        shared = spark.sparkContext.broadcast(rare(docs, part))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in blocks(batches):
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[t], own.ids[i], s, p, q) for t, i, s, p, q in own.leaks(batch.column("text"))]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "item_id", "score", "first_word", "last_word"])

        one = in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, LEAKS)
        found = one if found is None else found.unionByName(one)
    return spark.createDataFrame([], LEAKS) if found is None else found


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a leak, with all their columns, in place: nothing is shuffled. Seeds are counted over all rows for each slice."""
    fields, whole = docs.schema.fields, docs
    for part in slices(items):
        shared = docs.sparkSession.sparkContext.broadcast(rare(whole, part))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in blocks(batches):
                keep = np.ones(len(batch), bool)
                keep[[t for t, *_ in shared.value.leaks(batch.column("text"))]] = False
                yield batch.filter(pa.array(keep))

        docs = in_arrow(docs, work, docs.schema)
    assert [f.name for f in docs.schema.fields] == [f.name for f in fields]
    return docs


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leaks(docs, benchmark)
