"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

A document is the weighted set of its runs of five words: (1 + ln tf) * ln(1 + 1 / f), where f
is the share of documents that have the shingle, LEAST_SHARE at least. A group of near copies may
hold a third of all documents, and must not pass for boilerplate; so documents are counted by
candidate groups, those that have the same least shingle hash: a document counts as one by the
size of its group. Group sizes and shares are kept in hashed counters of fixed size and counted
over all documents. SAMPLES consistent samples give BANDS keys; documents that share a key are
candidates, and a candidate pair is a link if its exact weighted Jaccard similarity is SIMILAR or
more. Candidates with so few equal samples that a link among them is one in a million (AGREE) are
not looked at.

Equal texts are one node. In a bucket, all nodes are compared with the one that meets most
others in buckets, the least edited copy of a group. Where this leaves several components, a
node's reach is the weight it shares with any other node of such buckets: no similarity is
greater, so nodes of less reach than SIMILAR have no more links. The others are compared
exactly within their cluster (what buckets connect), in blocks, but for pairs inside of
the cluster's largest component, which need no more links; a task sends only links that join
components. So a group of thousands of copies makes thousands of pairs, and the work on what is
left grows with the nodes outside of the largest component times all nodes of the cluster. The
classes are the connected components.

Defined results: null texts are one class, as are equal texts, also those without a word.
A text of fewer than five words is one shingle. A very long text is one set, of all its
shingles. class_id is the least doc_id of a class; among nodes that meet equally many others
the greatest is compared with the rest. Rows that repeat are one node, and rows of the result
each; no rows, no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursewright.llm.common import Words, blocks, by_filter, in_arrow, key_filter, look_up, mix, spare, stored
from coursewright.llm.components import components

GRAM, SIMILAR = 5, 0.8
BANDS, ROWS = 16, 3
SAMPLES = BANDS * ROWS
#: Equal samples below which a pair is not verified: five standard deviations under what SIMILAR makes likely.
AGREE = 24
COUNTERS, PARTS, LEAST_SHARE = 1 << 20, 64, 1 / 100
HASH_BITS = 44
#: Shingles in a block of sets that are compared with each other.
SET_BLOCK = 1 << 17


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, tf) sorted by text and shingle; a shingle is a hash of HASH_BITS bits."""
    words = Words(texts)
    found, at = words.grams(GRAM)
    key = np.sort((words.text[at].astype(np.uint64) << np.uint64(HASH_BITS)) | (found >> np.uint64(64 - HASH_BITS)))
    if not len(key):
        return np.zeros(0, np.int64), key, np.zeros(0, np.int64)
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    key = key[new]
    return (key >> np.uint64(HASH_BITS)).astype(np.int64), key & np.uint64((1 << HASH_BITS) - 1), np.diff(np.r_[new, len(found)])


def counter_of(shingle: np.ndarray) -> np.ndarray:
    return (shingle & np.uint64(COUNTERS - 1)).astype(np.int64)


class Idf:
    """ln(1 + 1 / share) of a shingle, for a share of LEAST_SHARE or more; from the counters of the shingles above it."""

    def __init__(self, counter: np.ndarray, share: np.ndarray):
        order = np.argsort(counter)
        self.counter, self.value = counter[order], np.log1p(1 / share[order]).astype(np.float32)
        self.rare = np.float32(np.log1p(1 / LEAST_SHARE))

    def of(self, shingle: np.ndarray) -> np.ndarray:
        if not len(self.counter):
            return np.full(len(shingle), self.rare)
        own = counter_of(shingle)
        at = np.minimum(np.searchsorted(self.counter, own), len(self.counter) - 1)
        return np.where(self.counter[at] == own, self.value[at], self.rare)


def counted(docs: DataFrame, count, above: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Counters and what ``count`` (shingle keys of a block -> counters, amounts, total) adds to them over all
    documents, and the sum of all totals; of counters with more than ``above`` times that sum.

    Tasks count on their own and send compressed parts of the counters, which are summed part by part.
    """
    step = COUNTERS // PARTS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(COUNTERS, np.float32), 0.0
        for batch in blocks(batches):
            at, amount, some = count(*shingles(batch.column("text"))[:2])
            own, of = np.unique(at, return_inverse=True)
            total[own] += np.bincount(of, amount, len(own)).astype(np.float32)
            n += some
        if n:
            parts = [zlib.compress(total[i * step : (i + 1) * step].tobytes(), 1) for i in range(PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary()), pa.array([n] * PARTS, pa.float64())], ["part", "counts", "n"])

    def add(table: pa.Table) -> pa.Table:
        total, n = np.zeros(step), sum(table.column("n").to_pylist())
        for counts in table.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(counts), np.float32)
        at = np.flatnonzero(total > above * n)
        return pa.table({"counter": at + step * table.column("part")[0].as_py(), "amount": total[at], "n": np.full(len(at), n)})

    rows = in_arrow(docs.select("text"), work, "part int, counts binary, n double").groupBy("part").applyInArrow(add, "counter long, amount double, n double").collect()  # COUNTERS at most
    return np.array([r["counter"] for r in rows], np.int64), np.array([r["amount"] for r in rows], float), rows[0]["n"] if rows else 0.0


def least_shingles(text: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have a shingle, and the counter of the one with the least hash."""
    start = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(mix(shingle), start) if len(text) else shingle
    return text[start], (least >> np.uint64(44)).astype(np.int64)


def common_shingles(docs: DataFrame) -> Idf:
    """The counters whose shingles more than LEAST_SHARE of all documents have, by candidate groups, with their shares."""

    def group_sizes(text: np.ndarray, shingle: np.ndarray):
        _, group = least_shingles(text, shingle)
        return group, np.ones(len(group)), len(group)

    at, size, _ = counted(docs, group_sizes, 0.0)
    sizes = np.ones(COUNTERS, np.float32)
    sizes[at] = size
    shared = docs.sparkSession.sparkContext.broadcast(sizes)

    def shares(text: np.ndarray, shingle: np.ndarray):
        owner, group = least_shingles(text, shingle)
        part = 1.0 / shared.value[group]
        both = np.unique(np.searchsorted(owner, text) << np.int64(20) | counter_of(shingle))
        return both & (COUNTERS - 1), part[both >> np.int64(20)], float(part.sum())

    at, amount, n = counted(docs, shares, LEAST_SHARE)
    return Idf(at, np.minimum(amount / max(n, 1e-300), 1.0))


def weights(shingle: np.ndarray, tf: np.ndarray, idf: Idf) -> np.ndarray:
    return (1 + np.log(tf.astype(np.float32))) * idf.of(shingle)


@functools.cache
def gamma_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """65536 quantiles of the gamma(2, 1) distribution, their inverses and logarithms."""
    p = (np.arange(65536) + 0.5) / 65536
    x = np.full(len(p), 1.7)
    for _ in range(60):  # Newton on 1 - (1 + x) exp(-x) = p
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-12), x / 4)
    return x.astype(np.float32), (1 / x).astype(np.float32), np.log(x).astype(np.float32)


def samples(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """SAMPLES consistent samples of each of n texts, as int32; texts without a shingle have zeros.

    With r, c ~ gamma(2, 1) and b uniform for each shingle and sample: t = floor(ln w / r + b),
    and the shingle of least ln c - r (t - b + 1) is drawn, together with t.
    """
    out = np.zeros((n, SAMPLES), np.int32)
    if not len(text):
        return out
    start = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    size = np.diff(np.r_[start, len(text)])
    owner = text[start]
    r_of, inverse_of, log_of = gamma_tables()
    ln_w = np.log(weight)
    for k in range(SAMPLES):
        h = (shingle ^ mix(np.array([k + 1], np.uint64))[0]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        low = (h & np.uint64(0xFFFF)).astype(np.intp)
        b = ((h >> np.uint64(40)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(ln_w * inverse_of[low] + b)
        a = log_of[((h >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.intp)] - r_of[low] * (t - b + 1)
        least = np.minimum.reduceat(a, start)
        at = np.flatnonzero(a == np.repeat(least, size))
        drawn = at[np.r_[True, text[at[1:]] != text[at[:-1]]]]
        out[owner, k] = (mix(shingle[drawn] * np.uint64(31) + t[drawn].astype(np.int64).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def node_of(text: Column) -> Column:
    """Equal texts have equal nodes; a null text has one of its own."""
    return F.when(text.isNull(), F.lit(-1).cast("long")).otherwise(F.xxhash64(text, F.lit("node")))


def signatures(docs: DataFrame, idf: Idf) -> DataFrame:
    """node, keys (BANDS longs), drawn (SAMPLES ints) of each row that has a shingle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            text, shingle, tf = shingles(batch.column("text"))
            drawn = samples(text, shingle, weights(shingle, tf, idf), len(batch))
            has = np.unique(text)
            drawn = drawn[has]
            keys = np.zeros((len(has), BANDS), np.uint64)
            for j in range(ROWS):
                keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + drawn[:, j::ROWS].view(np.uint32) + np.arange(1, BANDS + 1, dtype=np.uint64))
            node = np.asarray(batch.column("node"))[has]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(node),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1).view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1) * SAMPLES, pa.int32()), pa.array(drawn.reshape(-1))),
                ],
                ["node", "keys", "drawn"],
            )

    return in_arrow(docs.select("node", F.coalesce("text", F.lit("")).alias("text")), work, "node long, keys array<long>, drawn array<int>")


def similarities(a: pa.Array, b: pa.Array, idf: Idf) -> np.ndarray:
    """Weighted Jaccard similarity of the texts, pair by pair."""
    sides = []
    for side in (a, b):
        text, shingle, tf = shingles(side)
        w = weights(shingle, tf, idf).astype(np.float64)
        key = (text.astype(np.uint64) << np.uint64(HASH_BITS)) | shingle
        sides.append((key, w, np.bincount(text, w, len(side))))
    (key_a, w_a, sum_a), (key_b, w_b, sum_b) = sides
    _, i, j = np.intersect1d(key_a, key_b, assume_unique=True, return_indices=True)
    shared = np.bincount((key_a[i] >> np.uint64(HASH_BITS)).astype(np.int64), np.minimum(w_a[i], w_b[j]), len(a))
    return shared / np.maximum(sum_a + sum_b - shared, 1e-300)


def verified(pairs: DataFrame, texts: DataFrame, idf: Idf) -> DataFrame:
    """a, b, similarity of the pairs that are similar."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text_a", 1 << 19):
            sim = similarities(batch.column("text_a"), batch.column("text_b"), idf)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sim)], ["a", "b", "similarity"])
            yield out.filter(pa.array(sim >= SIMILAR))

    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return in_arrow(two.select("a", "b", "text_a", "text_b"), work, "a long, b long, similarity double")


def agreeing(pairs: DataFrame, drawn: DataFrame) -> DataFrame:
    """The pairs whose samples agree often enough to be worth verifying."""
    both = pairs.join(drawn.select(F.col("node").alias("a"), F.col("drawn").alias("drawn_a")), "a").join(drawn.select(F.col("node").alias("b"), F.col("drawn").alias("drawn_b")), "b")
    return both.filter(agreement("drawn_a", "drawn_b") >= AGREE).select("a", "b")


def agreement(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)


def reach(texts: DataFrame, nodes: DataFrame, idf: Idf) -> DataFrame:
    """node, reach: the weight that a node shares with any other of ``nodes``, as a share of its own.

    No similarity to another of them can be greater.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            text, shingle, tf = shingles(batch.column("text"))
            w = weights(shingle, tf, idf).astype(np.float64)
            total = np.bincount(text, w, len(batch))
            node = np.asarray(batch.column("node"))[text]
            yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(node), pa.array(w / np.maximum(total[text], 1e-300))], ["shingle", "node", "part"])

    parts = in_arrow(texts.join(nodes, "node").select("node", "text"), work, "shingle long, node long, part double")
    lone = parts.groupBy("shingle").agg(F.count("*").alias("n"), F.first("node").alias("node"), F.first("part").alias("part")).filter("n = 1")
    own = lone.groupBy("node").agg(F.sum("part").alias("alone"))
    return nodes.join(own, "node", "left").select("node", (1 - F.coalesce("alone", F.lit(0.0))).alias("reach"))


def apart(members: DataFrame, found: DataFrame) -> DataFrame:
    """bucket, node, own (component) of the buckets that hold several components, with other columns of ``members``."""
    own = members.join(found, "node", "left").withColumn("own", F.coalesce("component", "node")).drop("component")
    several = own.groupBy("bucket").agg(F.min("own").alias("low"), F.max("own").alias("high")).filter("low <> high")
    return own.join(several.select("bucket"), "bucket")


def joined_sets(rows: pa.Table) -> list[tuple[int, int]]:
    """Pairs of nodes that join different components, from rows (node, own, block, i, j, shingles, weights) of two blocks or one.

    Postings of all shingles give each node's overlaps at once. A pair is left out if pairs
    before it have joined its components.
    """
    rows = rows.combine_chunks()
    lists = rows.column("shingles").combine_chunks()
    size = np.asarray(lists.value_lengths())
    shingle, weight = np.asarray(lists.flatten()), np.asarray(rows.column("weights").combine_chunks().flatten())
    n_rows = len(size)
    owner = np.repeat(np.arange(n_rows, dtype=np.int32), size)
    total = np.bincount(owner, weight, n_rows)
    order = np.argsort(shingle, kind="stable")
    owner, by, placed = owner[order], shingle[order], weight[order]
    start = np.r_[0, np.cumsum(size)]
    own, block, nodes = rows.column("own").to_pylist(), np.asarray(rows.column("block")), rows.column("node").to_pylist()
    i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    out = []
    for x in np.flatnonzero(block == i).tolist():
        mine = shingle[start[x] : start[x + 1]]
        lo = np.searchsorted(by, mine, "left")
        n = np.searchsorted(by, mine, "right") - lo
        at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        shared = np.bincount(owner[at], np.minimum(placed[at], np.repeat(weight[start[x] : start[x + 1]], n)), n_rows)
        near = shared >= SIMILAR * (total + total[x] - shared)
        near &= block == j if i != j else np.arange(n_rows) > x
        for y in np.flatnonzero(near).tolist():
            if top(own[x]) != top(own[y]):
                root[top(own[x])] = top(own[y])
                out.append((nodes[x], nodes[y]))
    return out


def within(texts: DataFrame, nodes: DataFrame, idf: Idf) -> DataFrame:
    """a, b: links that join the components of each cluster, from nodes (node, own, cluster).

    A cluster's nodes are dealt to blocks of SET_BLOCK shingles, those of its largest component
    apart from the others, and a task compares two blocks, of which one holds others at least;
    what it sends are links that join components, not pairs.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            text, shingle, tf = shingles(batch.column("text"))
            cut = pa.array(np.searchsorted(text, np.arange(len(batch) + 1)), pa.int32())
            columns = [batch.column(c) for c in ("node", "own", "cluster", "main")]
            lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (shingle.view(np.int64), weights(shingle, tf, idf).astype(np.float64))]
            yield pa.RecordBatch.from_arrays([*columns, *lists], ["node", "own", "cluster", "main", "shingles", "weights"])

    def linked(rows: pa.Table) -> pa.Table:
        pairs = np.array(joined_sets(rows), np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    sizes = nodes.groupBy("cluster", "own").agg(F.count("*").alias("n"))
    several = sizes.groupBy("cluster").agg(F.count("*").alias("parts"), F.max_by("own", F.struct("n", "own")).alias("largest")).filter("parts > 1")
    some = nodes.join(several, "cluster").select("node", "own", "cluster", (F.col("own") == F.col("largest")).alias("main"))
    schema = "node long, own long, cluster long, main boolean, shingles array<long>, weights array<double>"
    found = stored(in_arrow(texts.join(some, "node").select("node", "own", "cluster", "main", "text"), sets, schema), "near-sets")
    cuts = lambda which: F.ceil(F.sum(F.when(which, F.size("shingles")).otherwise(0)) / SET_BLOCK).cast("long")
    cut = found.groupBy("cluster").agg(cuts(~F.col("main")).alias("others"), cuts(F.col("main")).alias("mains"))
    dealt = found.join(cut, "cluster").withColumn("others", F.greatest("others", F.lit(1)))
    one = F.lit(1).cast("long")
    block = F.when(F.col("main"), F.col("others") + F.pmod(F.xxhash64("node"), F.greatest("mains", one))).otherwise(F.pmod(F.xxhash64("node"), "others"))
    last = F.when(F.col("main"), F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    dealt = dealt.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return dealt.groupBy("cluster", "i", "j").applyInArrow(linked, "a long, b long")


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, node) of all documents, (node, component) of the nodes that are linked to others, and the links found (a, b)."""
    idf = common_shingles(docs)
    marked = docs.select("doc_id", "text", node_of(F.col("text")).alias("node"))
    drawn = stored(signatures(marked, idf).groupBy("node").agg(F.first("keys").alias("keys"), F.first("drawn").alias("drawn")), "near-drawn")
    rows = stored(marked.select("doc_id", "node"), "near-rows")
    members = drawn.select("node", F.posexplode("keys").alias("band", "key")).select("node", F.xxhash64("band", "key").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = stored(members.join(shared, "bucket"), "near-members")
    # one row of each node that any bucket needs, with its text: found by doc_id, since a text may be on any number of rows
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    needed = company.select("node").join(rows.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "node")
    likely = by_filter(marked.filter("text IS NOT NULL"), "node", key_filter(company, "node"), True)
    texts = stored(same_row(likely, needed).select("node", "text").dropDuplicates(["node"]), "near-texts")
    drawn = drawn.select("node", "drawn")

    # the node with most company is the least edited of a group of copies
    placed = members.join(company, "node")
    hubs = placed.groupBy("bucket").agg(F.max_by("node", F.struct("company", "node")).alias("hub"))
    stars = look_up(members, stored(hubs, "near-hubs"), "bucket", "n").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    edges = stored(verified(agreeing(stars, drawn), texts, idf).select("a", "b"), "near-edges")
    found = components(edges)

    rest = stored(apart(members.select("bucket", "node"), found), "near-apart")
    # what shares too little with all others of these buckets has no more links
    able = reach(texts, rest.select("node").distinct(), idf).filter(F.col("reach") >= SIMILAR - 1e-6).select("node")
    rest = stored(apart(rest.select("bucket", "node").join(able, "node"), found), "near-able")
    if rest.isEmpty():
        return rows, found, edges
    meets = rest.groupBy("bucket").agg(F.min("node").alias("b"))
    clusters = components(rest.join(meets, "bucket").select(F.col("node").alias("a"), "b")).withColumnRenamed("component", "cluster")
    owns = rest.groupBy("node").agg(F.first("own").alias("own"))
    more = stored(within(texts, clusters.join(owns, "node"), idf), "near-edges")
    # a component is joined to its nodes by found, so only new edges between components are new
    name = lambda side: found.select(F.col("node").alias(side), F.col("component").alias(f"{side}_own"))
    between = more.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("a_own", "a").alias("a"), F.coalesce("b_own", "b").alias("b"))
    joined = components(between).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    known = found.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    lone = joined.join(found, joined["component"] == found["node"], "left_anti").select(F.col("component").alias("node"), F.col("whole").alias("component"))
    return rows, known.unionByName(lone), edges.unionByName(more)


def by_class(rows: DataFrame, found: DataFrame, *values) -> DataFrame:
    """``rows`` with ``values``, aggregates over each class of its nodes (node, first: the least (none, doc_id), n: rows).

    Nodes are classed first and rows meet the result once; a class or a node may hold a third of all rows.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")
    nodes = rows.groupBy("node").agg(first, F.count("*").alias("n")).join(found, "node", "left")
    nodes = stored(nodes.withColumn("class", F.coalesce("component", "node")).drop("component"), "near-nodes")
    known = look_up(nodes.select("node", "class"), nodes.groupBy("class").agg(*values), "class").drop("class")
    return look_up(rows, stored(known, "near-known"), "node")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), class_rows, for each row."""
    rows, found, _ = links(docs)
    told = by_class(rows, found, F.min("first.doc_id").alias("class_id"), F.sum("n").alias("class_rows"))
    return told.select("doc_id", "class_id", "class_rows")


def found_links(docs: DataFrame) -> DataFrame:
    """doc_id, other_id (the least ids of both texts), similarity: the links that make the classes, each verified."""
    rows, _, edges = links(docs)
    marked = docs.select("doc_id", "text", node_of(F.col("text")).alias("node"))
    ends = stored(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(rows.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "node"), "near-ends")
    likely = by_filter(marked.filter("text IS NOT NULL"), "node", key_filter(ends, "node"), True)
    texts = stored(same_row(likely, ends).select("node", "text").dropDuplicates(["node"]), "near-texts")
    told = verified(edges.distinct(), texts, common_shingles(docs))
    name = lambda side, id_: ends.select(F.col("node").alias(side), F.col("doc_id").alias(id_))
    return told.join(name("a", "doc_id"), "a").join(name("b", "other_id"), "b").select("doc_id", "other_id", "similarity")


def same_row(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose doc_id, null or not, and node are wanted."""
    id_ = lambda df: F.struct(F.coalesce(df["doc_id"], F.lit(0)).alias("id"), df["doc_id"].isNull().alias("none"))
    return rows.withColumn("id", id_(rows)).join(wanted.select("node", id_(wanted).alias("id")), ["id", "node"])


def row_key(doc_id: Column, node: Column) -> Column:
    return F.xxhash64(doc_id, doc_id.isNull(), node)


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each class, one of the least doc_id (null only where there is no other), with all its columns.

    Of equal rows any one stays. Only rows that may have to go are shuffled.
    """
    rows, found, _ = links(docs)
    best = by_class(rows, found, F.min(F.struct("first.none", "first.doc_id", "node")).alias("best"))
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("node") == F.col("best.node"))
    keys = best.groupBy(row_key(F.col("doc_id"), F.col("node")).alias("key")).agg(F.count("*").alias("n"), F.bool_or(stays).alias("stays"))
    odd = stored(keys.filter("NOT stays OR n > 1").select("key", "stays"), "near-odd")
    key, stays = spare(docs.columns, "key", "stays")
    odd, bits = odd.toDF(key, stays), key_filter(odd, "key")
    keyed = docs.withColumn(key, row_key(F.col("doc_id"), node_of(F.col("text"))))
    rest = by_filter(keyed, key, bits, True).join(odd, key, "left")
    kept = by_filter(keyed, key, bits, False).select(*docs.columns).unionByName(rest.filter(F.col(stays).isNull()).select(*docs.columns))
    if odd.filter(F.col(stays)).isEmpty():
        return kept
    return kept.unionByName(rest.filter(F.col(stays)).dropDuplicates([key]).select(*docs.columns))


def query(docs: DataFrame) -> DataFrame:
    return classes(docs).withColumn("kept", F.col("doc_id") == F.col("class_id"))


#: The same classes by all pairs of texts that share a shingle, for small tables. Candidate groups go by md5 here, another
#: sample of the same kind: shares of common shingles differ a little, classes only where a pair is that near to SIMILAR.
ORACLE = rf"""
WITH RECURSIVE rep AS (SELECT text, min(doc_id) AS node, count(*) AS n FROM documents GROUP BY text),
w AS (SELECT node, n, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{{80}}-\x{{10ffff}}]+') AS ws FROM rep),
s AS (
  SELECT node, n, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle FROM w),
t AS (SELECT node, n, shingle, 1 + ln(count(*)) AS tf FROM s GROUP BY node, n, shingle),
g AS (SELECT node, any_value(n) AS n, min(md5(shingle)) AS grp FROM t GROUP BY node),
part AS (SELECT node, n / sum(n) OVER (PARTITION BY grp) AS part FROM g),
x AS (SELECT node, shingle, tf * ln(1 + 1 / greatest(sum(part) OVER (PARTITION BY shingle) / (SELECT sum(part) FROM part), {LEAST_SHARE})) AS weight FROM t JOIN part USING (node)),
total AS (SELECT node, sum(weight) AS weight FROM x GROUP BY node),
pair AS (SELECT a.node AS a, b.node AS b, sum(least(a.weight, b.weight)) AS shared FROM x a JOIN x b ON a.shingle = b.shingle AND a.node < b.node GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN total p ON p.node = a JOIN total q ON q.node = b WHERE shared >= 0.8 * (p.weight + q.weight - shared)),
arc AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reached AS (SELECT a, b FROM arc UNION SELECT r.a, arc.b FROM reached r JOIN arc ON r.b = arc.a),
class AS (SELECT rep.text, least(node, coalesce(min(b), node)) AS class_id FROM rep LEFT JOIN reached ON a = node GROUP BY rep.text, node)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_rows, doc_id = class_id AS kept
FROM documents d JOIN class c ON d.text IS NOT DISTINCT FROM c.text
"""
