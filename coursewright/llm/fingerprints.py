"""Document fingerprints: content-defined chunks and the set of their digests.

Chunk borders are where a gear hash of the last 32 bytes is zero in its high bits:
normalised chunking asks for more zero bits before the normal size and for fewer behind it,
so sizes gather around the normal one, and a border depends on nearby text alone. A
fingerprint is the sorted set of chunks, each a 56-bit digest and its length, which is its
weight; likeness is containment: the weight of a text's chunks that are found in the other,
as a share of its own.

Neighbours are found without a global window: rows are dealt by ranges of doc_id, sorted
within tasks and read as a stream, and the first row of each range goes to the range before
as well.

Defined results: a null text is an empty one. An empty text has the empty fingerprint; two
empty ones are alike (1), an empty and another are not (0). Rows with equal or null doc_id
(null first) follow in order of text, equal rows in any order. A lone row is its own neighbour.
A very long text is one row of a task, chunked as a whole. No rows: no rows. Other columns are
not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursewright.llm.common import blocks, in_arrow, mix, partitions, spare

SMALLEST, NORMAL, LARGEST = 12, 32, 128
HARD_BITS, EASY_BITS = 6, 4
GEAR_WINDOW = 32
FIRST_KEY = -(1 << 63)


@functools.cache
def gears() -> np.ndarray:
    return (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """h[i] = sum of gear(raw[i - k]) << k over the last 32 bytes, by doubling."""
    h = gears()[raw]
    for s in (1, 2, 4, 8, 16):
        if s < len(h):
            h = np.concatenate([h[:s], h[s:] + (h[:-s] << np.uint32(s))])
    return h


def chunk_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The fingerprint of each text: sorted distinct (digest << 8 | length)."""
    gap = b"\0" * GEAR_WINDOW
    joined = gap.join([b"", *texts])
    h = gear_hashes(np.frombuffer(joined, np.uint8))
    easy = np.flatnonzero(h >> np.uint32(32 - EASY_BITS) == 0)
    hard = easy[h[easy] >> np.uint32(32 - HARD_BITS) == 0].tolist()
    easy = easy.tolist()
    end = len(joined) + LARGEST
    hard.append(end)
    easy.append(end)
    view, digest, out, at = memoryview(joined), xxhash.xxh3_64_intdigest, [], 0
    for text in texts:
        at += GEAR_WINDOW
        last, found = at + len(text), []
        while at < last:
            cut = hard[bisect_left(hard, at + SMALLEST - 1)] + 1
            if cut > at + NORMAL:
                cut = min(easy[bisect_left(easy, at + NORMAL)] + 1, at + LARGEST)
            if cut > last:
                cut = last
            found.append(digest(view[at:cut]) & ~0xFF | (cut - at))
            at = cut
        out.append(np.unique(np.array(found, np.uint64)))
    return out


def containment(one: np.ndarray, other: np.ndarray) -> float:
    """The share of one's weight that the other contains."""
    if not len(one) or not len(other):
        return float(len(one) == len(other))
    weight = one & np.uint64(0xFF)
    at = np.minimum(np.searchsorted(other, one), len(other) - 1)
    return float(weight[other[at] == one].sum()) / float(weight.sum())


def encoded(chunks: np.ndarray) -> str:
    return base64.b64encode(chunks.astype(">u8").tobytes()).decode()


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u8").astype(np.uint64)


def fingerprint(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of all rows, with fingerprint and n_chunks."""
    (said,) = spare(keep, "said")
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias(said))
    fields = rows.schema.fields[:-1]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["fingerprint string", "n_chunks long"])

    def work(batches):
        for batch in blocks(batches, said):
            sets = chunk_sets([t.encode() for t in batch.column(said).to_pylist()])
            own = [batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*own, pa.array(map(encoded, sets), pa.string()), pa.array(map(len, sets), pa.int64())], [f.name for f in fields] + ["fingerprint", "n_chunks"])

    return in_arrow(rows, work, schema)


def range_of(key: Column, borders: list[int]) -> Column:
    """The number of borders (sorted) at or below the key, by binary search: the plan has one array however many borders there are."""
    if not borders:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(borders).bit_length()))]
    at = F.array(*[F.lit(b) for b in borders])
    onward = lambda n, step: F.when((n + step <= len(borders)) & (F.get(at, n + step - 1) <= key), n + step).otherwise(n)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), onward)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, key, range, guest: sorted within one task per range; guests, the last rows of a task, are the next range's first."""
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_KEY)).alias("key"))
    cuts = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 10_000).alias("cuts")).first()["cuts"] if n > 1 else []
    rows = rows.withColumn("range", range_of(F.col("key"), sorted(set(cuts or []))))
    firsts = sorted((r["range"], r["key"]) for r in rows.groupBy("range").agg(F.min("key").alias("key")).collect())  # a row per task
    hosts = [(key, before) for (_, key), (before, _) in zip(firsts, firsts[-1:] + firsts[:-1], strict=True)]
    rows = rows.join(F.broadcast(spark.createDataFrame(hosts, "key long, host int")), "key", "left")
    homes = F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("guest")))
    guests = F.when(F.col("host").isNotNull(), F.array(F.struct(F.col("host").alias("range"), F.lit(True).alias("guest")))).otherwise(F.array())
    dealt = rows.select("doc_id", "text", "key", F.explode(F.concat(homes, guests)).alias("home")).select("doc_id", "text", "key", "home.*")
    return dealt.repartitionById(n, F.col("range")).sortWithinPartitions("range", "guest", "key", "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
TYPES = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def query(docs: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done(rows: list[tuple]):
            """Results of all rows but the last and the guests, each beside the row that follows."""
            texts = [text for _, text, _ in rows]
            sets = chunk_sets([t.encode() for t in texts])
            own = [i for i in range(len(rows) - 1) if not rows[i][2]]
            changed = [edited(texts[i], texts[i + 1]).encode() for i in own]
            changed_sets = chunk_sets(changed)
            columns = [
                [rows[i][0] for i in own],
                [len(texts[i]) for i in own],
                [hashlib.sha256(t).hexdigest() for t in changed],
                [encoded(sets[i]) for i in own],
                [encoded(s) for s in changed_sets],
                [containment(sets[i], s) for i, s in zip(own, changed_sets, strict=True)],
                [containment(sets[i], sets[i + 1]) for i in own],
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, TYPES, strict=True)], schema=TYPES)

        for batch in blocks(batches):
            held += zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("guest").to_pylist(), strict=True)
            if len(held) > 1:
                yield done(held)
                held = held[-1:]

    return in_arrow(with_next(docs), work, SCHEMA)
