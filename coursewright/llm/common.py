"""What the training-data operators share: scratch tables, Arrow text blocks, word hashes."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coursewright.scratch import discard, folder, shared_dir, stored

#: Text bytes that a Python task works on at once; one longer text makes a block of its own.
BLOCK_BYTES = 1 << 18

#: Bytes of an Arrow batch on its way to a Python task and back.
BATCH_SIZE, BATCH_BYTES, UNSET = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20, "1"

#: What separates words where an operator counts them: ASCII space, tab to carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def bucketed(df: DataFrame, name: str, n: int, *keys: str) -> DataFrame:
    """``stored`` in n buckets by the keys: a join on them does not shuffle it again."""
    spark = df.sparkSession
    named = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{named}"
    df.write.bucketBy(n, *keys).format("parquet").option("path", path).saveAsTable(named)
    folder(spark, path, lambda fs, at: fs.deleteOnExit(at))
    return spark.table(named)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spare(columns: list[str], *names: str) -> list[str]:
    """The names, each with so many underscores behind it that no column has it (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    """Number of runs of non-blank characters; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def texts_of(column: pa.Array) -> pa.Array:
    """A string array without nulls or offset, whose buffers can be read."""
    column = pc.fill_null(column, "")
    return pa.concat_arrays([column]) if column.offset else column


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the n + 1 offsets between them."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offs, data = texts.buffers()
    at = np.frombuffer(offs, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each part have ``limit`` bytes, or are one text."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        ends, lo = np.cumsum(sizes), 0
        while lo < len(sizes):
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def in_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with batches of BATCH_BYTES, unless the session has a size of its own (Spark's is 64 MB).

    A worker that waits for the next task gives back what Arrow holds for no array.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_SIZE, UNSET) == UNSET:
        conf.set(BATCH_SIZE, str(BATCH_BYTES))

    def then_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(then_release, schema)


#: Bits of a filter by key (2 MB), and of one of its parts, which is what Spark's bitmap functions make.
FILTER_BITS, PART_BITS = 1 << 24, 1 << 15


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """One row with a bit for the hash of each key, of FILTER_BITS bits however many keys there are; no row for no keys."""
    at = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    one = parts.agg(F.map_from_entries(F.collect_list(F.struct("part", "bits"))).alias("of"), F.count("*").alias("n")).filter("n > 0")
    whole = F.sequence(F.lit(1).cast("long"), F.lit(FILTER_BITS // PART_BITS).cast("long"))
    return one.select(F.transform(whole, lambda i: F.element_at("of", i)).alias("bits"))


def by_filter(df: DataFrame, key: str, filtered: DataFrame, may_be_in: bool) -> DataFrame:
    """The rows whose key may be among the filter's keys, or else those whose key is not.

    The filter is one row of bounded size, so this is a test of each row and no product; it
    saves a shuffle of the rows that don't matter, and when the bits are full it saves none.
    """
    (bits,) = spare(df.columns, "bits")
    at = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    part = F.element_at(bits, (at / PART_BITS).cast("int") + 1)
    within = at % PART_BITS
    byte = F.conv(F.hex(F.substring(part, (within / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.getbit(byte, (within % 8).cast("int")) == 1, F.lit(False))
    return df.join(F.broadcast(filtered.toDF(bits)), is_set, "left_semi" if may_be_in else "left_anti")


def bitmap(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    """A bit for the low bits of each long key, as bytes on the driver: of a fixed size however many keys there are."""
    at = F.pmod(F.col(key), F.lit(bits)) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()  # bits / PART_BITS at most
    whole = np.zeros(bits // 8, np.uint8)
    step = PART_BITS // 8
    for r in rows:
        whole[(r["part"] - 1) * step : r["part"] * step] = np.frombuffer(r["bits"], np.uint8)
    return whole


def in_bitmap(whole: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each uint64 key is set."""
    at = keys & np.uint64(8 * len(whole) - 1)
    return (whole[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


#: A key of more than this part of the rows is looked up in a broadcast table: there are fewer than HOT such keys.
HOT = 256


def look_up(rows: DataFrame, values: DataFrame, key: str, size: str | None = None) -> DataFrame:
    """``rows`` joined with ``values`` (one row a key) where few keys may hold a large part of all rows.

    Keys that more than 1 / HOT of the rows have meet a broadcast of fewer than HOT values, in
    place; a shuffle deals the others, none of which can fill a task. ``size`` names a column with
    the number of a row's key, where it is known.
    """
    (n,) = spare(rows.columns, "n")
    total = rows.count()
    if size is None:
        hot = rows.groupBy(key).agg(F.count("*").alias(n)).filter(F.col(n) * HOT > total).select(key)
    else:
        hot = rows.filter(F.col(size) * HOT > total).select(key).distinct()
    hot = stored(hot.join(values, key), "hot-keys")
    seen = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(values, key)
    return seen.unionByName(rest)


_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser on uint64."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


@functools.cache
def byte_tables(seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A random uint64 per byte value; whether a byte belongs to a word (ASCII letters and digits, and all of multi-byte characters)."""
    random = mix((np.arange(256, dtype=np.uint64) + np.uint64(1 + 256 * seed)) * _BASE)
    byte = np.arange(256)
    inside = (byte >= 128) | ((byte >= 48) & (byte <= 57)) | ((byte >= 65) & (byte <= 90)) | ((byte >= 97) & (byte <= 122))
    return random, inside


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd base modulo 2^64, and of its inverse."""
    if not _powers or len(_powers["up"]) <= n:
        size = max(n + 1, BLOCK_BYTES + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for key, base in (("up", _BASE), ("down", inverse)):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _powers[key] = np.cumprod(run, dtype=np.uint64)
    return _powers["up"], _powers["down"]


class Words:
    """The words of a block of lower-cased texts: hashes, byte spans and the text each belongs to.

    A word is a run of ASCII letters and digits and of non-ASCII characters.
    """

    def __init__(self, texts: pa.Array):
        lower = texts_of(pc.utf8_lower(pc.fill_null(texts, "")))
        raw, offs = buffers(lower)
        self.offsets = offs
        random, inside = byte_tables()
        n = len(raw)
        up, down = powers(n)
        is_word = inside[raw]
        change = np.empty(n + 1, bool)
        change[:1] = change[-1:] = False
        if n:
            change[0], change[-1] = is_word[0], is_word[-1]
            change[1:-1] = is_word[1:] != is_word[:-1]
        edges = np.flatnonzero(change)
        # a text's border inside a run of word bytes ends one word and begins another
        inner = offs[1:-1]
        inner = np.unique(inner[(inner > 0) & (inner < n)])
        inner = inner[is_word[inner] & is_word[inner - 1]] if n else inner
        if len(inner):
            edges = np.sort(np.concatenate([edges, inner, inner]), kind="stable")
        self.start, self.end = edges[0::2], edges[1::2]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(random[raw] * up[:n], out=sums[1:])
        self.sums, self.down = sums, down
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start])
        self.text = np.searchsorted(offs, self.start, side="right") - 1
        #: text i has words first[i] to first[i + 1]
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))

    def __len__(self) -> int:
        return len(self.hash)

    def prefix_hash(self, at: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the first k bytes of the words ``at``, which have as many."""
        first = self.start[at]
        return mix((self.sums[first + k] - self.sums[first]) * self.down[first] + np.uint64(k))

    def grams(self, n: int, whole_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words within a text, and the index of the first word of each.

        With ``whole_short`` a text of fewer than n words gives one run of all its words.
        """
        count = len(self)
        if not count:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        left = self.first[self.text + 1] - np.arange(count)
        acc = np.zeros(count, np.uint64)
        for k in range(n):
            turn = np.uint64((2 * k + 3) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF | 1)
            if k == 0:
                acc += self.hash * turn
            elif k < count:
                acc[:-k] += np.where(left[:-k] > k, self.hash[k:] * turn, np.uint64(0))
        at = np.flatnonzero((left >= n) | (whole_short & (np.arange(count) == self.first[self.text])))
        return mix(acc[at]), at
