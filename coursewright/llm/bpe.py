"""Byte-level BPE: each distinct word of the corpus is encoded once, and ids go back to their places.

A task cuts its texts by the pattern and packs them into blocks: the block's distinct words, and for
each place of a text the number of its word. The words, sorted into parts by a hash, are shuffled
part by part, so that all copies of a word meet in one task, which encodes it once, however many
blocks have it. What comes back is joined with the blocks, which are stored in buckets by block and are not
shuffled, and ids are put in the order of the places. A word that a third of all places have is one
entry of each block. Decoding joins ids with the table of token bytes, which the vocabulary bounds, by
index inside each batch.

The vocabulary is a file of ranks (base64 of the bytes, blank, rank, line by line); the pattern is
matched with the character classes of the library whose files these are, where those of the regex
module differ.

Defined results: a null text is empty; an empty text has no ids. Control strings of a vocabulary
in a text are ordinary text. A very long text is a block of its own and takes memory for all of its words. Rows that repeat
give rows that repeat. No rows: no rows. Only the columns asked for are carried, under their own names.
In decoding, a null array of ids and one with an id that the table lacks give null.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursewright.llm.common import blocks, bucketed, buffers, in_arrow, partitions, spare

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Text bytes of a block.
BLOCK_BYTES = 4 << 20
#: Level of compression of what is shuffled.
LEVEL = 9
#: The classes that patterns are made of, and a character of each that has no other part in a pattern.
CLASSES = ((r"\p{L}", "é"), (r"\p{N}", "1"), (r"\s", "\t"))
NO_CLASS = "!"


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@functools.cache
def stand_ins() -> dict[int, str]:
    """Characters of other classes in the tokenizer library than in the regex module, and what to read in their place."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    singles = {bytes([i]): i for i in range(256)}

    def theirs(kind: str) -> set[str]:
        library = tiktoken.Encoding(kind, pat_str=kind, mergeable_ranks=singles, special_tokens={})
        return set(library.decode_bytes(library.encode_ordinary(every)).decode())

    of_class = {kind: theirs(kind) for kind, _ in CLASSES}
    differ = sorted(set().union(*(of_class[kind] ^ set(regex.findall(kind, every)) for kind, _ in CLASSES)))
    return {ord(c): next((s for kind, s in CLASSES if c in of_class[kind]), NO_CLASS) for c in differ}


def splitter(pattern: str):
    """A function from a text to its words: the matches of the pattern, in order."""
    words = regex.compile(pattern)
    instead = stand_ins()
    odd = frozenset(map(chr, instead))

    def split(text: str) -> list[str]:
        if text.isascii() or odd.isdisjoint(text):
            return words.findall(text)
        return [text[m.start() : m.end()] for m in words.finditer(text.translate(instead))]

    return split


def pack(items: pa.Array) -> bytes:
    """Texts as compressed bytes: their number, their lengths, their UTF-8."""
    raw, at = buffers(items)
    return zstandard.compress(np.concatenate([np.array([len(items)]), np.diff(at)]).astype("<u4").tobytes() + raw.tobytes(), LEVEL)


def unpack(data: bytes) -> list[bytes]:
    whole = zstandard.decompress(data)
    n = int.from_bytes(whole[:4], "little")
    ends = 4 * (n + 1) + np.cumsum(np.frombuffer(whole, "<u4", n, 4), dtype=np.int64)
    return [whole[a:b] for a, b in zip([4 * (n + 1), *ends[:-1].tolist()], ends.tolist(), strict=True)] if n else []


def narrow(numbers: list[int]) -> np.ndarray:
    """As unsigned numbers of one, two or four bytes."""
    wide = np.array(numbers, "<u4")
    width = next(w for w in (1, 2, 4) if wide.max(initial=0) < 1 << 8 * w)
    return wide.astype(f"<u{width}")


def pack_ids(ids: list[list[int]]) -> bytes:
    """The ids of words as compressed bytes: how many and of which width, how many of each word, the ids."""
    sizes, flat = narrow([len(word) for word in ids]), narrow([i for word in ids for i in word])
    head = np.array([len(ids), sizes.itemsize, flat.itemsize], "<u4")
    return zstandard.compress(head.tobytes() + sizes.tobytes() + flat.tobytes(), LEVEL)


def unpack_ids(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each word, and all ids in a row."""
    whole = zstandard.decompress(data)
    n, size_width, width = np.frombuffer(whole, "<u4", 3).tolist()
    at = 12 + n * size_width
    return np.frombuffer(whole[12:at], f"<u{size_width}").astype(np.int64), np.frombuffer(whole[at:], f"<u{width}").astype(np.int64)


def coded(docs: DataFrame, keep: list[str], pattern: str, parts: int) -> DataFrame:
    """A row per block: block, docs (the columns ``keep``), counts (words of each text), codes (number of each word), words by part."""
    fields = [docs.schema[c] for c in keep]
    (text,) = spare(keep, "text")
    kinds = T.StructType(fields)
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("docs", T.ArrayType(kinds)),
            T.StructField("counts", T.BinaryType()),
            T.StructField("codes", T.BinaryType()),
            T.StructField("words", T.ArrayType(T.StructType([T.StructField("part", T.IntegerType()), T.StructField("said", T.BinaryType())]))),
        ]
    )

    def block_of(number: int, held: list[pa.RecordBatch], split) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        said = [split(t or "") for t in whole.column(text).to_pylist()]
        counts = np.array([len(w) for w in said], "<u4")
        found = pa.array([w for one in said for w in one], pa.large_string()).dictionary_encode()
        del said
        part = np.array([zlib.crc32(w.encode()) % parts for w in found.dictionary.to_pylist()], np.int64)
        order = np.asarray(pc.sort_indices(pa.table({"part": part, "word": found.dictionary}), [("part", "ascending"), ("word", "ascending")]))
        codes = np.empty(len(order), np.int64)
        codes[order] = np.arange(len(order))
        sorted_words, cuts = found.dictionary.take(pa.array(order)), np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
        words = [{"part": int(part[order[a]]), "said": pack(sorted_words[a:b])} for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        kept = [whole.column(c).combine_chunks() for c in keep]
        struct = pa.StructArray.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in kept], keep)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(struct)], pa.int32()), struct),
                pa.array([zstandard.compress(counts.tobytes())], pa.binary()),
                pa.array([zstandard.compress(codes[np.asarray(found.indices)].astype("<u4").tobytes(), LEVEL)], pa.binary()),
                pa.array([words], pa.list_(pa.struct([("part", pa.int32()), ("said", pa.binary())]))),
            ],
            ["block", "docs", "counts", "codes", "words"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(pattern)
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in blocks(batches, text, BLOCK_BYTES):
            more = pc.sum(pc.binary_length(batch.column(text))).as_py() or 0
            if held and size + more > BLOCK_BYTES:
                yield block_of(number, held, split)
                number, held, size = number + 1, [], 0
            held.append(batch)
            size += more
        if held:
            yield block_of(number, held, split)

    return in_arrow(docs.select(*keep, F.col("text").alias(text)), work, schema)


def encode(docs: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of all rows, and ``ids``, the token ids of the text in order."""
    spark = docs.sparkSession
    ranks = ranks_of(vocabulary or public_tokenizers.path(VOCABULARY))
    kept, n = list(keep), partitions(spark)
    (ids_name,) = spare(kept, "ids")
    table = bucketed(coded(docs, kept, pattern, n), "bpe_blocks", n, "block")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        known: dict[bytes, list[int]] = {}

        def ids_of(word: bytes) -> list[int]:
            got = known.get(word)
            if got is None:
                got = known[word] = merges.encode_ordinary(word.decode())
            return got

        for batch in batches:
            ids = [pack_ids([ids_of(w) for w in unpack(said)]) for said in batch.column("said").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("part"), pa.array(ids, pa.binary())], ["block", "part", "ids"])

    words = table.select("block", F.explode("words").alias("w")).select("block", "w.part", "w.said")
    dealt = words.repartitionById(n, F.col("part"))
    back = in_arrow(dealt, encoded, "block long, part int, ids binary").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "ids"))).alias("pieces"))
    fields = [docs.schema[c] for c in kept]
    schema = T.StructType([*fields, T.StructField(ids_name, T.ArrayType(T.IntegerType()))])

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                counts, codes = (np.frombuffer(zstandard.decompress(batch.column(c)[i].as_py()), "<u4").astype(np.int64) for c in ("counts", "codes"))
                pieces = [unpack_ids(p["ids"]) for p in batch.column("pieces")[i].as_py() or []]
                sizes = np.concatenate([np.zeros(0, np.int64), *(s for s, _ in pieces)])
                flat = np.concatenate([np.zeros(0, np.int64), *(f for _, f in pieces)])
                n_ids = sizes[codes]
                ends = np.cumsum(n_ids)
                at = np.arange(ends[-1] if len(ends) else 0) + np.repeat((np.cumsum(sizes) - sizes)[codes] - (ends - n_ids), n_ids)
                bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
                ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat[at], pa.int32()))
                rows = batch.column("docs")[i].values
                for lo, hi in runs(bounds):
                    yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in rows.flatten()), ids[lo:hi]], [*kept, ids_name])

    return in_arrow(table.drop("words").join(back.hint("merge"), "block", "left"), assembled, schema)


def runs(bounds: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Spans of rows with ``most`` ids at most, or of one row."""
    part = bounds[1:] // most
    lo = 0
    for _, same in groupby(part.tolist()):
        hi = lo + sum(1 for _ in same)
        yield lo, hi
        lo = hi


def token_bytes(ranks: dict[bytes, int]) -> pa.Array:
    """The bytes of each id, null where there are none."""
    by_id = {rank: token for token, rank in ranks.items()}
    return pa.array([by_id.get(i) for i in range(max(by_id, default=-1) + 1)], pa.binary())


def decode(rows: DataFrame, vocabulary: str | None = None, ids: str = "ids") -> DataFrame:
    """The rows with ``decoded``, the bytes that the column ``ids`` stands for."""
    table = token_bytes(ranks_of(vocabulary or public_tokenizers.path(VOCABULARY)))
    (name,) = spare(rows.columns, "decoded")
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(ids)
            flat = lists.flatten()
            inside = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(table)))
            said = table.take(pc.if_else(inside, flat, pa.scalar(None, flat.type)))
            at = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))])
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), said), b"")
            joined = pc.if_else(pc.is_valid(lists), joined, pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns, joined], [*batch.schema.names, name])

    return in_arrow(rows, work, schema)


def query(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Numbers and digests of the ids of each whole text, and the digest of what they decode to."""
    rows = decode(encode(docs, vocabulary), vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat, at = np.asarray(lists.flatten()).astype("<u4"), np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))])
            ids = [hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            said = [hashlib.sha256(d.as_buffer()).hexdigest() for d in batch.column("decoded")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(ids), pa.array(said)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(rows, work, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
