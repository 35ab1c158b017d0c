import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from coursewright.llm import bpe

PATH = public_tokenizers.path(bpe.VOCABULARY)
RANKS = bpe.ranks_of(PATH)
WHOLE = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def merged(word: bytes) -> list[int]:
    """The plain way: merge the pair of least rank, the first of equals, until none is left."""
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        rank, at = min((RANKS.get(a + b, len(RANKS)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == len(RANKS):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [RANKS[p] for p in parts]


def want(text: str | None):
    text = text or ""
    ids = WHOLE.encode_ordinary(text)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


ANY = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n'stdll  ՘\U0001f1e6\U00011de0aé1!")), max_size=60)


@settings(max_examples=400, deadline=None)
@given(ANY)
def test_words_are_those_of_the_library(text):
    words = bpe.splitter(public_tokenizers.PATTERN)(text)
    assert "".join(words) == text
    assert [i for w in words for i in merged(w.encode())] == WHOLE.encode_ordinary(text)


def test_stand_ins_cover_every_character():
    split = bpe.splitter(public_tokenizers.PATTERN)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c) != "'"]
    for lo in range(0, len(every), 4096):
        for before in ("a", "1", "!"):  # a character goes with what is before it if both are of one class
            text = "".join(f"{before}{c}\n" for c in every[lo : lo + 4096])
            assert [i for w in split(text) for i in WHOLE.encode_ordinary(w)] == WHOLE.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=9), max_size=9), st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=5), max_size=5))
def test_packed_is_unpacked(texts, ids):
    import pyarrow as pa

    assert bpe.unpack(bpe.pack(pa.array(texts, pa.large_string()))) == [t.encode() for t in texts]
    sizes, flat = bpe.unpack_ids(bpe.pack_ids(ids))
    assert sizes.tolist() == [len(w) for w in ids] and flat.tolist() == [i for w in ids for i in w]


@pytest.mark.parametrize("block", [200, 1 << 22])
def test_documents_as_the_library_encodes_them(spark, docs, monkeypatch, block):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", block)
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.query(docs.repartition(5)).collect())
    assert got == sorted((r.doc_id, *want(r.text)) for r in docs.collect())


def test_odd_texts(spark, odd):
    more = ["<|endoftext|>", "a" * 5000, " " * 3000 + "x", "՘՘x", "'S it's\r\n\r\n ", "\0\0", "=" * 1000, None, ""]
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(100 + i, t) for i, t in enumerate(more)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.query(docs).collect()]
    assert sorted(got, key=str) == sorted(((i, *want(t)) for i, t in rows), key=str)
    assert bpe.query(odd).count() == odd.count() and bpe.query(odd.limit(0)).collect() == []


def test_columns_are_kept_and_a_round_trip(spark, odd):
    other = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = odd.withColumnRenamed("bits", "ids")
    encoded = bpe.encode(rows, other, keep=("doc_id", "ids", "text", "source"))
    assert encoded.columns == ["doc_id", "ids", "text", "source", "ids_"]
    library = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(other), special_tokens={})
    for r in bpe.decode(encoded, other, "ids_").collect():
        assert bytes(r.decoded).decode() == (r.text or "") and r.ids_ == library.encode_ordinary(r.text or "") and r.ids == "x"


def test_each_word_is_encoded_once(spark):
    """The parts of words that come to one task are all that the corpus has of these words."""
    docs = spark.createDataFrame([(i, f" the word{i % 7} of" * 50) for i in range(100)], "doc_id long, text string").repartition(9)
    parts = bpe.coded(docs, ["doc_id"], public_tokenizers.PATTERN, 4)
    seen = {}
    for row in parts.collect():
        for w in row.words:
            for word in bpe.unpack(bytes(w.said)):
                seen.setdefault(word, set()).add(w.part)
    assert len(seen) == 10 and all(len(p) == 1 for p in seen.values())  # " the", " of", " word" and seven digits


def test_unknown_ids_decode_to_null(spark):
    rows = spark.createDataFrame([(1, [0, 1]), (2, [10**6]), (3, [-1]), (4, None), (5, []), (6, [None])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(rows).collect()}
    assert bytes(got[1]) == b'!"' and [got[i] for i in (2, 3, 4, 6)] == [None] * 4 and bytes(got[5]) == b""
