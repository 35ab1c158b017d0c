import hashlib
from bisect import bisect_right

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from coursewright.llm import fingerprints as fp


def plain_hash(raw: bytes, i: int) -> int:
    h = 0
    for b in raw[max(0, i - 31) : i + 1]:
        h = (h * 2 + int(fp.gears()[b])) % (1 << 32)
    return h


@settings(max_examples=30, deadline=None)
@given(st.binary(min_size=1, max_size=400))
def test_gear_hash_by_doubling(raw):
    got = fp.gear_hashes(np.frombuffer(raw, np.uint8))
    assert got.tolist() == [plain_hash(raw, i) for i in range(len(raw))]


def plain_chunks(text: bytes) -> list[bytes]:
    padded, out, at = b"\0" * fp.GEAR_WINDOW + text, [], fp.GEAR_WINDOW
    while at < len(padded):
        cut = min(at + fp.LARGEST, len(padded))
        for i in range(at + fp.SMALLEST - 1, cut):
            bits = fp.HARD_BITS if i < at + fp.NORMAL else fp.EASY_BITS
            if plain_hash(padded, i) >> (32 - bits) == 0:
                cut = i + 1
                break
        out.append(padded[at:cut])
        at = cut
    return out


def test_chunks_are_those_of_a_plain_reader():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 123, n, np.uint8)) for n in (0, 1, 12, 50, 900, 3000)] + ["äöü€".encode() * 300]
    for text, got in zip(texts, fp.chunk_sets(texts), strict=True):
        chunks = plain_chunks(text)
        assert b"".join(chunks) == text
        assert sorted(got.tolist()) == sorted({fp.xxhash.xxh3_64_intdigest(c) & ~0xFF | len(c) for c in chunks})


def test_shift_changes_little():
    rng = np.random.default_rng(2)
    text = bytes(rng.integers(97, 123, 20_000, np.uint8))
    a, b, c = fp.chunk_sets([text, b"a few bytes more " + text, bytes(rng.integers(97, 123, 20_000, np.uint8))])
    assert fp.containment(a, b) > 0.95 and fp.containment(a, c) == 0 and fp.containment(a, a) == 1
    assert (fp.decoded(fp.encoded(a)) == a).all()
    none = fp.chunk_sets([b""])[0]
    assert (fp.containment(none, none), fp.containment(none, a), fp.containment(a, none)) == (1.0, 0.0, 0.0)


def test_query_is_that_of_a_plain_reader(spark, docs):
    got = {r.doc_id: r for r in fp.query(docs.repartition(5)).collect()}
    rows = docs.orderBy("doc_id").collect()
    for r, n in zip(rows, rows[1:] + rows[:1], strict=True):
        text = fp.edited(r.text, n.text)
        assert len(text) <= len(r.text) and text.startswith(r.text[: len(r.text) - len(r.text) // 2])
        x, y, z = fp.chunk_sets([r.text.encode(), text.encode(), n.text.encode()])
        g = got[r.doc_id]
        assert (g.n_chars, g.edited_sha256) == (len(r.text), hashlib.sha256(text.encode()).hexdigest())
        assert (g.fingerprint, g.edited_fingerprint) == (fp.encoded(x), fp.encoded(y))
        assert (g.near_edited, g.near_next) == (fp.containment(x, y), fp.containment(x, z))


def test_a_lone_row_is_its_own_neighbour(spark):
    (row,) = fp.query(spark.createDataFrame([(7, "ab" * 200)], "doc_id long, text string")).collect()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(("ab" * 200).encode()).hexdigest()


def test_ranges_are_those_of_bisection(spark):
    rng = np.random.default_rng(3)
    keys = [(int(k),) for k in rng.integers(-50, 50, 200)] + [(fp.FIRST_KEY,)]
    rows = spark.createDataFrame(keys, "key long")
    for n in (0, 1, 2, 3, 7, 8, 9, 40):
        borders = sorted({int(b) for b in rng.integers(-50, 50, n)})
        got = rows.select("key", fp.range_of(rows["key"], borders).alias("range")).collect()
        assert [r.range for r in got] == [bisect_right(borders, r.key) for r in got]


def test_the_plan_of_three_thousand_ranges(spark):
    rows = spark.range(20_000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3000")
    try:
        dealt = fp.with_next(rows)
        assert "Exchange" in dealt._jdf.queryExecution().executedPlan().toString()
        few = dealt.filter("doc_id < 40").select("doc_id", "range", "guest").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    home = {r.doc_id: r.range for r in few if not r.guest}
    assert len(home) == 40 and len(set(home.values())) > 3
    assert all(r.range == home[r.doc_id - 1] for r in few if r.guest and r.doc_id)
