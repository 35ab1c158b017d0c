import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from coursewright.llm import trie
from coursewright.llm.common import table
from tests.duck import same
from tests.llm.conftest import SF

COLUMNS = [c.split()[0] for c in trie.SCHEMA.split(", ")]


def plain(rows):
    """Nodes by the prefixes of every rebuilt conversation, from (conv_id, turn, role, text)."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[: 2 * trie.DIGEST]
            by[c].append(((turn is not None, turn or 0, role, digest), (role, text)))
    own = {c: [t for _, t in sorted(turns)] for c, turns in by.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(own.get(c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5)), [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[made[c][:d]].append(c)
    children, saved, leaves = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, who in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(who) - 1) * (len(p[-1][1].encode()) if p else 0)
            leaves[p[:d]] += not children[p]
    for p, who in members.items():
        ends = ",".join(str(c) for c in who if len(made[c]) == len(p))
        yield who[0], len(p), members[p[:-1]][0] if p else None, len(who), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_query_gives_the_nodes_of_all_prefixes(spark):
    convs = table(spark, SF, "conversations")
    got = trie.query(convs.repartition(6))
    assert got.columns == COLUMNS
    assert rows_of(got) == sorted(plain([tuple(r) for r in convs.select("conv_id", "turn", "role", "text").collect()]), key=str)


def test_query_gives_the_rows_of_its_sql(spark):
    same(trie.query(table(spark, SF, "conversations")), trie.ORACLE, SF)


@pytest.mark.parametrize("seed", range(4))
def test_shapes(spark, seed):
    """Few texts, so that prefixes are shared at all depths and over the borders of blocks; many copies; short and empty conversations."""
    random = np.random.default_rng(seed)
    rows = []
    for c in range(-20, 150):
        kind = random.integers(4)
        base = random.integers(3)
        for t in range(int(random.integers(0, 12)) if kind else 3):
            said = "ab"[random.integers(2)] if kind == 1 else "same" if kind == 2 else f"{base}/{t // 4}"
            rows.append((int(c), t, "user" if t % 2 else "assistant", said))
    convs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert rows_of(trie.query(convs)) == sorted(plain(rows), key=str)


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, None, "user", "x"), (1, 0, "user", None), (1, 0, "user", "x"), (1, 0, "user", "x"), (None, 0, "user", "lost"), (2, 5, "u", "long " * 50_000),
        (-7, 1, "", ""), (-5, 1, "", ""), (10**15, 3, "a", "é"), (10**15 + 1, 3, "a", "é"),
    ]
    convs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, block int, key string, depth string")
    assert rows_of(trie.query(convs)) == sorted(plain(rows), key=str)
    assert trie.query(convs.limit(0)).collect() == [] and trie.query(convs.limit(0)).columns == COLUMNS
    alone = spark.createDataFrame([(3, 0, "u", "t")], "conv_id long, turn long, role string, text string")
    assert rows_of(trie.query(alone)) == sorted(plain([(3, 0, "u", "t")]), key=str)


def test_equal_conversations_are_one_sequence(spark):
    """Thousands of copies, whose ids are hashed in order over several chunks; short ones are whole heads of their group."""
    rows = [(c, t, "u", f"t{t}") for c in range(9000) for t in range(2)]
    convs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert rows_of(trie.query(convs)) == sorted(plain(rows), key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-1, 4), min_size=1, max_size=40), st.integers(0, 39), st.integers(1, 40))
def test_smaller_values_and_minima(values, lo, n):
    v = np.array(values)
    assert trie.smaller_before(v).tolist() == [max((k for k in range(i) if v[k] < v[i]), default=-1) for i in range(len(v))]
    lo = lo % len(v)
    hi = min(len(v), lo + n)
    assert trie.least_between(v, np.array([lo]), np.array([hi])).tolist() == [min(values[lo:hi])]
