import functools
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from coursewright.functions import textsem as t

SPACE = "\t\n\x0b\x0c\r        　﻿"


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.select("i", expr(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_trim_takes_every_space_and_the_byte_order_mark(spark):
    assert column(spark, [f"{SPACE}a {SPACE}b{SPACE}", "x\n", None], t.trimmed) == [f"a {SPACE}b", "x", None]


def test_falsy_and_blank(spark):
    assert column(spark, [None, "", " ", "a"], t.falsy) == [True, True, False, False]
    assert column(spark, [None, "", " ﻿", "a"], t.blank) == [True, True, True, False]


def test_markers_do_not_overlap(spark):
    assert column(spark, ["______", "_____", "a ___ b", "", None], t.markers) == [2, 1, 1, 0, 0]


def test_duplicates(spark):
    assert column(spark, [["a", "b", "a"], ["a"], [], None], t.has_duplicate, "array<string>") == [True, False, False, False]


def test_hints(spark):
    hints = ["vier Buchstaben", "4 letters", "FÜNF Zeichen", "a letter", "four", None]
    assert column(spark, hints, t.tells_length) == [True, True, True, False, False, False]


def test_code_units_order_differs_from_bytes(spark):
    names = ["！", "😀"]  # U+FF01 is behind the surrogates of U+1F600
    rows = spark.createDataFrame([(n,) for n in names], "x string")
    assert [r[0] for r in rows.orderBy(t.code_unit_key(F.col("x"))).collect()] == ["😀", "！"]


def test_whole_match_ends_at_the_end(spark):
    assert column(spark, ["a-b", "a\n", "", None, "ß-1", "A"], lambda x: t.matches_whole(x, r"[\p{Ll}\p{Nd}]+(-[\p{Ll}\p{Nd}]+)*")) == [True, False, False, False, True, False]
    assert column(spark, ["01-a.json", "a.json\n", "a"], t.file_stem) == ["01-a", "a.json\n", "a"]


def compared(a: str, b: str) -> int:
    """Numbers by value, everything else by code unit."""
    x, y = re.findall("[0-9]+|[^0-9]+", a), re.findall("[0-9]+|[^0-9]+", b)
    for p, q in zip(x, y, strict=False):
        if p[0] in "0123456789" and q[0] in "0123456789":
            if int(p) != int(q):
                return -1 if int(p) < int(q) else 1
        elif p != q:
            return -1 if p.encode("utf-16-be") < q.encode("utf-16-be") else 1
    return len(x) - len(y)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text("a-1020é😀", max_size=6), min_size=2, max_size=12))
def test_natural_order(spark, ids):
    rows = spark.createDataFrame(list(enumerate(ids)), "i int, x string")
    got = [r[0] for r in rows.orderBy(t.natural_key(F.col("x")), "i").select("x").collect()]
    assert got == sorted(ids, key=functools.cmp_to_key(compared))
