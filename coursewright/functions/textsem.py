"""Column helpers for text: trimming, falsiness, order and keys as the content format means them.

Every predicate is false, never null, for a null argument.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space at the ends of a text.
SPACES = "\\t\\n\\x0B\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
#: What in a hint tells the length of an answer.
NUMBER_WORDS = r"(?i)([0-9]+|zwei|drei|vier|f[üÜ]nf|sechs|sieben|acht|neun|zehn|two|three|four|five|six|seven|eight|nine|ten)"
UNIT_WORDS = r"(?i)(buchstabe|zeichen|letter|character)"
MARKER = "___"


def trimmed(x: Column) -> Column:
    """Without white space of any script, and without byte order marks, at both ends."""
    return F.regexp_replace(x, rf"\A[{SPACES}]+|[{SPACES}]+\z", "")


def folded(x: Column) -> Column:
    return F.lower(trimmed(x))


def falsy(x: Column) -> Column:
    """Missing, null or empty."""
    return F.coalesce(x, F.lit("")) == ""


def blank(x: Column) -> Column:
    return trimmed(F.coalesce(x, F.lit(""))) == ""


def is_true(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def count_of(x: Column) -> Column:
    """Size of an array, 0 for null."""
    return F.when(x.isNull(), 0).otherwise(F.size(x))


def has_duplicate(x: Column) -> Column:
    return is_true(F.size(F.array_distinct(x)) != F.size(x))


def markers(x: Column) -> Column:
    """How often the blank marker occurs, without overlap."""
    return F.size(F.split(F.coalesce(x, F.lit("")), MARKER)) - 1


def tells_length(x: Column) -> Column:
    return is_true(x.rlike(NUMBER_WORDS) & x.rlike(UNIT_WORDS))


def code_unit_key(x: Column) -> Column:
    """Sorts as UTF-16 code units do."""
    return F.encode(x, "UTF-16BE")


def natural_key(x: Column) -> Column:
    """Sorts runs of digits by their number and other runs by code units; ids that read the same are equal."""
    runs = F.regexp_extract_all(x, F.lit("[0-9]+|[^0-9]+"), F.lit(0))

    def key(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+", "")
        return code_unit_key(F.when(run.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 6, "0"), digits)).otherwise(run))

    return F.transform(runs, key)


def json_list(x: Column) -> Column:
    return F.to_json(x)


def matches_whole(x: Column, pattern: str) -> Column:
    return is_true(x.rlike(rf"\A{pattern}\z"))


def file_stem(x: Column) -> Column:
    return F.regexp_replace(x, r"\.json\z", "")
