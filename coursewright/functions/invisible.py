"""Characters that render as nothing: a cheap test on raw text, and where they are in parsed JSON."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (first, last, name) of the code points that count as invisible.
RANGES = [
    (0x0000, 0x0008, "CONTROL CHARACTER"),
    (0x000B, 0x000C, "CONTROL CHARACTER"),
    (0x000E, 0x001F, "CONTROL CHARACTER"),
    (0x007F, 0x007F, "DELETE"),
    (0x0080, 0x009F, "CONTROL CHARACTER"),
    (0x00AD, 0x00AD, "SOFT HYPHEN"),
    (0x200B, 0x200B, "ZERO WIDTH SPACE"),
    (0x200C, 0x200C, "ZERO WIDTH NON-JOINER"),
    (0x200D, 0x200D, "ZERO WIDTH JOINER"),
    (0x200E, 0x200E, "LEFT-TO-RIGHT MARK"),
    (0x200F, 0x200F, "RIGHT-TO-LEFT MARK"),
    (0x2028, 0x2028, "LINE SEPARATOR"),
    (0x2029, 0x2029, "PARAGRAPH SEPARATOR"),
    (0x202A, 0x202A, "LEFT-TO-RIGHT EMBEDDING"),
    (0x202B, 0x202B, "RIGHT-TO-LEFT EMBEDDING"),
    (0x202C, 0x202C, "POP DIRECTIONAL FORMATTING"),
    (0x202D, 0x202D, "LEFT-TO-RIGHT OVERRIDE"),
    (0x202E, 0x202E, "RIGHT-TO-LEFT OVERRIDE"),
    (0x2060, 0x206F, "INVISIBLE FORMAT CHARACTER"),
    (0xFEFF, 0xFEFF, "BYTE ORDER MARK"),
]
CLASS = "[" + "".join(f"\\u{a:04x}" if a == b else f"\\u{a:04x}-\\u{b:04x}" for a, b, _ in RANGES) + "]"
SHOWN = 5


def has_invisible(x: Column) -> Column:
    return F.coalesce(x.rlike(CLASS), F.lit(False))


def invisible_count(x: Column) -> Column:
    return F.coalesce(F.regexp_count(x, F.lit(CLASS)), F.lit(0))


def may_hide(raw: Column) -> Column:
    """Whether raw JSON has an invisible character, as it is or as an escape."""
    return has_invisible(raw) | F.coalesce(raw.rlike(r"\\[ubf]"), F.lit(False))


def _places(value, path: str):
    """(path, character) of the invisible characters in all strings of a value; keys are not looked at."""
    if isinstance(value, str):
        yield from ((path, c) for c in re.findall(CLASS, value))
    elif isinstance(value, dict):
        for key, entry in value.items():
            yield from _places(entry, f"{path}/{key}")
    elif isinstance(value, list):
        for i, entry in enumerate(value):
            yield from _places(entry, f"{path}/{i}")


def hidden_issues(value) -> list[dict]:
    """The issue of a lesson's parsed JSON, if there is one."""
    found = list(_places(value, ""))
    if not found:
        return []
    names = {ord(c): next(name for a, b, name in RANGES if a <= ord(c) <= b) for _, c in found}
    kinds = ", ".join(f"U+{c:04X} {name}" for c, name in sorted(names.items()))
    paths = list(dict.fromkeys(path for path, _ in found))
    more = f", and {len(paths) - SHOWN} more" if len(paths) > SHOWN else ""
    message = (
        f"lesson text contains invisible characters ({kinds}): {len(found)} {'occurrence' if len(found) == 1 else 'occurrences'} at {', '.join(paths[:SHOWN])}{more}. "
        "These usually arrive by pasting from a PDF or a web page; they are invisible when reading the file."
    )
    return [{"path": "", "message": message, "id": "W-INVISIBLE-CHAR", "severity": "warning", "doc_anchor": "author-lints"}]
