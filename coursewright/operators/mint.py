"""Minting of stable ids into raw lesson text, all other bytes left as they are.

A task parses a lesson, finds the ``id`` member of each card and exercise without a stable id
by a scan of the text, and inserts a member behind it. Minted ids are hashes of path, kind,
position and seed, so that a task that runs again mints the same.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

MINTED = "path string, ok boolean, minted int, eligible int, error string, new_text string"
TOKEN = re.compile(r'"(?:\\.|[^"\\])*"|[{}\[\],:]|[^\s{}\[\],:"]+', re.S)
INCOMPLETE = "incomplete mint: the scanner found {} of {} eligible element(s); refusing to write a partial mint"


def stable_id(path: str, kind: str, ordinal: int, seed: str) -> str:
    digest = hashlib.sha256(f"{path}|{kind}|{ordinal}|{seed}".encode()).hexdigest()
    return f"{'card' if kind == 'card' else 'ex'}-{digest[:12]}"


def eligible(lesson: dict) -> set[tuple[str, int]]:
    """(kind, position) of the cards and exercises without a stable id."""
    cards = {("card", i) for i, c in enumerate(lesson.get("cards") or []) if not (c or {}).get("stable_id")}
    steps = enumerate(lesson.get("steps") or [])
    return cards | {("exercise", i) for i, s in steps if (s or {}).get("exercise") and not s["exercise"].get("stable_id")}


def id_members(raw: str) -> Iterator[tuple[str, int, int, int]]:
    """(kind, position, start and end of the value) of each ``id`` member with a string value of a card or exercise."""
    path: list = []  # for each open bracket the key or index of what is being read in it
    is_key = False
    for token in TOKEN.finditer(raw):
        text = token[0]
        if text in "{[":
            path.append(None if text == "{" else 0)
            is_key = text == "{"
        elif text in "}]":
            path.pop()
        elif text == ",":
            is_key = not isinstance(path[-1], int)
            if not is_key:
                path[-1] += 1
        elif text[0] == '"' and is_key:
            path[-1], is_key = text[1:-1], False
        elif text[0] == '"' and path[-1:] == ["id"]:
            match path:
                case ["cards", int(i), _]:
                    yield "card", i, token.start(), token.end()
                case ["steps", int(i), "exercise", _]:
                    yield "exercise", i, token.start(), token.end()


def mint_text(path: str, raw: str, seed: str = "") -> tuple[bool, int, int, str | None, str | None]:
    """ok, minted, eligible, error, new text (null where nothing changes)."""
    try:
        wanted = eligible(before := json.loads(raw))
        found = [m for m in id_members(raw) if m[:2] in wanted]
    except (ValueError, AttributeError, TypeError, IndexError, RecursionError) as error:
        return False, 0, 0, str(error), None
    if len(found) != len(wanted):
        return False, 0, len(wanted), INCOMPLETE.format(len(found), len(wanted)), None
    if not found:
        return True, 0, 0, None, None
    parts, at = [], 0
    for kind, ordinal, start, end in found:
        member = f'"stable_id": "{stable_id(path, kind, ordinal, seed)}"'
        if re.match(r",\s*\n", raw[end:]):
            indent = re.match(r"[ \t]*", raw[raw.rfind("\n", 0, start) + 1 : start])[0]
            parts += [raw[at:end], f",\n{indent}{member}"]
        else:
            parts += [raw[at:end], f", {member}"]
        at = end
    new = "".join([*parts, raw[at:]])
    # everything but the stable ids must be as it was
    bare = lambda value: {k: bare(v) for k, v in value.items() if k != "stable_id"} if isinstance(value, dict) else [bare(v) for v in value] if isinstance(value, list) else value
    if json.dumps(bare(before)) != json.dumps(bare(json.loads(new))):
        return False, 0, len(wanted), "add-only proof failed: output differs beyond stable_id", None
    return True, len(found), len(wanted), None, new


def mint(raw: DataFrame, seed: str = "") -> DataFrame:
    """path, ok, minted, eligible, error, new_text of each row (path, raw)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *mint_text(p, r or "", seed)) for p, r in zip(batch["path"], batch["raw"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "ok", "minted", "eligible", "error", "new_text"])

    return raw.select("path", "raw").mapInPandas(work, MINTED)
