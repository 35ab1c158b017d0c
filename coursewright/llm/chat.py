"""Chat formatting: a finite-state machine over roles, driven by a declarative template.

``format_conversations`` emits a conversation as rows of text segments, each with a loss
flag. Rows are sorted by conversation and turn within hash partitions and read as a
stream, so a task holds one turn, however long its conversation is. Inside texts a
backslash breaks every control string and doubles every backslash, which ``read_back``
undoes.

Defined results: a null text is an empty one; a null role is the empty role. A role that the
template doesn't name gets the ``other`` frame, with the role percent-encoded. A turn that
the machine doesn't allow is formatted all the same and named in ``error``. Rows that
repeat are turns of their own, in order of (turn, role, text); null turns come first; a null
conv_id is a conversation; which of two equal turns comes first does not show. A very long text is
one turn, which a task holds as a whole. No rows: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursewright.llm.common import in_arrow, partitions

#: frames: what stands before and after a role's text, and whether the text is trained on.
#: next: the roles that may follow a state; the state after a turn is its role, '' the start.
TEMPLATE = {
    "frames": {
        "system": {"before": "<<SYS>>", "after": "<</SYS>>", "loss": False},
        "user": {"before": "[INST]", "after": "[/INST]", "loss": False},
        "assistant": {"before": "<s>", "after": "</s>", "loss": True},
        "other": {"before": "[ROLE={}]", "after": "[/ROLE]", "loss": False},
    },
    "next": {"": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]},
}

SEGMENTS = "conv_id long, segment long, turn long, text string, loss boolean, error string"
#: Segments that a task sends at once, and their characters.
BATCH_ROWS, BATCH_CHARS = 2048, 1 << 20


class Format:
    """Escapes and frames for one template."""

    def __init__(self, template: dict):
        self.frames, self.next = template["frames"], template["next"]
        opened = [f["before"].split("{}")[0] for f in self.frames.values()]
        control = sorted({*opened, *(f["after"] for f in self.frames.values())}, key=lambda x: (-len(x), x))
        self.control = re.compile("|".join(map(re.escape, control)))
        self.unsafe = re.compile("|".join([r"\\", *map(re.escape, control)]))
        self.before = {role: f["before"] for role, f in self.frames.items() if role != "other"}
        self.role_of = {text: role for role, text in self.before.items()}
        self.other = self.frames["other"]["before"].split("{}")

    def escape(self, text: str) -> str:
        return self.unsafe.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        frame = self.frames[role if role in self.before else "other"]
        before = frame["before"] if role in self.before else frame["before"].format(quote(role, safe=""))
        return [(before, False), (self.escape(text), frame["loss"]), (frame["after"], False)]

    def step(self, state: str, role: str) -> tuple[str, str | None]:
        """The next state, and what is wrong with the turn."""
        allowed = self.next.get(state, [])
        fault = None if role in allowed else f"{role or 'no role'} after {state or 'the start'}"
        return (role if role in self.next else state), fault


class Reader:
    """Reads formatted text back from its characters: (role, text, text under the loss mask) for each turn that ends.

    Where turns begin and end is found by their control strings alone, however the text comes
    in pieces; texts are escaped, so the first control string in a turn is its end.
    """

    def __init__(self, form: Format):
        self.form, self.raw, self.spans = form, "", []

    def opened(self) -> tuple[str, int] | None:
        """The role of the turn, and where its text begins."""
        form, raw = self.form, self.raw
        head, tail = form.other
        if raw.startswith(head) and (end := raw.find(tail, len(head))) >= 0:
            return unquote(raw[len(head) : end]), end + len(tail)
        for before, role in form.role_of.items():
            if raw.startswith(before):
                return role, len(before)
        if not any(x.startswith(raw) or raw.startswith(x) for x in (head, *form.role_of)):
            raise ValueError(f"no turn begins with {raw[:40]!r}")
        return None

    def feed(self, text: str, loss: bool) -> tuple[str, str, str] | None:
        form = self.form
        self.raw += text
        self.spans.append((len(text), loss))
        if not (opened := self.opened()) or not (end := form.control.search(self.raw, opened[1])):
            return None
        role, start = opened
        if end[0] != form.frames[role if role in form.before else "other"]["after"]:
            raise ValueError(f"a control string inside a turn: {end[0]!r}")
        at, trained, left = 0, [], []
        for n, masked in self.spans:
            trained += [self.raw[max(at, start) : min(at + n, end.start())]] if masked else []
            left += [(at + n - max(at, end.end()), masked)] if at + n > end.end() else []
            at += n
        turn = role, form.unescape(self.raw[start : end.start()]), form.unescape("".join(trained))
        self.raw, self.spans = self.raw[end.end() :], left
        return turn


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def sent(rows: Iterator[tuple], schema: pa.Schema, text_at: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows in batches of bounded size."""
    held, chars = [], 0

    def batch():
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        chars += len(row[text_at]) if text_at is not None else 0
        if len(held) >= BATCH_ROWS or chars >= BATCH_CHARS:
            yield batch()
            held, chars = [], 0
    if held:
        yield batch()


SEGMENT_SCHEMA = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("turn", pa.int64()), ("text", pa.string()), ("loss", pa.bool_()), ("error", pa.string())])


def format_conversations(conversations: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """conv_id, segment (from 0), turn (from 0), text, loss, error: joined in order of segment, the texts of a conversation are its formatted form."""

    def work(batches):
        form = Format(template)

        def rows():
            here, state, turn, n = object(), "", 0, 0
            for conv, _, role, text in rows_of(batches):
                if conv != here:
                    here, state, turn, n = conv, "", 0, 0
                role = role or ""
                state, fault = form.step(state, role)
                for i, (piece, loss) in enumerate(form.segments(role, text or "")):
                    yield conv, n, turn, piece, loss, fault if i == 0 else None
                    n += 1
                turn += 1

        return sent(rows(), SEGMENT_SCHEMA, 3)

    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    ordered = turns.repartition(partitions(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return in_arrow(ordered, work, SEGMENTS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_errors long"
DIGEST_SCHEMA = pa.schema([(c, pa.string() if "sha256" in c else pa.int64()) for c in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_errors")])


def read_back(segments: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """A row of digests for each conversation, from its segments in the order in which ``format_conversations`` emits them."""

    def work(batches):
        form = Format(template)

        def rows():
            here, digest = object(), None
            for conv, segment, _, text, loss, fault in rows_of(batches):
                if segment == 0:
                    if digest:
                        yield digest()
                    here, n, turns, trained, chars, formatted, errors = conv, 0, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                    reader = Reader(form)
                    digest = lambda: (here, n, turns.hexdigest(), chars, trained.hexdigest(), formatted, errors)
                formatted += len(text)
                errors += fault is not None
                if turn := reader.feed(text, loss):
                    role, said, learned = turn
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
                    trained.update(learned.encode())
                    chars += len(learned)
            if digest:
                yield digest()

        return sent(rows(), DIGEST_SCHEMA)

    return in_arrow(segments, work, DIGESTS)


#: The conversation that the query adds: control strings as texts.
PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"


def query(conversations: DataFrame) -> DataFrame:
    probe = conversations.sparkSession.createDataFrame([(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(conversations.select("conv_id", "turn", "role", "text").unionByName(probe)))


#: The same digests in SQL; an escape adds one character to each backslash and control string.
ORACLE = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PROBE_ID}, 0, 'user', '{PROBE_TEXT}' UNION ALL SELECT {PROBE_ID}, 1, 'assistant', '{PROBE_TEXT}'),
t AS (
  SELECT *, lag(role) OVER w AS before,
    len(text) + len(regexp_extract_all(text, '\\|<</SYS>>|<<SYS>>|\[/INST\]|\[/ROLE\]|\[INST\]|\[ROLE=|</s>|<s>'))
      + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 14 + len(url_encode(role)) END AS chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  count_if(NOT coalesce(CASE role WHEN 'system' THEN before IS NULL WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant') WHEN 'assistant' THEN before = 'user' END, false))::BIGINT AS n_errors
FROM t GROUP BY conv_id
"""
