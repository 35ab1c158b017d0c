import copy
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from coursewright.llm import chat
from coursewright.llm.common import table
from tests.duck import same
from tests.llm.conftest import SF

FORM = chat.Format(chat.TEMPLATE)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("\\<>[]/sINSTYROLE= ok"), max_size=40))
def test_escape_is_reversible_and_hides_control_strings(text):
    assert FORM.unescape(FORM.escape(text)) == text
    assert not FORM.control.search(FORM.escape(text))


def plain(rows):
    by: dict = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(conv, []).append((role or "", text or ""))
    for conv, turns in by.items():
        said = "".join(t for r, t in turns if r == "assistant")
        yield conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()


def test_query_reads_back_what_went_in(spark):
    convs = table(spark, SF, "conversations")
    probe = [(chat.PROBE_ID, i, r, chat.PROBE_TEXT) for i, r in enumerate(("user", "assistant"))]
    want = sorted(plain([tuple(r) for r in convs.select("conv_id", "turn", "role", "text").collect()] + probe))
    got = sorted((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.query(convs.repartition(7)).collect())
    assert got == want


def test_query_gives_the_rows_of_its_sql(spark):
    same(chat.query(table(spark, SF, "conversations")), chat.ORACLE, SF)


def test_odd_turns(spark):
    rows = [
        (1, 0, "user", None), (1, 1, "assistant", "</s>\\"), (1, 1, "assistant", "</s>\\"), (1, None, "system", "[/INST]"), (1, 2, "to[o]l %", "x"), (1, 3, None, ""),
        (None, 0, "assistant", "a" * 100_000), (2, 0, "user", "u"), (2, 1, "user", "again"),
    ]
    convs = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    segments = chat.format_conversations(convs)
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    for conv, n, turns, chars, said in plain(rows):
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == (n, turns, chars, said)
    faults = [r.error for r in segments.filter("conv_id = 1 AND error IS NOT NULL").orderBy("segment").collect()]
    assert faults == ["assistant after assistant", "to[o]l % after assistant", "no role after assistant"]
    assert [r.error for r in segments.filter("conv_id = 2 AND error IS NOT NULL").collect()] == ["user after user"]
    assert chat.read_back(chat.format_conversations(convs.limit(0))).count() == 0
    whole = "".join(r.text for r in segments.filter("conv_id = 2").orderBy("segment").collect())
    assert whole == "[INST]u[/INST][INST]again[/INST]"


def test_templates_are_data(spark):
    other = copy.deepcopy(chat.TEMPLATE)
    other["frames"]["user"] = {"before": "<|u|>", "after": "<|end|>", "loss": True}
    convs = spark.createDataFrame([(1, 0, "user", "a<|u|>b")], "conv_id long, turn long, role string, text string")
    rows = chat.format_conversations(convs, other)
    assert [r.text for r in rows.orderBy("segment").collect()] == ["<|u|>", "a<\\|u|>b", "<|end|>"]
    assert chat.read_back(rows, other).first().loss_chars == 7


def test_reader_refuses_what_is_not_framed():
    reader = chat.Reader(FORM)
    with pytest.raises(ValueError, match="no turn begins"):
        reader.feed("text", False)
    reader = chat.Reader(FORM)
    reader.feed("[INST]", False)
    with pytest.raises(ValueError, match="control string"):
        reader.feed("a</s>b", False)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "x]y"]), st.text("<s>[/INST]\\ ok", max_size=12)), min_size=1, max_size=4), st.integers(1, 5))
def test_reader_does_not_need_the_segments(turns, n):
    pieces = [(c, loss) for role, text in turns for piece, loss in FORM.segments(role, text) for c in piece]
    reader, got = chat.Reader(FORM), []
    for i in range(0, len(pieces), n):  # pieces of n characters under one mask
        part = pieces[i : i + n]
        while part:
            same = [c for c, loss in part if loss == part[0][1]] if len({loss for _, loss in part}) == 1 else [part[0][0]]
            got.append(reader.feed("".join(same), part[0][1]))
            part = part[len(same) :]
    got = [t for t in got if t]
    assert [(r, t) for r, t, _ in got] == turns[: len(got)] and len(got) == len(turns)
    assert [learned for _, _, learned in got] == [t if r == "assistant" else "" for r, t in turns]
