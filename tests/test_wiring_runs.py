import random

from coursewright.operators import wiring


def test_runs_are_told_by_their_words_alone():
    text = "a  bc d é bc d é bc d e".encode()
    words = text.split(b" ")
    for n in range(1, 12):
        runs = {b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)}
        got = wiring.runs_of_words(text, [n]).tolist()
        assert len(got) == len(runs)
        assert {int(wiring.runs_of_words(r, [n])[0]) for r in runs} == set(got)
    assert set(wiring.runs_of_words(text, [1, 4]).tolist()) == {h for n in (1, 4) for h in wiring.runs_of_words(text, [n]).tolist()}
    assert len(wiring.runs_of_words(b"", [1])) == 1 and not len(wiring.runs_of_words(b"", [2, 3]))


def test_containment_by_runs_is_containment(spark, capsys, monkeypatch):
    monkeypatch.setattr(wiring, "HITS", 7)
    rng = random.Random(1)
    some = lambda n: " ".join(rng.choice(["x", "yy", "", "é", "zz"]) for _ in range(n))
    quotes = [(i, some(rng.randint(0, 30))) for i in range(60)] + [(60, None), (61, "")]
    cut = lambda q: q[rng.randint(0, len(q) // 2) : rng.randint(len(q) // 2, len(q))]
    cards = [(i, cut(quotes[i][1])) for i in range(60)] + [(60, None), (61, ""), (62, "x yy zz q"), (63, "é")]
    had, of = spark.createDataFrame(cards, "card_id long, text string"), spark.createDataFrame(quotes, "exercise_id long, quote string")
    found = wiring.keyed_containment(had, of)
    assert sorted(tuple(r) for r in found.collect()) == sorted((c, e, 1) for c, t in cards if t for e, q in quotes if q and t in q)
    found.explain()
    assert "arrays_zip" not in capsys.readouterr().out  # no lambda for each word of a text
