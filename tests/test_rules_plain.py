"""Rules as Columns beside the same rules in plain Python, on random exercises."""

import json
import random

from tests.test_rules import judged

WORDS = ["a", "b", " A", "", "___", "c___d", "______"]


def some(rng, make, most=4):
    return [make() for _ in range(rng.randint(0, most))] if rng.random() < 0.9 else None


def exercise(rng):
    word = lambda: rng.choice(WORDS)
    kind = rng.choice(["matching", "picture_choice", "free_text", "word_tiles", "cloze", "multiple_choice"])
    ex = {
        "id": "x",
        "type": kind,
        "prompt": "p",
        "from_cards": rng.choice([None, None, True, False]),
        "card_ids": [rng.choice(["c", "d"]) for _ in range(rng.randint(0, 2))],
        "pairs": some(rng, lambda: {"left": word(), "right": word()}),
        "images": some(rng, lambda: {"src": rng.choice(["a.png", "data:image/png;base64,aa"]), "label": word(), "is_correct": rng.choice([None, "true", "false"])}, 3),
        "accept": some(rng, word, 2),
        "distractors": some(rng, word, 2),
        "tiles": some(rng, word),
        "accept_orderings": some(rng, lambda: [rng.randint(0, 2) for _ in range(rng.randint(0, 3))], 2),
        "cloze_mode": rng.choice([None, "type", "select", "multiselect"]),
        "sentence": rng.choice([None, *WORDS]),
        "blanks": some(rng, lambda: {"accept": [word() for _ in range(rng.randint(0, 2))]}, 2),
        "multiple": rng.choice([None, True, False]),
        "options": some(rng, lambda: {"text": word(), "correct": rng.choice([None, True, False])}),
    }
    return {k: v for k, v in ex.items() if v is not None}


def repeated(xs):
    return len(set(xs)) != len(xs)


def plain(ex):
    out = ["E-CARD-REF" for c in ex["card_ids"] if c != "c"]
    get = lambda name: ex.get(name) or []
    kind = ex["type"]
    if kind == "matching":
        if ex.get("from_cards"):
            out += ["E-MATCH-FROMCARDS-CARDS"] * (not ex["card_ids"]) + ["E-MATCH-FROMCARDS-PAIRS"] * bool(get("pairs"))
        elif not get("pairs"):
            out.append("E-MATCH-PAIRS")
        else:
            left = [p["left"].strip().lower() for p in ex["pairs"]]
            out += ["E-MATCH-DUP-LEFT"] * sum(left.count(x) > 1 for x in dict.fromkeys(left))
            out += ["W-MATCH-AMBIG"] * repeated([p["right"] for p in ex["pairs"]])
    elif kind == "picture_choice":
        images = get("images")
        if len(images) < 2:
            return [*out, "E-PIC-MIN"]
        right = [i["label"] for i in images if i.get("is_correct") == "true"]
        out += ["E-PIC-ONE-CORRECT"] * (len(right) != 1)
        out += ["W-PIC-DUP-LABEL"] * any(i.get("is_correct") != "true" and i["label"] in right for i in images)
        out += ["W-PIC-DATA-URI"] * any(i["src"].startswith("data:") for i in images)
    elif kind == "free_text":
        out += ["E-FREETEXT-ACCEPT"] * (not get("accept"))
    elif kind == "word_tiles":
        tiles = get("tiles")
        if len(tiles) < 2:
            return [*out, "E-TILES-MIN"]
        out += ["W-TILES-DUP"] * (repeated(tiles) and ex.get("accept_orderings") is None)
        out += ["E-TILES-ORDERING" for o in get("accept_orderings") if sorted(o) != list(range(len(tiles)))]
    elif kind == "cloze" and ex.get("cloze_mode") == "multiselect":
        out += ["E-CLOZE-MS-SENTENCE"] * (not ex.get("sentence")) + ["E-CLOZE-MS-ACCEPT"] * (not get("accept"))
        out += ["E-CLOZE-MS-DISTRACTORS"] * (not get("distractors")) + ["E-CLOZE-MS-DISJOINT"] * bool(set(get("accept")) & set(get("distractors")))
    elif kind == "cloze":
        if not ex.get("sentence"):
            return [*out, "E-CLOZE-SENTENCE"]
        if not get("blanks"):
            return [*out, "E-CLOZE-BLANKS"]
        out += ["E-CLOZE-MARKERS"] * (ex["sentence"].count("___") != len(ex["blanks"]))
        if ex.get("cloze_mode") == "select":
            if not get("distractors"):
                return [*out, "E-CLOZE-SELECT-DISTRACTORS"]
            out += ["W-DISTRACTOR-ANSWER"] * bool(set(ex["distractors"]) & {a for b in ex["blanks"] for a in b["accept"]})
    else:
        options = get("options")
        if len(options) < 2:
            return [*out, "E-MC-OPTIONS"]
        right = sum(o.get("correct") is True for o in options)
        out += ["E-MC-MIN-CORRECT"] * (ex.get("multiple") is True and right == 0) + ["E-MC-ONE-CORRECT"] * (ex.get("multiple") is not True and right != 1)
        out += ["E-MC-DUP-OPTION"] * repeated([o["text"] for o in options])
    return out


def test_random_exercises(spark):
    rng = random.Random(11)
    drawn = [exercise(rng) for _ in range(600)]
    card = {"id": "c", "front": "f", "back": "b"}
    use = {"id": "u", "type": "exercise", "exercise": {"id": "u", "type": "free_text", "prompt": "p", "accept": ["a"], "card_ids": ["c"]}}
    lessons = [json.dumps({"id": "l", "title": "T", "cards": [card], "steps": [{"id": "s", "type": "exercise", "exercise": ex}, use]}) for ex in drawn]
    got = {int(r.path): r.ids for r in judged(spark, *lessons).selectExpr("path", "issues.id AS ids").collect()}
    wrong = [(i, plain(ex), got[i]) for i, ex in enumerate(drawn) if got[i] != plain(ex)]
    assert not wrong, wrong[:3]
    assert len({x for ids in got.values() for x in ids}) >= 25
