"""The lesson rules as Columns: arrays of issues over a typed lesson, row by row and without a shuffle.

A rule is a Column of array<issue>. Rules of one exercise are joined in the order in which an
author reads them; a rule that makes the following ones pointless ends its chain.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from coursewright.functions.textsem import count_of, falsy, folded, has_duplicate, is_true, json_list, markers, tells_length
from coursewright.schemas import ISSUES

Rule = Callable[[Column, Column], Column]


def none() -> Column:
    return F.array().cast(ISSUES)


def issue(rule: str, path: Column | str, message: Column | str, anchor: str) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    severity = "error" if rule[0] == "E" else "warning"
    return F.struct(
        text(path).alias("path"), text(message).alias("message"), F.lit(rule).alias("id"), F.lit(severity).alias("severity"), F.lit(anchor).alias("doc_anchor")
    )


def when(condition: Column, *issues: Column) -> Column:
    return F.when(is_true(condition), F.array(*issues).cast(ISSUES)).otherwise(none())


def first_of(condition: Column, issues: Column, otherwise: Column) -> Column:
    """``issues`` alone where the condition holds, else what follows in the chain."""
    return F.when(is_true(condition), issues).otherwise(otherwise)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once, however often the body names it, within lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def array_of(x: Column, kind: str = "array<string>") -> Column:
    return F.coalesce(x, F.array().cast(kind))


def matching(ex: Column, path: Column) -> Column:
    pairs, anchor = ex["pairs"], "matching"
    places = lambda keys, key: F.filter(F.transform(keys, lambda k, i: F.when(k == key, i + 1)), lambda i: i.isNotNull())
    groups = let(F.transform(pairs, lambda p: folded(p["left"])), lambda keys: F.transform(F.array_distinct(keys), lambda key: places(keys, key)))
    repeated = F.filter(groups, lambda g: F.size(g) > 1)
    dup_left = F.transform(
        repeated,
        lambda g: issue(
            "E-MATCH-DUP-LEFT",
            path,
            F.concat(
                F.lit("MATCHING left value '"),
                F.element_at(pairs, g[0])["left"],
                F.lit("' is repeated at positions "),
                F.array_join(g.cast("array<string>"), ", "),
                F.lit("; each left term must be unique (case-insensitive) so the pairing is solvable"),
            ),
            anchor,
        ),
    )
    rights = F.transform(pairs, lambda p: p["right"])
    from_cards = F.concat(
        when(count_of(ex["card_ids"]) == 0, issue("E-MATCH-FROMCARDS-CARDS", path, "MATCHING with 'from_cards' requires non-empty 'card_ids'", anchor)),
        when(count_of(pairs) > 0, issue("E-MATCH-FROMCARDS-PAIRS", path, "MATCHING with 'from_cards' must not also list explicit 'pairs'", anchor)),
    )
    listed = F.concat(
        dup_left.cast(ISSUES),
        when(has_duplicate(rights), issue("W-MATCH-AMBIG", path, "MATCHING has duplicate 'right' values (ambiguous pairing)", anchor)),
    )
    no_pairs = F.array(issue("E-MATCH-PAIRS", path, "MATCHING exercise requires non-empty 'pairs'", anchor)).cast(ISSUES)
    return first_of(ex["from_cards"], from_cards, first_of(count_of(pairs) == 0, no_pairs, listed))


def picture_choice(ex: Column, path: Column) -> Column:
    images, anchor = ex["images"], "picture_choice"
    right = F.filter(images, lambda i: is_true(i["is_correct"] == "true"))
    labels = F.transform(right, lambda i: i["label"])
    few = F.array(issue("E-PIC-MIN", path, "PICTURE_CHOICE requires at least 2 'images'", anchor)).cast(ISSUES)
    rest = F.concat(
        when(F.size(right) != 1, issue("E-PIC-ONE-CORRECT", path, "PICTURE_CHOICE must have exactly one image marked 'is_correct': 'true'", anchor)),
        when(
            F.exists(images, lambda i: ~is_true(i["is_correct"] == "true") & is_true(F.array_contains(labels, i["label"]))),
            issue("W-PIC-DUP-LABEL", path, "PICTURE_CHOICE distractor shares a 'label' with the correct image", anchor),
        ),
        when(
            F.exists(images, lambda i: is_true(i["src"].startswith("data:"))),
            issue(
                "W-PIC-DATA-URI",
                path,
                "PICTURE_CHOICE image uses an inline data URI; repo content should prefer a relative assets/ path (data URIs bloat the lesson JSON and the git history)",
                anchor,
            ),
        ),
    )
    return first_of(count_of(images) < 2, few, rest)


def free_text(ex: Column, path: Column) -> Column:
    return when(count_of(ex["accept"]) == 0, issue("E-FREETEXT-ACCEPT", path, "FREE_TEXT exercise requires non-empty 'accept'", "free_text"))


def word_tiles(ex: Column, path: Column) -> Column:
    tiles, anchor = ex["tiles"], "word_tiles"
    few = F.array(issue("E-TILES-MIN", path, "WORD_TILES requires at least 2 'tiles'", anchor)).cast(ISSUES)
    expected = F.sequence(F.lit(0), F.size(tiles) - 1)
    odd = F.filter(ex["accept_orderings"], lambda o: ~is_true(F.array_sort(o) == expected))
    orderings = F.transform(
        odd,
        lambda o: issue(
            "E-TILES-ORDERING",
            path,
            F.concat(F.lit("accept_orderings entry "), json_list(o), F.lit(" must be a permutation of [0.."), (F.size(tiles) - 1).cast("string"), F.lit("]")),
            anchor,
        ),
    )
    rest = F.concat(
        when(
            has_duplicate(tiles) & ex["accept_orderings"].isNull(),
            issue(
                "W-TILES-DUP",
                path,
                "WORD_TILES has duplicate tiles but no 'accept_orderings' - consumers that grade word tiles by tile index may grade a string-identical answer as wrong; consumers grading the token sequence need no annotation",
                anchor,
            ),
        ),
        F.coalesce(orderings.cast(ISSUES), none()),
    )
    return first_of(count_of(tiles) < 2, few, rest)


def cloze_multiselect(ex: Column, path: Column) -> Column:
    accept, distractors, anchor = array_of(ex["accept"]), array_of(ex["distractors"]), "cloze"
    both = F.filter(accept, lambda a: is_true(F.array_contains(distractors, a)))
    return F.concat(
        when(falsy(ex["sentence"]), issue("E-CLOZE-MS-SENTENCE", path, "CLOZE multiselect requires a non-empty 'sentence' (the question)", anchor)),
        when(F.size(accept) == 0, issue("E-CLOZE-MS-ACCEPT", path, "CLOZE multiselect requires non-empty 'accept' (the correct options)", anchor)),
        when(F.size(distractors) == 0, issue("E-CLOZE-MS-DISTRACTORS", path, "CLOZE multiselect requires non-empty 'distractors'", anchor)),
        when(
            F.size(both) > 0,
            issue("E-CLOZE-MS-DISJOINT", path, F.concat(F.lit("CLOZE multiselect 'accept' and 'distractors' must be disjoint; shared option(s): "), json_list(both)), anchor),
        ),
    )


def cloze(ex: Column, path: Column) -> Column:
    sentence, blanks, anchor = ex["sentence"], ex["blanks"], "cloze"
    alone = lambda rule, message: F.array(issue(rule, path, message, anchor)).cast(ISSUES)
    accepted = F.flatten(F.transform(blanks, lambda b: array_of(b["accept"])))
    found = markers(sentence)
    count = when(
        found != F.size(blanks),
        issue(
            "E-CLOZE-MARKERS",
            path,
            F.concat(F.lit("CLOZE marker count mismatch: sentence has "), found.cast("string"), F.lit(" '___' markers but blanks has "), F.size(blanks).cast("string"), F.lit(" entries")),
            anchor,
        ),
    )
    select = first_of(
        count_of(ex["distractors"]) == 0,
        alone("E-CLOZE-SELECT-DISTRACTORS", "CLOZE with cloze_mode='select' requires non-empty 'distractors'"),
        when(
            F.exists(ex["distractors"], lambda d: is_true(F.array_contains(accepted, d))),
            issue("W-DISTRACTOR-ANSWER", path, "CLOZE select has a distractor equal to an accepted answer", anchor),
        ),
    )
    rest = F.concat(count, F.when(is_true(ex["cloze_mode"] == "select"), select).otherwise(none()))
    typed = first_of(
        falsy(sentence),
        alone("E-CLOZE-SENTENCE", "CLOZE exercise requires non-empty 'sentence'"),
        first_of(count_of(blanks) == 0, alone("E-CLOZE-BLANKS", "CLOZE exercise requires non-empty 'blanks'"), rest),
    )
    return F.when(is_true(ex["cloze_mode"] == "multiselect"), cloze_multiselect(ex, path)).otherwise(typed)


def multiple_choice(ex: Column, path: Column) -> Column:
    options, anchor = ex["options"], "multiple_choice"
    right = F.size(F.filter(options, lambda o: is_true(o["correct"])))
    few = F.array(issue("E-MC-OPTIONS", path, "MULTIPLE_CHOICE requires at least 2 'options'", anchor)).cast(ISSUES)
    many = is_true(ex["multiple"])
    rest = F.concat(
        when(many & (right == 0), issue("E-MC-MIN-CORRECT", path, "MULTIPLE_CHOICE with 'multiple' requires at least one option marked 'correct'", anchor)),
        when(~many & (right != 1), issue("E-MC-ONE-CORRECT", path, "MULTIPLE_CHOICE (single) must have exactly one option marked 'correct'", anchor)),
        when(
            has_duplicate(F.transform(options, lambda o: o["text"])),
            issue("E-MC-DUP-OPTION", path, "MULTIPLE_CHOICE option texts must be unique (the text IS the option)", anchor),
        ),
    )
    return first_of(count_of(options) < 2, few, rest)


BY_TYPE: dict[str, Rule] = {
    "matching": matching,
    "picture_choice": picture_choice,
    "free_text": free_text,
    "word_tiles": word_tiles,
    "cloze": cloze,
    "multiple_choice": multiple_choice,
}


def required_majors(lesson: Column) -> Column:
    """(type, major) of the declared extensions, in order; entries without an integer behind the last @ are skipped."""
    entry = r"(?s)\A(.*)@([^@]*)\z"
    parts = F.transform(array_of(lesson["requires_extensions"]), lambda e: F.struct(F.regexp_extract(e, entry, 1).alias("type"), F.btrim(F.regexp_extract(e, entry, 2)).alias("tail"), e.contains("@").alias("at")))
    known = F.filter(parts, lambda p: p["at"] & p["tail"].rlike(r"\A([+-]?[0-9]{1,9}(\.0*)?)?\z"))
    return F.transform(known, lambda p: F.struct(p["type"].alias("type"), F.when(p["tail"] == "", 0).otherwise(p["tail"].cast("double").cast("int")).alias("major")))


def extension(ex: Column, path: Column, declared: Column, registry: dict, permissive: bool) -> Column:
    """Declared, then supported, then what the extension itself finds."""
    kind = ex["type"]
    own = F.filter(declared, lambda d: d["type"] == kind)
    undeclared = issue("E-EXT-UNDECLARED", path, F.concat(F.lit("exercise uses extension type '"), kind, F.lit("' but the lesson does not declare it in 'requires_extensions'")), "extensions")

    def judged(major: Column) -> Column:
        unsupported = issue("E-EXT-UNSUPPORTED", path, F.concat(F.lit("no registered extension for '"), kind, F.lit("@"), major.cast("string"), F.lit("'; the consumer cannot render this lesson")), "extensions")
        found = none() if permissive else F.array(unsupported).cast(ISSUES)
        for (name, version), validate in registry.items():
            found = F.when((kind == name) & (major == version), validate(ex).cast(ISSUES)).otherwise(found)
        return F.when(major.isNull(), F.array(undeclared).cast(ISSUES)).otherwise(found)

    return let(F.try_element_at(own, F.lit(-1))["major"], judged)


def exercise(ex: Column, path: Column, known: Column, declared: Column, registry: dict, permissive: bool = False) -> Column:
    unknown = F.filter(array_of(ex["card_ids"]), lambda c: ~is_true(F.array_contains(known, c)))
    refs = F.transform(
        unknown, lambda c: issue("E-CARD-REF", F.concat(path, F.lit("/card_ids")), F.concat(F.lit("exercise references unknown card '"), c, F.lit("'")), "cards")
    )
    hint = when(
        ~falsy(ex["hint"]) & tells_length(ex["hint"]),
        issue("W-HINT-LENGTH", path, "hint reveals the answer length - redundant on consumers that display the answer length automatically, revealing on the rest", "rule-catalog"),
    )
    own = none()
    for name, rule in BY_TYPE.items():
        own = F.when(ex["type"] == name, rule(ex, path)).otherwise(own)
    own = F.when(is_true(ex["type"].startswith("ext:")), extension(ex, path, declared, registry, permissive)).otherwise(own)
    return F.concat(refs.cast(ISSUES), hint, own)


def step(s: Column, path: Column, known: Column, declared: Column, registry: dict, permissive: bool = False) -> Column:
    theory = F.concat(
        when(falsy(s["body"]), issue("E-STEP-THEORY-BODY", path, "THEORY step requires non-empty 'body'", "steps")),
        when(s["exercise"].isNotNull(), issue("E-STEP-THEORY-EXERCISE", path, "THEORY step must not carry 'exercise'", "steps")),
    )
    missing = F.array(issue("E-STEP-EXERCISE-PAYLOAD", path, "EXERCISE step requires an 'exercise' payload", "steps")).cast(ISSUES)
    drill = F.concat(
        F.when(s["exercise"].isNull(), missing).otherwise(exercise(s["exercise"], F.concat(path, F.lit("/exercise")), known, declared, registry, permissive)),
        when(s["body"].isNotNull(), issue("E-STEP-EXERCISE-BODY", path, "EXERCISE step must not carry 'body' (use the exercise prompt instead)", "steps")),
    )
    return F.when(is_true(s["type"] == "theory"), theory).otherwise(drill)


def used_cards(lesson: Column) -> Column:
    """card_ids of all exercises, also those of theory steps."""
    return F.flatten(F.transform(F.coalesce(lesson["steps"], F.array()), lambda s: array_of(s["exercise"]["card_ids"])))


def card_ids(lesson: Column) -> Column:
    return F.transform(F.coalesce(lesson["cards"], F.array()), lambda c: c["id"])


def unused_cards(lesson: Column) -> Column:
    used = used_cards(lesson)
    return F.filter(card_ids(lesson), lambda c: ~is_true(F.array_contains(used, c)))


def unused(lesson: Column) -> Column:
    ids = unused_cards(lesson)
    noun = F.when(F.size(ids) == 1, "card is").otherwise("cards are")
    message = F.concat(F.size(ids).cast("string"), F.lit(" "), noun, F.lit(" defined but never referenced by an exercise: "), F.array_join(ids, ", "))
    return when(F.size(ids) > 0, issue("W-CARD-UNUSED", "/cards", message, "cards"))


def stable_elements(lesson: Column) -> Column:
    """(kind, element, stable_id) of the cards, then the exercises, that have a stable id."""
    one = lambda kind, x: F.struct(F.lit(kind).alias("kind"), F.coalesce(x["id"], F.lit("?")).alias("element"), x["stable_id"].alias("stable_id"))
    cards = F.transform(F.coalesce(lesson["cards"], F.array()), lambda c: one("card", c))
    steps = F.filter(F.coalesce(lesson["steps"], F.array()), lambda s: s["exercise"].isNotNull())
    return F.filter(F.concat(cards, F.transform(steps, lambda s: one("exercise", s["exercise"]))), lambda e: ~falsy(e["stable_id"]))


def stable_id_duplicates(lesson: Column) -> Column:
    elements = stable_elements(lesson)
    ids = F.transform(elements, lambda e: e["stable_id"])
    twice = F.filter(F.array_distinct(ids), lambda i: F.size(F.filter(ids, lambda j: j == i)) > 1)
    where = lambda i: F.array_join(F.transform(F.filter(elements, lambda e: e["stable_id"] == i), lambda e: F.concat(e["kind"], F.lit(" '"), e["element"], F.lit("'"))), ", ")
    return F.transform(
        twice,
        lambda i: issue(
            "E-STABLE-ID-DUP",
            "/",
            F.concat(F.lit("stable_id '"), i, F.lit("' is used more than once in this lesson ("), where(i), F.lit("); a stable_id identifies exactly one element")),
            "rule-catalog",
        ),
    ).cast(ISSUES)


def lesson_rules(lesson: Column, invisible: Column, registry: dict | None = None, permissive: bool = False, declared: Column | None = None) -> Column:
    """All semantic issues of a lesson, in order. ``invisible`` holds the issues of the walk over all its strings, ``declared`` its ``required_majors`` where they are computed already."""
    known, declared = card_ids(lesson), required_majors(lesson) if declared is None else declared
    steps = F.transform(
        F.coalesce(lesson["steps"], F.array()), lambda s, i: step(s, F.concat(F.lit("/steps/"), i.cast("string")), known, declared, registry or {}, permissive)
    )
    return F.concat(F.flatten(steps), unused(lesson), F.coalesce(invisible, none()), stable_id_duplicates(lesson))
