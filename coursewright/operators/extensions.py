"""Exercise extensions: payload rules, rendering and grading of seven types, as Columns over a VARIANT payload.

``REGISTRY`` maps (type, major) to a function from an exercise to array<issue>, the form that
plans.rules takes. A payload of the wrong shape has only its shape issue.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from coursewright.functions.textsem import blank, folded, has_duplicate, is_true
from coursewright.plans.rules import issue, none
from coursewright.schemas import ISSUES

QUESTION = "array<struct<prompt string, type string, options array<struct<text string, correct boolean>>, accept array<string>, points double, partial_credit boolean>>"
QUESTION_TYPES = ["multiple_choice", "free_text"]


def get(payload: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(payload, path, kind)


def kind_of(payload: Column, path: str) -> Column:
    """The variant type at a path, 'VOID' for null, SQL null where there is nothing."""
    return F.schema_of_variant(F.try_variant_get(payload, path, "variant"))


def is_string(payload: Column, path: str) -> Column:
    return is_true(kind_of(payload, path) == "STRING")


def is_number(payload: Column, path: str) -> Column:
    return is_true(kind_of(payload, path).rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"))


def is_strings(payload: Column, path: str) -> Column:
    kind = kind_of(payload, path)
    whole = F.when(kind == "ARRAY<STRING>", ~F.exists(get(payload, path, "array<string>"), lambda x: x.isNull()))
    return is_true(whole.when(kind == "ARRAY<VOID>", F.size(get(payload, path, "array<variant>")) == 0))


def strings(payload: Column, path: str) -> Column:
    return F.coalesce(get(payload, path, "array<string>"), F.array().cast("array<string>"))


def each_is(payload: Column, path: str, good) -> Column:
    """Whether there is an array at a path and ``good`` holds for all its elements (as variants)."""
    items = get(payload, path, "array<variant>")
    return is_true(kind_of(payload, path).startswith("ARRAY")) & is_true(F.forall(items, lambda v: is_true(good(v))))


def fault(rule: str, message: str) -> Column:
    return issue(rule, "/ext_payload", message, "extensions")


def listed(shaped: Column, shape: Column, *rules: tuple[Column, Column]) -> Column:
    found = F.array_compact(F.array(*[F.when(is_true(condition), one) for condition, one in rules])) if rules else none()
    return F.when(shaped, found.cast(ISSUES)).otherwise(F.array(shape).cast(ISSUES))


def any_blank(x: Column) -> Column:
    return F.exists(x, blank)


def no_answer(accept: Column) -> Column:
    return F.size(F.filter(accept, lambda a: ~blank(a))) == 0


def ordering(ex: Column) -> Column:
    p = ex["ext_payload"]
    items = strings(p, "$.items")
    return listed(
        is_strings(p, "$.items"),
        fault("E-EXT-REFORDER-ITEMS", "ext:ref-ordering requires 'ext_payload.items' as a string array"),
        (F.size(items) < 2, fault("E-EXT-REFORDER-MIN", "ext:ref-ordering requires at least 2 items")),
        (any_blank(items), fault("E-EXT-REFORDER-EMPTY", "ext:ref-ordering items must be non-empty")),
        (has_duplicate(items), fault("E-EXT-REFORDER-DUP", "ext:ref-ordering items must be unique (a duplicate makes the order ambiguous)")),
    )


def buckets(p: Column) -> Column:
    return F.coalesce(get(p, "$.categories", "array<struct<name string, items array<string>>>"), F.array().cast("array<struct<name string, items array<string>>>"))


def categorization_shaped(p: Column) -> Column:
    return each_is(p, "$.categories", lambda v: is_string(v, "$.name") & is_strings(v, "$.items"))


def categorization(ex: Column) -> Column:
    p = ex["ext_payload"]
    cats = buckets(p)
    items = F.flatten(F.transform(cats, lambda c: c["items"]))
    return listed(
        categorization_shaped(p),
        fault("E-EXT-REFCATEG-SHAPE", "ext:ref-categorization requires 'ext_payload.categories' as an array of {name, items[]}"),
        (F.size(cats) < 2, fault("E-EXT-REFCATEG-MIN", "ext:ref-categorization requires at least 2 categories")),
        (F.exists(cats, lambda c: F.size(c["items"]) == 0), fault("E-EXT-REFCATEG-ITEMS", "ext:ref-categorization categories need at least 1 item each")),
        (any_blank(items), fault("E-EXT-REFCATEG-EMPTY", "ext:ref-categorization items must be non-empty")),
        (has_duplicate(F.transform(cats, lambda c: c["name"])), fault("E-EXT-REFCATEG-DUPNAME", "ext:ref-categorization category names must be unique")),
        (has_duplicate(items), fault("E-EXT-REFCATEG-DUPITEM", "ext:ref-categorization items must appear in exactly one category (a duplicate makes grading ambiguous)")),
    )


def correction_shaped(p: Column) -> Column:
    return is_strings(p, "$.tokens") & is_number(p, "$.error_index") & is_strings(p, "$.accept")


def error_correction(ex: Column) -> Column:
    p = ex["ext_payload"]
    tokens, accept, index = strings(p, "$.tokens"), strings(p, "$.accept"), get(p, "$.error_index", "double")
    inside = is_true((index == F.floor(index)) & (index >= 0) & (index < F.size(tokens)))
    empty = (F.size(accept) == 0) | any_blank(accept)
    marked = F.get(tokens, index.cast("int"))
    return listed(
        correction_shaped(p),
        fault("E-EXT-REFERRCORR-SHAPE", "ext:ref-error-correction requires 'ext_payload' with tokens (string array), error_index (number), accept (string array)"),
        (F.size(tokens) < 2, fault("E-EXT-REFERRCORR-TOKENS", "ext:ref-error-correction requires at least 2 tokens")),
        (any_blank(tokens), fault("E-EXT-REFERRCORR-EMPTY", "ext:ref-error-correction tokens must be non-empty")),
        (~inside, fault("E-EXT-REFERRCORR-INDEX", "ext:ref-error-correction error_index must be an integer inside the token range")),
        (empty, fault("E-EXT-REFERRCORR-CORRECTION", "ext:ref-error-correction accept needs at least 1 non-empty correction")),
        (~empty & inside & F.array_contains(accept, marked), fault("E-EXT-REFERRCORR-NOOP", "ext:ref-error-correction accept entries must differ from the marked token (otherwise there is no error)")),
    )


def questions(p: Column) -> Column:
    return F.coalesce(get(p, "$.questions", QUESTION), F.array().cast(QUESTION))


def question_shaped(v: Column) -> Column:
    absent_or_array = lambda path: F.coalesce(kind_of(v, path).startswith("ARRAY"), F.lit(True))
    return is_string(v, "$.prompt") & is_string(v, "$.type") & absent_or_array("$.options") & absent_or_array("$.accept")


def question_faults(p: Column, prefix: str, name: str, points: bool) -> Column:
    """The first fault of each question."""

    def first(q: Column) -> Column:
        right = F.size(F.filter(q["options"], lambda o: is_true(o["correct"])))
        mc = is_true(q["type"] == "multiple_choice") & ~is_true((F.size(q["options"]) >= 2) & (right >= 1))
        ft = is_true(q["type"] == "free_text") & ~is_true(F.size(F.filter(q["accept"], lambda a: ~blank(a))) > 0)
        kinds = f"{name} question type must be one of multiple_choice, free_text" if prefix == "REFRC" else f"{name} question type must be multiple_choice or free_text"
        found = (
            F.when(blank(q["prompt"]), fault(f"E-EXT-{prefix}-PROMPT", f"{name} questions need a non-empty prompt"))
            .when(~is_true(q["type"].isin(QUESTION_TYPES)), fault(f"E-EXT-{prefix}-QTYPE", kinds))
            .when(mc, fault(f"E-EXT-{prefix}-MC", f"{name} multiple_choice question needs >=2 options and >=1 correct"))
            .when(ft, fault(f"E-EXT-{prefix}-FT", f"{name} free_text question needs a non-empty accept list"))
        )
        return found.when(~is_true(q["points"] > 0), fault(f"E-EXT-{prefix}-POINTS", f"{name} questions need positive points")) if points else found

    return F.array_compact(F.transform(questions(p), first)).cast(ISSUES)


def reading_shaped(p: Column) -> Column:
    return is_string(p, "$.passage") & each_is(p, "$.questions", question_shaped)


def reading_comprehension(ex: Column) -> Column:
    p = ex["ext_payload"]
    shaped = reading_shaped(p)
    own = listed(
        shaped,
        fault("E-EXT-REFRC-SHAPE", "ext:ref-reading-comprehension requires 'ext_payload' with passage (string) and questions ([{prompt, type, options?/accept?}])"),
        (blank(get(p, "$.passage", "string")), fault("E-EXT-REFRC-PASSAGE", "ext:ref-reading-comprehension requires a non-empty passage")),
        (F.size(questions(p)) == 0, fault("E-EXT-REFRC-QUESTIONS", "ext:ref-reading-comprehension requires at least 1 question")),
    )
    return F.when(shaped, F.concat(own, question_faults(p, "REFRC", "ext:ref-reading-comprehension", False))).otherwise(own)


def quiz_shaped(p: Column) -> Column:
    threshold = F.coalesce(is_number(p, "$.pass_threshold") | kind_of(p, "$.pass_threshold").isNull(), F.lit(True))
    return threshold & each_is(p, "$.questions", lambda v: question_shaped(v) & is_number(v, "$.points"))


def graded_quiz(ex: Column) -> Column:
    p = ex["ext_payload"]
    shaped, threshold = quiz_shaped(p), get(p, "$.pass_threshold", "double")
    own = listed(
        shaped,
        fault("E-EXT-REFGQ-SHAPE", "ext:ref-graded-quiz requires 'ext_payload' with questions ([{prompt, type, points, options?/accept?, partial_credit?}]) and an optional numeric pass_threshold"),
        (F.size(questions(p)) == 0, fault("E-EXT-REFGQ-QUESTIONS", "ext:ref-graded-quiz requires at least 1 question")),
        ((threshold < 0) | (threshold > 100), fault("E-EXT-REFGQ-THRESHOLD", "ext:ref-graded-quiz pass_threshold must be a percentage in 0..100")),
    )
    return F.when(shaped, F.concat(own, question_faults(p, "REFGQ", "ext:ref-graded-quiz", True))).otherwise(own)


def answer_shaped(p: Column, field: str) -> Column:
    return is_string(p, field) & is_strings(p, "$.accept")


def dictation(ex: Column) -> Column:
    p = ex["ext_payload"]
    return listed(
        answer_shaped(p, "$.audio"),
        fault("E-EXT-REFDICT-SHAPE", "ext:ref-dictation requires 'ext_payload' with audio (string) and accept (string[])"),
        (blank(get(p, "$.audio", "string")), fault("E-EXT-REFDICT-AUDIO", "ext:ref-dictation requires a non-empty audio reference")),
        (no_answer(strings(p, "$.accept")), fault("E-EXT-REFDICT-ACCEPT", "ext:ref-dictation requires at least 1 non-empty accept entry")),
    )


def image_description(ex: Column) -> Column:
    p = ex["ext_payload"]
    return listed(
        answer_shaped(p, "$.src"),
        fault("E-EXT-REFIMGDESC-SHAPE", "ext:ref-image-description requires 'ext_payload' with src (string) and accept (string[])"),
        (blank(get(p, "$.src", "string")), fault("E-EXT-REFIMGDESC-SRC", "ext:ref-image-description requires a non-empty image reference")),
        (no_answer(strings(p, "$.accept")), fault("E-EXT-REFIMGDESC-ACCEPT", "ext:ref-image-description requires at least 1 non-empty accept entry")),
    )


REGISTRY = {
    ("ext:ref-ordering", 1): ordering,
    ("ext:ref-categorization", 1): categorization,
    ("ext:ref-error-correction", 1): error_correction,
    ("ext:ref-reading-comprehension", 1): reading_comprehension,
    ("ext:ref-graded-quiz", 1): graded_quiz,
    ("ext:ref-dictation", 1): dictation,
    ("ext:ref-image-description", 1): image_description,
}


# --- rendering ---------------------------------------------------------------------------


def numbered(items: Column) -> Column:
    return F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))


def lines(*parts: Column) -> Column:
    """Texts and arrays of texts, a line each."""
    return F.array_join(F.concat(*parts), "\n")


def render(ex: Column) -> Column:
    """The exercise as text; null for types that aren't known here."""
    p, prompt = ex["ext_payload"], F.array(ex["prompt"])
    none_ = F.array().cast("array<string>")
    shaped = lambda ok, x: F.when(ok, x).otherwise(none_)
    cats = F.when(categorization_shaped(p), buckets(p)).otherwise(F.array().cast("array<struct<name string, items array<string>>>"))
    asked = F.transform(questions(p), lambda q: q["prompt"])
    points = F.transform(questions(p), lambda q: F.concat(q["prompt"], F.lit(" ("), _number(q["points"]), F.lit(" P.)")))
    threshold = get(p, "$.pass_threshold", "double")
    bar = F.when(threshold.isNotNull(), F.array(F.concat(F.lit("Bestehensschwelle: "), _number(threshold), F.lit("%")))).otherwise(none_)
    labelled = lambda label, x: F.array(F.concat(F.lit(label), x))
    return (
        F.when(ex["type"] == "ext:ref-ordering", lines(prompt, shaped(is_strings(p, "$.items"), numbered(strings(p, "$.items")))))
        .when(
            ex["type"] == "ext:ref-categorization",
            lines(
                prompt,
                labelled("Kategorien: ", F.array_join(F.transform(cats, lambda c: c["name"]), " | ")),
                labelled("Items: ", F.array_join(F.flatten(F.transform(cats, lambda c: c["items"])), ", ")),
            ),
        )
        .when(ex["type"] == "ext:ref-error-correction", lines(prompt, shaped(correction_shaped(p), numbered(strings(p, "$.tokens")))))
        .when(ex["type"] == "ext:ref-reading-comprehension", lines(prompt, shaped(reading_shaped(p), F.concat(F.array(get(p, "$.passage", "string")), numbered(asked)))))
        .when(ex["type"] == "ext:ref-graded-quiz", lines(prompt, shaped(quiz_shaped(p), F.concat(numbered(points), bar))))
        .when(ex["type"] == "ext:ref-dictation", lines(prompt, shaped(answer_shaped(p, "$.audio"), labelled("[audio] ", get(p, "$.audio", "string")))))
        .when(ex["type"] == "ext:ref-image-description", lines(prompt, shaped(answer_shaped(p, "$.src"), labelled("[image] ", get(p, "$.src", "string")))))
    )


def _number(x: Column) -> Column:
    """A number without the zeros behind the point."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


# --- grading -----------------------------------------------------------------------------


def grade_categorization(ex: Column, assignment: Column) -> Column:
    """Whether every item is in its bucket; ``assignment`` maps items to bucket names."""
    p = ex["ext_payload"]
    right = F.forall(buckets(p), lambda c: F.forall(c["items"], lambda i: is_true(F.element_at(assignment, i) == c["name"])))
    return categorization_shaped(p) & is_true(right)


def grade_error_correction(ex: Column, picked: Column, typed: Column) -> Column:
    p = ex["ext_payload"]
    at = is_true(picked == get(p, "$.error_index", "double"))
    return correction_shaped(p) & at & is_true(F.exists(strings(p, "$.accept"), lambda a: folded(a) == folded(typed)))


def canonical_correction(ex: Column) -> Column:
    p = ex["ext_payload"]
    return F.when(correction_shaped(p), F.get(strings(p, "$.accept"), F.lit(0)))


def grade_text(ex: Column, field: str, answer: Column) -> Column:
    """Dictation (field $.audio) and image description ($.src): an accepted text, but for case and blanks around it."""
    p = ex["ext_payload"]
    return answer_shaped(p, field) & is_true(F.exists(strings(p, "$.accept"), lambda a: ~blank(a) & (folded(a) == folded(answer))))


def right_texts(q: Column) -> Column:
    return F.transform(F.filter(F.coalesce(q["options"], F.array()), lambda o: is_true(o["correct"])), lambda o: o["text"])


def accepts(q: Column, answer: Column) -> Column:
    return is_true(F.exists(q["accept"], lambda a: folded(a) == folded(answer)))


def grade_reading(ex: Column, answers: Column) -> Column:
    """correct, total; ``answers`` has a text per question."""
    p = ex["ext_payload"]

    def right(q: Column, i: Column) -> Column:
        answer = F.coalesce(F.get(answers, i), F.lit(""))
        return F.when(q["type"] == "multiple_choice", is_true(F.array_contains(right_texts(q), answer))).when(q["type"] == "free_text", accepts(q, answer)).otherwise(False)

    n = F.size(F.filter(F.transform(questions(p), right), lambda x: x))
    ok = reading_shaped(p)
    return F.struct(F.when(ok, n).otherwise(0).alias("correct"), F.when(ok, F.size(questions(p))).otherwise(0).alias("total"))


def partial_credit(right: Column, wrong: Column, of: Column) -> Column:
    """The share of right choices less wrong ones, 0 at least, also where nothing is right."""
    return F.when(of == 0, 0.0).otherwise(F.greatest(F.lit(0), right - wrong) / of)


def grade_quiz(ex: Column, answers: Column) -> Column:
    """earned, total, passed; ``answers`` has an array of chosen texts per question."""
    p = ex["ext_payload"]

    def points(q: Column, i: Column) -> Column:
        chosen = F.coalesce(F.get(answers, i), F.array().cast("array<string>"))
        correct, picked = F.array_distinct(right_texts(q)), F.array_distinct(chosen)
        hits = F.size(F.array_intersect(picked, correct))
        wrong = F.size(picked) - hits
        exact = (F.size(picked) == F.size(correct)) & (wrong == 0)
        share = F.when(is_true(q["partial_credit"]), partial_credit(hits, wrong, F.size(correct))).otherwise(F.when(exact, 1.0).otherwise(0.0))
        typed = F.coalesce(F.get(chosen, F.lit(0)), F.lit(""))
        return q["points"] * F.when(q["type"] == "free_text", F.when(accepts(q, typed), 1.0).otherwise(0.0)).otherwise(share)

    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda n, x: n + F.coalesce(x, F.lit(0.0)))
    earned, total = add(F.transform(questions(p), points)), add(F.transform(questions(p), lambda q: q["points"]))
    threshold = get(p, "$.pass_threshold", "double")
    passed = F.when(threshold.isNull(), True).otherwise(is_true((total > 0) & (earned / F.when(total > 0, total) * 100 >= threshold)))
    ok = quiz_shaped(p)
    return F.struct(F.when(ok, earned).otherwise(0.0).alias("earned"), F.when(ok, total).otherwise(0.0).alias("total"), (ok & passed).alias("passed"))
