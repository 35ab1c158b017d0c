"""Whole lessons and manifests made from the driver's tables, judged by the validators and held against SQL.

Every part makes one lesson, whose numbers (its key, modulo small primes) decide which rules it
breaks; the SQL says from the same numbers which issues must come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursewright.operators import canonical, migrate, ordering, wiring
from coursewright.operators.extensions import REGISTRY, grade_categorization, grade_error_correction, grade_quiz, grade_reading, grade_text, render
from coursewright.plans import rules
from coursewright.plans.catalog import dealt, query, table
from coursewright.plans.validate import computed, exploded, validate_lessons, validate_manifests
from coursewright.schemas import LESSON

TEXTS = "array<string>"


def listed(count: Column, one, most: int = 6) -> Column:
    """The elements one(i) for i from 0 to count - 1."""
    return F.transform(F.filter(F.sequence(F.lit(0), F.lit(most)), lambda i: i < count), one)


def said(prefix: str, i: Column) -> Column:
    return F.concat(F.lit(prefix), i.cast("string"))


def part_exercise(k: Column, n: Column) -> Column:
    """An exercise of one of the six core types; what a type doesn't have is null."""
    kind, of = k % 6, lambda divisor, modulus: F.floor(n / divisor).cast("int") % modulus
    only = lambda i, x: F.when(kind == i, x)
    choice = F.element_at(F.array(*[F.lit(m) for m in ("type", "select", "multiselect", None)]), of(1, 4) + 1)
    pairs = listed(of(1, 4), lambda i: F.struct(F.concat(F.when(i % 2 == 1, " T").otherwise("t"), (i % (1 + of(4, 4))).cast("string")).alias("left"), said("r", i % (1 + of(16, 4))).alias("right")))
    images = listed(
        of(1, 4),
        lambda i: F.struct(
            F.when((of(48, 3) == 0) & (i == 0), "data:image/png;base64,x").otherwise("assets/i.png").alias("src"), said("l", i % (1 + of(12, 4))).alias("label"), F.when(i < of(4, 3), "true").alias("is_correct")
        ),
    )
    tiles = listed(of(1, 5), lambda i: said("t", i % (1 + of(5, 4))))
    orders = F.when(of(20, 3) == 1, F.array(listed(of(1, 5), lambda i: i))).when(of(20, 3) == 2, F.array(listed(of(1, 5) - 1, lambda i: i), F.reverse(listed(of(1, 5), lambda i: i))))
    options = listed(of(1, 4), lambda i: F.struct(said("o", i % (1 + of(4, 4))).alias("text"), F.when(i < of(16, 3), True).alias("correct")))
    sentence = F.when(of(4, 3) == 1, "a ___ b").when(of(4, 3) == 2, "___ c ___")
    blanks = listed(of(12, 3), lambda i: F.struct(F.array(said("x", i)).alias("accept")))
    return F.struct(
        F.lit("e1").alias("id"),
        F.element_at(F.array(*[F.lit(t) for t in ("matching", "picture_choice", "free_text", "word_tiles", "cloze", "multiple_choice")]), (kind + 1).cast("int")).alias("type"),
        F.lit("p").alias("prompt"),
        F.when(n % 2 == 0, F.array(F.lit("c1"))).otherwise(F.array().cast(TEXTS)).alias("card_ids"),
        only(0, n % 5 == 0).alias("from_cards"),
        only(0, pairs).alias("pairs"),
        only(1, images).alias("images"),
        only(2, F.when(of(3, 2) == 0, "ten letters").otherwise("no hint")).alias("hint"),
        F.when(kind == 2, listed(of(1, 3), lambda i: said("a", i))).when((kind == 4) & (of(108, 3) > 0), F.array(F.when(of(108, 3) == 1, "x0").otherwise("y"))).alias("accept"),
        only(3, tiles).alias("tiles"),
        only(3, orders).alias("accept_orderings"),
        only(4, choice).alias("cloze_mode"),
        only(4, sentence).alias("sentence"),
        only(4, blanks).alias("blanks"),
        only(4, F.when(of(36, 3) == 1, F.array(F.lit("d"))).when(of(36, 3) == 2, F.array(F.lit("x0"), F.lit("d")))).alias("distractors"),
        only(5, options).alias("options"),
        only(5, of(48, 2) == 0).alias("multiple"),
    )


def part_lessons(spark, sf_dir) -> DataFrame:
    """k, raw: a lesson of a theory step, a drill and up to two cards for each part."""
    k = F.col("p_partkey")
    n = F.floor(k / 6)
    ex = part_exercise(k, n)
    twin = F.when(n % 19 == 0, "same-stable-id").otherwise(F.concat(F.lit("card-two-"), k.cast("string")))
    card = lambda name, stable: F.struct(F.lit(name).alias("id"), F.lit("f").alias("front"), F.lit("b").alias("back"), stable.alias("stable_id"))
    one, two = card("c1", F.when(n % 19 == 0, "same-stable-id")), card("c2", twin)
    theory = F.struct(F.lit("s1").alias("id"), F.lit("theory").alias("type"), F.when(n % 7 == 0, "").otherwise("b").alias("body"), F.when(n % 11 == 0, ex).alias("exercise"))
    drill = F.struct(F.lit("s2").alias("id"), F.lit("exercise").alias("type"), F.when(n % 13 == 0, "b").alias("body"), F.when(n % 17 != 0, ex).alias("exercise"))
    lesson = F.struct(
        said("part-", k).alias("id"),
        F.when(n % 23 == 0, "Ti​tle").otherwise("Title").alias("title"),
        F.when(n % 29 == 0, "x").alias("extra"),
        F.when(n % 31 == 0, 0).otherwise(10).alias("estimated_minutes"),
        F.when(n % 3 == 0, F.array(two)).otherwise(F.array(one, two)).alias("cards"),
        F.array(theory, drill).alias("steps"),
    )
    return dealt(table(spark, sf_dir, "part").select("p_partkey")).select(k.alias("k"), F.when(n % 37 == 0, F.lit("{")).otherwise(F.to_json(lesson)).alias("raw"))


#: For each part its kind and number, and whether rules can run at all.
PARTS = "p AS (SELECT p_partkey AS k, p_partkey % 6 AS kind, p_partkey // 6 AS n, (p_partkey // 6) % 37 <> 0 AS ok FROM part), v AS (SELECT *, n % 17 <> 0 AS drilled FROM p WHERE ok AND n % 29 <> 0 AND n % 31 <> 0)"

#: id, path and condition of the issues over v; a pair of numbers is a list of that many elements, numbered modulo the other.
LESSON_RULES = [
    ("E-STEP-THEORY-BODY", "/steps/0", "n % 7 = 0"),
    ("E-STEP-THEORY-EXERCISE", "/steps/0", "n % 11 = 0"),
    ("E-STEP-EXERCISE-PAYLOAD", "/steps/1", "NOT drilled"),
    ("E-STEP-EXERCISE-BODY", "/steps/1", "n % 13 = 0"),
    ("E-CARD-REF", "/steps/1/exercise/card_ids", "drilled AND n % 2 = 0 AND n % 3 = 0"),
    ("W-CARD-UNUSED", "/cards", "true"),
    ("E-STABLE-ID-DUP", "/", "n % 19 = 0 AND n % 3 <> 0"),
    ("W-INVISIBLE-CHAR", "", "n % 23 = 0"),
    ("W-HINT-LENGTH", "/steps/1/exercise", "drilled AND kind = 2 AND (n // 3) % 2 = 0"),
    ("E-MATCH-FROMCARDS-CARDS", "/steps/1/exercise", "drilled AND kind = 0 AND n % 5 = 0 AND n % 2 = 1"),
    ("E-MATCH-FROMCARDS-PAIRS", "/steps/1/exercise", "drilled AND kind = 0 AND n % 5 = 0 AND n % 4 > 0"),
    ("E-MATCH-PAIRS", "/steps/1/exercise", "drilled AND kind = 0 AND n % 5 <> 0 AND n % 4 = 0"),
    # three pairs of one left repeat it once, of two lefts the first
    ("E-MATCH-DUP-LEFT", "/steps/1/exercise", "drilled AND kind = 0 AND n % 5 <> 0 AND n % 4 > 1 + (n // 4) % 4"),
    ("W-MATCH-AMBIG", "/steps/1/exercise", "drilled AND kind = 0 AND n % 5 <> 0 AND n % 4 > 1 + (n // 16) % 4"),
    ("E-PIC-MIN", "/steps/1/exercise", "drilled AND kind = 1 AND n % 4 < 2"),
    ("E-PIC-ONE-CORRECT", "/steps/1/exercise", "drilled AND kind = 1 AND n % 4 >= 2 AND (n // 4) % 3 <> 1"),
    (
        "W-PIC-DUP-LABEL",
        "/steps/1/exercise",
        "drilled AND kind = 1 AND n % 4 >= 2 AND len(list_filter(range((n // 4) % 3, n % 4), lambda i: list_contains(list_transform(range(least((n // 4) % 3, n % 4)), lambda j: j % (1 + (n // 12) % 4)), i % (1 + (n // 12) % 4)))) > 0",
    ),
    ("W-PIC-DATA-URI", "/steps/1/exercise", "drilled AND kind = 1 AND n % 4 >= 2 AND (n // 48) % 3 = 0"),
    ("E-FREETEXT-ACCEPT", "/steps/1/exercise", "drilled AND kind = 2 AND n % 3 = 0"),
    ("E-TILES-MIN", "/steps/1/exercise", "drilled AND kind = 3 AND n % 5 < 2"),
    ("W-TILES-DUP", "/steps/1/exercise", "drilled AND kind = 3 AND n % 5 > 1 + (n // 5) % 4 AND (n // 20) % 3 = 0"),
    ("E-TILES-ORDERING", "/steps/1/exercise", "drilled AND kind = 3 AND n % 5 >= 2 AND (n // 20) % 3 = 2"),
    ("E-CLOZE-MS-SENTENCE", "/steps/1/exercise", "drilled AND kind = 4 AND n % 4 = 2 AND (n // 4) % 3 = 0"),
    ("E-CLOZE-MS-ACCEPT", "/steps/1/exercise", "drilled AND kind = 4 AND n % 4 = 2 AND (n // 108) % 3 = 0"),
    ("E-CLOZE-MS-DISTRACTORS", "/steps/1/exercise", "drilled AND kind = 4 AND n % 4 = 2 AND (n // 36) % 3 = 0"),
    ("E-CLOZE-MS-DISJOINT", "/steps/1/exercise", "drilled AND kind = 4 AND n % 4 = 2 AND (n // 36) % 3 = 2 AND (n // 108) % 3 = 1"),
    ("E-CLOZE-SENTENCE", "/steps/1/exercise", "drilled AND kind = 4 AND n % 4 <> 2 AND (n // 4) % 3 = 0"),
    ("E-CLOZE-BLANKS", "/steps/1/exercise", "drilled AND kind = 4 AND n % 4 <> 2 AND (n // 4) % 3 > 0 AND (n // 12) % 3 = 0"),
    ("E-CLOZE-MARKERS", "/steps/1/exercise", "drilled AND kind = 4 AND n % 4 <> 2 AND (n // 4) % 3 > 0 AND (n // 12) % 3 > 0 AND (n // 4) % 3 <> (n // 12) % 3"),
    ("E-CLOZE-SELECT-DISTRACTORS", "/steps/1/exercise", "drilled AND kind = 4 AND n % 4 = 1 AND (n // 4) % 3 > 0 AND (n // 12) % 3 > 0 AND (n // 36) % 3 = 0"),
    ("W-DISTRACTOR-ANSWER", "/steps/1/exercise", "drilled AND kind = 4 AND n % 4 = 1 AND (n // 4) % 3 > 0 AND (n // 12) % 3 > 0 AND (n // 36) % 3 = 2"),
    ("E-MC-OPTIONS", "/steps/1/exercise", "drilled AND kind = 5 AND n % 4 < 2"),
    ("E-MC-MIN-CORRECT", "/steps/1/exercise", "drilled AND kind = 5 AND n % 4 >= 2 AND (n // 48) % 2 = 0 AND (n // 16) % 3 = 0"),
    ("E-MC-ONE-CORRECT", "/steps/1/exercise", "drilled AND kind = 5 AND n % 4 >= 2 AND (n // 48) % 2 = 1 AND (n // 16) % 3 <> 1"),
    ("E-MC-DUP-OPTION", "/steps/1/exercise", "drilled AND kind = 5 AND n % 4 > 1 + (n // 4) % 4"),
]


def rule_sql(found: list[tuple[str, str, str]], rows: str, key: str = "k") -> str:
    return " UNION ALL ".join(f"SELECT {key}, '{rule}' AS id, '{path}' AS path, '{'error' if rule[0] == 'E' else 'warning'}' AS severity FROM {rows} WHERE {condition}" for rule, path, condition in found)


STRUCTURE = [("E-UNKNOWN-FIELD", "/", "n % 29 = 0"), ("E-SCHEMA", "/estimated_minutes", "n % 31 = 0")]


@query("q33_lesson_rules", f"WITH {PARTS} {rule_sql(LESSON_RULES, 'v')} UNION ALL {rule_sql(STRUCTURE, '(SELECT * FROM p WHERE ok)')}")
def lesson_issues(spark, sf_dir):
    return exploded(validate_lessons(part_lessons(spark, sf_dir)), "k").select("k", "id", "path", "severity")


@query(
    "q33b_lesson_verdicts",
    f"""WITH {PARTS}, f AS ({rule_sql(LESSON_RULES, 'v')} UNION ALL {rule_sql(STRUCTURE, '(SELECT * FROM p WHERE ok)')}),
c AS (SELECT k, count_if(severity = 'error') AS errors, count_if(severity = 'warning') AS warnings FROM f GROUP BY k)
SELECT p.k, ok AS is_json, CASE WHEN ok THEN coalesce(errors, 0) END AS errors, CASE WHEN ok THEN coalesce(warnings, 0) END AS warnings, ok AND coalesce(errors, 0) = 0 AS valid FROM p LEFT JOIN c USING (k)""",
)
def lesson_verdicts(spark, sf_dir):
    judged = validate_lessons(part_lessons(spark, sf_dir))
    count = lambda c: F.when(F.col("ok_json"), F.size(c)).cast("long").alias(c)
    return judged.select("k", F.col("ok_json").alias("is_json"), count("errors"), count("warnings"), "valid")


def manifests(spark, sf_dir) -> DataFrame:
    """k, raw: a manifest of one set for each customer, with retirements and lesson files."""
    k = F.col("c_custkey")
    domain = F.when(k % 3 == 0, "cooking").when(k % 3 == 1, "math")
    level = F.element_at(F.array(*[F.lit(x) for x in ("B1", "none", "expert", "a2 ")]), (k % 4 + 1).cast("int"))
    one = F.struct(
        said("set-", k).alias("id"), F.col("c_name").alias("title"), F.when(k % 5 != 0, F.lit("de")).alias("target_language"), F.when(k % 5 == 0, F.lit("de")).alias("language"),
        level.alias("level"), F.lit("1.0").alias("version"), F.when(k % 29 == 0, -1).otherwise(3).alias("lesson_count"), domain.alias("domain"),
    )
    retired = F.when(k % 7 == 0, F.array(F.lit("old-one-1"), F.lit("old-two-2"), F.lit("old-one-1"))).when(k % 7 == 1, F.array(F.lit("old-one-1")))
    files = F.when(k % 11 == 0, F.array(F.lit("01-a.json"), F.lit("b.json"))).when(k % 11 == 1, F.array(F.lit("1-a.json"), F.lit("02-b.json"))).when(k % 11 == 2, F.array(F.lit("u10.json"), F.lit("u9.json"))).otherwise(F.array(F.lit("01-a.json"), F.lit("02-b.json")))
    meta = F.struct(files.alias("lessons"), retired.alias("retired_ids"))
    whole = F.struct(F.when(k % 31 != 0, F.col("c_mktsegment")).alias("name"), F.array(one).alias("sets"), meta.alias("metadata"))
    raw = F.to_json(whole)
    # a retirement list of the wrong type
    raw = F.when(k % 13 == 0, F.regexp_replace(F.to_json(whole.withField("metadata", meta.withField("retired_ids", F.array(F.lit("@"))))), '"@"', "7")).otherwise(raw)
    return dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")).select(k.alias("k"), raw.alias("raw"))


MANIFEST_RULES = [
    ("E-RETIRED-IDS-TYPE", "/metadata/retired_ids", "k % 13 = 0"),
    ("W-RETIRED-IDS-DUP", "/metadata/retired_ids", "k % 13 <> 0 AND k % 7 = 0"),
    ("W-DOMAIN-UNKNOWN", "/sets/0/domain", "k % 13 <> 0 AND k % 3 = 0"),
    ("W-LEVEL-UNKNOWN", "/sets/0/level", "k % 13 <> 0 AND (k % 4 = 2 OR k % 4 = 1 AND k % 3 = 2)"),
    ("W-SET-ORDER-MIXED-PREFIX", "/metadata/lessons", "k % 13 <> 0 AND k % 11 = 0"),
    ("W-SET-ORDER-PREFIX-WIDTH", "/metadata/lessons", "k % 13 <> 0 AND k % 11 = 1"),
    ("W-SET-ORDER-NUMERIC", "/metadata/lessons", "k % 13 <> 0 AND (k % 11 = 1 OR k % 11 = 2)"),
]
MANIFEST_STRUCTURE = [("E-SCHEMA", "/sets/0/lesson_count", "k % 29 = 0"), ("E-SCHEMA", "/", "k % 31 = 0")]


@query(
    "q34_manifest_rules",
    f"WITH c AS (SELECT c_custkey AS k FROM customer), v AS (SELECT k FROM c WHERE k % 29 <> 0 AND k % 31 <> 0) {rule_sql(MANIFEST_RULES, 'v')} UNION ALL {rule_sql(MANIFEST_STRUCTURE, 'c')}",
)
def manifest_issues(spark, sf_dir):
    return exploded(validate_manifests(manifests(spark, sf_dir)), "k").select("k", "id", "path", "severity")


def extension_payload(kind: Column, n: Column) -> Column:
    """The JSON of a payload of one of seven types, of a shape and contents that n decides."""
    of = lambda divisor, modulus: F.floor(n / divisor).cast("int") % modulus
    blank = lambda condition, x: F.when(condition, " ").otherwise(x)
    items = listed(of(1, 4), lambda i: blank((of(4, 3) == 1) & (i == 1), said("i", i % (1 + of(12, 3)))))
    cats = listed(of(1, 3), lambda c: F.struct(F.when(of(3, 2) == 0, "same").otherwise(said("n", c)).alias("name"), F.when((of(6, 3) == 1) & (c == 0), F.array().cast(TEXTS)).otherwise(F.array(blank(of(18, 2) == 1, F.when(of(36, 2) == 0, "one").otherwise(said("x", c))))).alias("items")))
    tokens = listed(of(1, 4), lambda i: blank((of(4, 2) == 1) & (i == 0), said("w", i)))
    correction = F.struct(tokens.alias("tokens"), (of(8, 4) - 1).alias("error_index"), F.when(of(32, 3) == 0, F.array().cast(TEXTS)).when(of(32, 3) == 1, F.array(F.lit("w1"))).otherwise(F.array(F.lit("right"))).alias("accept"))
    option = lambda i: F.struct(said("o", i).alias("text"), (i < of(12, 2)).alias("correct"))
    question = lambda q: F.struct(
        blank(of(4, 3) == 0, F.lit("q?")).alias("prompt"),
        F.when(of(24, 4) == 0, "essay").when(of(24, 4) == 1, "free_text").otherwise("multiple_choice").alias("type"),
        listed(of(48, 2) + 1, option).alias("options"),
        F.when(of(12, 2) == 0, F.array(F.lit(" "))).otherwise(F.array(F.lit("a"))).alias("accept"),
        F.when(of(4, 3) == 1, 0).otherwise(2).alias("points"),
    )
    reading = F.struct(blank(of(1, 4) == 0, F.lit("passage")).alias("passage"), listed(F.when(of(2, 4) == 3, 0).otherwise(1), question).alias("questions"))
    quiz = F.struct(listed(F.when(of(2, 4) == 3, 0).otherwise(1), question).alias("questions"), F.when(of(1, 2) == 1, F.when(of(2, 3) == 0, 101).otherwise(50)).alias("pass_threshold"))
    answer = lambda field: F.struct(blank(of(1, 2) == 0, F.lit("file")).alias(field), F.when(of(2, 3) == 0, F.array().cast(TEXTS)).when(of(2, 3) == 1, F.array(F.lit(" "))).otherwise(F.array(F.lit("a"), F.lit(" "))).alias("accept"))
    whole = [F.struct(items.alias("items")), F.struct(cats.alias("categories")), correction, reading, quiz, answer("audio"), answer("src")]
    out = F.lit('{"other":1}')  # the wrong shape
    for i, one in enumerate(whole):
        out = F.when((kind == i) & (n % 10 != 9), F.to_json(one)).otherwise(out)
    return out


EXT_TYPES = ["ext:ref-ordering", "ext:ref-categorization", "ext:ref-error-correction", "ext:ref-reading-comprehension", "ext:ref-graded-quiz", "ext:ref-dictation", "ext:ref-image-description"]


def extension_lessons(spark, sf_dir) -> DataFrame:
    """k, raw: a lesson with one extension exercise for each order."""
    k = F.col("o_orderkey")
    n = F.floor(k / 7)
    kind = (k % 7).cast("int")
    name = F.element_at(F.array(*[F.lit(t) for t in EXT_TYPES]), kind + 1)
    declared = F.when(n % 11 == 0, F.array().cast(TEXTS)).when(n % 11 == 1, F.array(F.concat(name, F.lit("@2")))).otherwise(F.array(F.concat(name, F.lit("@1"))))
    payload = extension_payload(kind, n)
    ex = F.struct(F.lit("e1").alias("id"), name.alias("type"), F.lit("Prompt").alias("prompt"), F.lit("@payload@").alias("ext_payload"))
    step = F.struct(F.lit("s1").alias("id"), F.lit("exercise").alias("type"), ex.alias("exercise"))
    lesson = F.struct(said("order-", k).alias("id"), F.lit("T").alias("title"), declared.alias("requires_extensions"), F.array(step).alias("steps"))
    return dealt(table(spark, sf_dir, "orders").select("o_orderkey")).select(k.alias("k"), F.replace(F.to_json(lesson), F.lit('"@payload@"'), payload).alias("raw"))


#: Faults of questions: the first that holds.
ASKED = "n % 10 <> 9 AND (n // 2) % 4 <> 3"
TYPE = "CASE (n // 24) % 4 WHEN 0 THEN 'essay' WHEN 1 THEN 'free' ELSE 'multi' END"
PROMPT, MC, FT = "(n // 4) % 3 = 0", f"{TYPE} = 'multi' AND ((n // 48) % 2 = 0 OR (n // 12) % 2 = 0)", f"{TYPE} = 'free' AND (n // 12) % 2 = 0"
QUESTION_RULES = [
    ("PROMPT", PROMPT),
    ("QTYPE", f"NOT ({PROMPT}) AND {TYPE} = 'essay'"),
    ("MC", f"NOT ({PROMPT}) AND {MC}"),
    ("FT", f"NOT ({PROMPT}) AND {FT}"),
]
POINTS = f"NOT ({PROMPT}) AND {TYPE} <> 'essay' AND NOT ({MC}) AND NOT ({FT}) AND (n // 4) % 3 = 1"
SHAPED = "n % 10 <> 9"
EXT_RULES = [
    *[(f"E-EXT-{name}", f"kind = {i} AND n % 10 = 9") for i, name in enumerate(("REFORDER-ITEMS", "REFCATEG-SHAPE", "REFERRCORR-SHAPE", "REFRC-SHAPE", "REFGQ-SHAPE", "REFDICT-SHAPE", "REFIMGDESC-SHAPE"))],
    ("E-EXT-REFORDER-MIN", f"kind = 0 AND {SHAPED} AND n % 4 < 2"),
    ("E-EXT-REFORDER-EMPTY", f"kind = 0 AND {SHAPED} AND n % 4 >= 2 AND (n // 4) % 3 = 1"),
    (
        "E-EXT-REFORDER-DUP",
        f"kind = 0 AND {SHAPED} AND (SELECT count(*) > count(DISTINCT x) FROM (SELECT unnest(list_transform(range(n % 4), lambda i: CASE WHEN (n // 4) % 3 = 1 AND i = 1 THEN ' ' ELSE (i % (1 + (n // 12) % 3))::VARCHAR END)) AS x))",
    ),
    ("E-EXT-REFCATEG-MIN", f"kind = 1 AND {SHAPED} AND n % 3 < 2"),
    ("E-EXT-REFCATEG-ITEMS", f"kind = 1 AND {SHAPED} AND n % 3 > 0 AND (n // 6) % 3 = 1"),
    ("E-EXT-REFCATEG-EMPTY", f"kind = 1 AND {SHAPED} AND n % 3 > CASE WHEN (n // 6) % 3 = 1 THEN 1 ELSE 0 END AND (n // 18) % 2 = 1"),
    ("E-EXT-REFCATEG-DUPNAME", f"kind = 1 AND {SHAPED} AND n % 3 = 2 AND (n // 3) % 2 = 0"),
    ("E-EXT-REFCATEG-DUPITEM", f"kind = 1 AND {SHAPED} AND n % 3 = 2 AND (n // 6) % 3 <> 1 AND ((n // 18) % 2 = 1 OR (n // 36) % 2 = 0)"),
    ("E-EXT-REFERRCORR-TOKENS", f"kind = 2 AND {SHAPED} AND n % 4 < 2"),
    ("E-EXT-REFERRCORR-EMPTY", f"kind = 2 AND {SHAPED} AND n % 4 > 0 AND (n // 4) % 2 = 1"),
    ("E-EXT-REFERRCORR-INDEX", f"kind = 2 AND {SHAPED} AND NOT ((n // 8) % 4 - 1 BETWEEN 0 AND n % 4 - 1)"),
    ("E-EXT-REFERRCORR-CORRECTION", f"kind = 2 AND {SHAPED} AND (n // 32) % 3 = 0"),
    ("E-EXT-REFERRCORR-NOOP", f"kind = 2 AND {SHAPED} AND (n // 32) % 3 = 1 AND (n // 8) % 4 = 2 AND n % 4 >= 2"),
    ("E-EXT-REFRC-PASSAGE", f"kind = 3 AND {SHAPED} AND n % 4 = 0"),
    ("E-EXT-REFRC-QUESTIONS", f"kind = 3 AND {SHAPED} AND (n // 2) % 4 = 3"),
    *[(f"E-EXT-REFRC-{name}", f"kind = 3 AND {ASKED} AND {condition}") for name, condition in QUESTION_RULES],
    ("E-EXT-REFGQ-QUESTIONS", f"kind = 4 AND {SHAPED} AND (n // 2) % 4 = 3"),
    ("E-EXT-REFGQ-THRESHOLD", f"kind = 4 AND {SHAPED} AND n % 2 = 1 AND (n // 2) % 3 = 0"),
    *[(f"E-EXT-REFGQ-{name}", f"kind = 4 AND {ASKED} AND {condition}") for name, condition in [*QUESTION_RULES, ("POINTS", POINTS)]],
    ("E-EXT-REFDICT-AUDIO", f"kind = 5 AND {SHAPED} AND n % 2 = 0"),
    ("E-EXT-REFDICT-ACCEPT", f"kind = 5 AND {SHAPED} AND (n // 2) % 3 < 2"),
    ("E-EXT-REFIMGDESC-SRC", f"kind = 6 AND {SHAPED} AND n % 2 = 0"),
    ("E-EXT-REFIMGDESC-ACCEPT", f"kind = 6 AND {SHAPED} AND (n // 2) % 3 < 2"),
]
ORDERS = "o AS (SELECT o_orderkey AS k, o_orderkey % 7 AS kind, o_orderkey // 7 AS n FROM orders)"


@query(
    "q35_extension_rules",
    f"""WITH {ORDERS}, v AS (SELECT * FROM o WHERE n % 11 > 1)
{rule_sql([(rule, "/ext_payload", condition) for rule, condition in EXT_RULES], 'v')}
UNION ALL {rule_sql([("E-EXT-UNDECLARED", "/steps/0/exercise", "n % 11 = 0"), ("E-EXT-UNSUPPORTED", "/steps/0/exercise", "n % 11 = 1")], 'o')}""",
)
def extension_issues(spark, sf_dir):
    return exploded(validate_lessons(extension_lessons(spark, sf_dir), REGISTRY), "k").select("k", "id", "path", "severity")


@query(
    "q36_render",
    f"""WITH {ORDERS}, items AS (
  SELECT k, string_agg(chr(10) || (i + 1) || '. ' || CASE WHEN (n // 4) % 3 = 1 AND i = 1 THEN ' ' ELSE 'i' || (i % (1 + (n // 12) % 3)) END, '' ORDER BY i) AS listed FROM (SELECT *, unnest(range(n % 4)) AS i FROM o) GROUP BY k),
words AS (SELECT k, string_agg(chr(10) || (i + 1) || '. ' || CASE WHEN (n // 4) % 2 = 1 AND i = 0 THEN ' ' ELSE 'w' || i END, '' ORDER BY i) AS listed FROM (SELECT *, unnest(range(n % 4)) AS i FROM o) GROUP BY k),
cats AS (SELECT k, string_agg(CASE WHEN (n // 3) % 2 = 0 THEN 'same' ELSE 'n' || c END, ' | ' ORDER BY c) AS names,
  string_agg(CASE WHEN (n // 18) % 2 = 1 THEN ' ' WHEN (n // 36) % 2 = 0 THEN 'one' ELSE 'x' || c END, ', ' ORDER BY c) FILTER (NOT ((n // 6) % 3 = 1 AND c = 0)) AS its FROM (SELECT *, unnest(range(n % 3)) AS c FROM o) GROUP BY k),
q AS (SELECT *, CASE WHEN (n // 4) % 3 = 0 THEN ' ' ELSE 'q?' END AS prompt, CASE WHEN (n // 4) % 3 = 1 THEN '0' ELSE '2' END AS points, (n // 2) % 4 <> 3 AS asked, {SHAPED} AS ok FROM o)
SELECT q.k, 'Prompt' || CASE
  WHEN kind = 1 THEN chr(10) || 'Kategorien: ' || CASE WHEN ok THEN coalesce(names, '') ELSE '' END || chr(10) || 'Items: ' || CASE WHEN ok THEN coalesce(its, '') ELSE '' END
  WHEN NOT ok THEN ''
  WHEN kind = 0 THEN coalesce(items.listed, '')
  WHEN kind = 2 THEN coalesce(words.listed, '')
  WHEN kind = 3 THEN chr(10) || CASE WHEN n % 4 = 0 THEN ' ' ELSE 'passage' END || CASE WHEN asked THEN chr(10) || '1. ' || prompt ELSE '' END
  WHEN kind = 4 THEN CASE WHEN asked THEN chr(10) || '1. ' || prompt || ' (' || points || ' P.)' ELSE '' END || CASE WHEN n % 2 = 1 THEN chr(10) || 'Bestehensschwelle: ' || CASE WHEN (n // 2) % 3 = 0 THEN '101' ELSE '50' END || '%' ELSE '' END
  WHEN kind = 5 THEN chr(10) || '[audio] ' || CASE WHEN n % 2 = 0 THEN ' ' ELSE 'file' END
  ELSE chr(10) || '[image] ' || CASE WHEN n % 2 = 0 THEN ' ' ELSE 'file' END END AS shown
FROM q LEFT JOIN items ON items.k = q.k LEFT JOIN words ON words.k = q.k LEFT JOIN cats ON cats.k = q.k""",
)
def rendered(spark, sf_dir):
    lessons = extension_lessons(spark, sf_dir).withColumn("lesson", F.from_json("raw", LESSON))
    return lessons.select("k", render(F.element_at("lesson.steps", 1)["exercise"]).alias("shown"))


def graded_exercises(spark, sf_dir) -> DataFrame:
    """One exercise of each graded type over each customer's numbers, with an answer."""
    k = F.col("c_custkey")
    name = F.col("c_name")
    cats = F.struct(F.array(F.struct(F.lit("a").alias("name"), F.array(name, F.lit("p")).alias("items")), F.struct(F.lit("b").alias("name"), F.array(F.lit("q")).alias("items"))).alias("categories"))
    fix = F.struct(F.array(F.lit("he"), F.lit("go")).alias("tokens"), F.lit(1).alias("error_index"), F.array(F.lit("goes"), name).alias("accept"))
    heard = F.struct(F.lit("f.mp3").alias("audio"), F.lit("f.png").alias("src"), F.array(name, F.lit(" ")).alias("accept"))
    option = lambda text, right: F.struct(F.lit(text).alias("text"), F.lit(right).alias("correct"))
    mc = lambda share, points: F.struct(F.lit("m").alias("prompt"), F.lit("multiple_choice").alias("type"), F.array(option("x", True), option("y", True), option("z", False)).alias("options"), F.lit(None).cast(TEXTS).alias("accept"), points.alias("points"), share.alias("partial_credit"))
    ft = F.struct(F.lit("f").alias("prompt"), F.lit("free_text").alias("type"), F.lit(None).cast("array<struct<text string, correct boolean>>").alias("options"), F.array(F.col("c_mktsegment")).alias("accept"), F.lit(2).alias("points"), F.lit(False).alias("partial_credit"))
    asked = F.struct(F.lit("text").alias("passage"), F.array(mc(k % 2 == 0, k % 3 + 1), ft).alias("questions"), F.when(k % 5 > 0, 60).alias("pass_threshold"))
    as_ex = lambda payload: F.struct(F.parse_json(F.to_json(payload)).alias("ext_payload"))
    customers = dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"))
    return computed(customers.withColumn("k", k), cats=as_ex(cats), fix=as_ex(fix), heard=as_ex(heard), asked=as_ex(asked))


@query(
    "q37_grades",
    """
WITH g AS (SELECT c_custkey AS k, c_custkey % 4 AS r, c_custkey % 3 + 1 AS p, CASE WHEN c_custkey % 7 < 4 THEN 2 ELSE 0 END AS f FROM customer),
e AS (SELECT *, p + 2 AS total, f + p * CASE WHEN r = 0 THEN 1.0 WHEN r = 2 AND k % 2 = 0 THEN 0.5 ELSE 0.0 END AS earned FROM g)
SELECT k, k % 4 <> 1 AS sorted_right, k % 5 IN (0, 2) AS corrected, k % 6 < 2 AS heard, k % 6 < 2 AS seen, CASE WHEN r < 3 THEN 1 ELSE 0 END + CASE WHEN f > 0 THEN 1 ELSE 0 END AS reading, 2 AS of,
  round(earned, 4)::DOUBLE AS earned, total::DOUBLE AS total, k % 5 = 0 OR earned / total * 100 >= 60 AS passed
FROM e""",
)
def grades(spark, sf_dir):
    k = F.col("k")
    put = F.create_map(F.col("c_name"), F.when(k % 4 == 1, "b").otherwise("a"), F.lit("p"), F.lit("a"), F.lit("q"), F.lit("b"))
    typed = F.when(k % 5 == 0, " GOES ").when(k % 5 == 1, "went").otherwise(F.upper("c_name"))
    picked = F.when(k % 5 == 3, 0).when(k % 5 == 4, 2).otherwise(1)
    heard = F.when(k % 6 == 0, F.upper("c_name")).when(k % 6 == 1, F.concat(F.lit(" "), "c_name", F.lit("\n"))).when(k % 6 == 2, " ").otherwise("other")
    chosen = F.element_at(F.array(F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z")), F.array(F.lit("x")), F.array(F.lit("z"))), (k % 4 + 1).cast("int"))
    text = F.when(k % 7 < 4, F.lower("c_mktsegment")).otherwise("nothing")
    reading, quiz = grade_reading(F.col("asked"), F.array(F.element_at(chosen, 1), text)), grade_quiz(F.col("asked"), F.array(chosen, F.array(text)))
    return graded_exercises(spark, sf_dir).select(
        "k",
        grade_categorization(F.col("cats"), put).alias("sorted_right"),
        grade_error_correction(F.col("fix"), picked, typed).alias("corrected"),
        grade_text(F.col("heard"), "$.audio", heard).alias("heard"),
        grade_text(F.col("heard"), "$.src", heard).alias("seen"),
        reading["correct"].alias("reading"),
        reading["total"].alias("of"),
        F.round(quiz["earned"], 4).alias("earned"),
        quiz["total"].alias("total"),
        quiz["passed"].alias("passed"),
    )
