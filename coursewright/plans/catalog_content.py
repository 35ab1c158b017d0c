"""Records, wiring, rewrites, files and formats over the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursewright.operators import canonical, conformance, identity, migrate, mint, ordering, reports, wiring
from coursewright.plans import rules, structural
from coursewright.plans.catalog import dealt, query, table
from coursewright.plans.catalog_lessons import TEXTS, part_lessons, said
from coursewright.plans.validate import computed, validate_lessons
from coursewright.schemas import LESSON, MANIFEST
from coursewright.scratch import stored
from coursewright.sources import lessons as files_of
from coursewright.sources import manifests as yaml_of
from coursewright.sources import qti

typed = lambda x, kind=LESSON: F.from_json(F.to_json(x), kind)


def wiring_lessons(spark, sf_dir) -> DataFrame:
    """path, lesson: two unused cards and a used one beside three exercises, for each customer."""
    k = F.col("c_custkey")
    card = lambda i, front, back: F.struct(F.lit(i).alias("id"), front.alias("front"), back.alias("back"))
    step = lambda i, **more: F.struct(
        F.lit("exercise").alias("type"), F.struct(F.lit(i).alias("id"), *[(more.get(c, F.lit(None))).cast(t).alias(c) for c, t in (("prompt", "string"), ("card_ids", TEXTS), ("accept", TEXTS), ("tiles", TEXTS))]).alias("exercise")
    )
    name = F.col("c_name")
    steps = F.array(
        step("e1", prompt=F.concat(F.lit("say "), F.when(k % 3 == 0, name).otherwise("it")), card_ids=F.array(F.lit("c3"))),
        step("e2", prompt=F.lit("q"), accept=F.when(k % 2 == 0, F.array(F.lit("beta"), F.lit("the delta"))).otherwise(F.array(F.lit("none")))),
        step("e3", prompt=F.lit("r"), tiles=F.when(k % 5 == 0, F.array(F.lit("one"), F.lit("gamma now")))),
    )
    cards = F.array(card("c1", name, F.lit("beta")), card("c2", F.lit("gamma"), F.lit("delta")), card("c3", F.lit("used"), F.lit("card")))
    customers = dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_name")).select("*", k.alias("k"), k.cast("string").alias("path"))
    return computed(customers, lesson=typed(F.struct(cards.alias("cards"), steps.alias("steps")))).select("k", "path", "lesson")


SUGGESTED = """
h AS (
  SELECT c_custkey AS k, 'c1' AS card, 'e1' AS ex, 'prompt:front:' || c_name AS evidence FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT c_custkey, 'c1', 'e2', 'accept[0]:back:beta' FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT c_custkey, 'c2', 'e2', 'accept[1]:back:delta' FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT c_custkey, 'c2', 'e3', 'tiles[1]:front:gamma' FROM customer WHERE c_custkey % 5 = 0),
c AS (SELECT c_custkey AS k, unnest(['c1', 'c2']) AS card FROM customer),
g AS (SELECT k, card, count(ex) AS n, min(ex) AS ex, min(evidence) AS evidence, string_agg(ex, ',' ORDER BY ex) AS candidates FROM c LEFT JOIN h USING (k, card) GROUP BY 1, 2)"""


@query(
    "q38_suggestions",
    f"""WITH {SUGGESTED}
SELECT k, card AS card_id, CASE WHEN n = 1 THEN card || ':' || ex END AS suggestion_id, CASE WHEN n = 1 THEN evidence END AS evidence,
  CASE WHEN n = 0 THEN 'no verbatim match in any exercise text field' WHEN n > 1 THEN 'ambiguous: verbatim match in ' || n || ' exercises - pick one manually' END AS reason, CASE WHEN n > 1 THEN candidates END AS candidates
FROM g""",
)
def suggestions(spark, sf_dir):
    found = wiring.suggest(wiring_lessons(spark, sf_dir))
    shown = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["field"], e["card_side"], e["matched_text"])), ";")
    return found.select(F.col("path").cast("long").alias("k"), "card_id", "suggestion_id", shown.alias("evidence"), "reason", F.array_join("candidates", ",").alias("candidates"))


@query(
    "q38b_applied",
    f"""WITH {SUGGESTED}, s AS (SELECT k, ex, card FROM g WHERE n = 1 AND card || ':' || ex IN ('c1:e1', 'c2:e2', 'c2:e9')),
a AS (SELECT k, count(*) AS wired, string_agg(card, ',' ORDER BY card) FILTER (ex = 'e1') AS e1, string_agg(card, ',' ORDER BY card) FILTER (ex = 'e2') AS e2 FROM s GROUP BY k)
SELECT c_custkey AS k, coalesce(wired, 0)::INT AS wired, concat_ws(',', 'c3', e1) AS e1, coalesce(e2, '') AS e2 FROM customer LEFT JOIN a ON a.k = c_custkey""",
)
def applied(spark, sf_dir):
    lessons = wiring_lessons(spark, sf_dir)
    accepted = spark.createDataFrame([("c1:e1",), ("c2:e2",), ("c2:e9",)], "suggestion_id string")
    done = wiring.apply_suggestions(lessons, wiring.suggest(lessons), accepted)
    ids = lambda i: F.coalesce(F.array_join(F.element_at("lesson.steps", i)["exercise"]["card_ids"], ","), F.lit(""))
    return done.select("k", "wired", ids(1).alias("e1"), ids(2).alias("e2"))


@query("q38c_unmatched", "SELECT 'c2:e9' AS suggestion_id")
def unmatched(spark, sf_dir):
    accepted = spark.createDataFrame([("c1:e1",), ("c2:e2",), ("c2:e9",)], "suggestion_id string")
    return wiring.unmatched(accepted, wiring.suggest(wiring_lessons(spark, sf_dir)))


@query(
    "q40_migrated_select",
    """
SELECT p_partkey AS k, CASE WHEN m THEN 'converted' ELSE 'skipped' END AS status, CASE WHEN NOT m THEN CASE WHEN b <> 1 THEN 'select with ' || b || ' blanks - only single-blank selects map onto one multiple_choice question' ELSE 'blank has no accept entries' END END AS reason,
  CASE WHEN m THEN 'multiple_choice' ELSE 'cloze' END AS type, CASE WHEN m THEN CASE WHEN p_partkey % 2 = 0 THEN p_name || chr(10) || chr(10) || 'a ___' ELSE 'a ___' END ELSE CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END END AS prompt,
  CASE WHEN m THEN concat_ws('|', p_brand || '+', 'wrong-', CASE WHEN p_partkey % 7 <> 0 THEN p_name || '-' END) ELSE '' END AS options,
  CASE WHEN m THEN concat_ws('; ', CASE WHEN a = 2 THEN 'dropped alternate accept ''' || p_name || ''' (multiple_choice options have exactly one text)' END, CASE WHEN p_partkey % 7 = 0 THEN 'dropped distractor ''' || p_brand || ''' (equals a correct option)' END) ELSE '' END AS notes
FROM (SELECT *, p_partkey % 3 AS b, p_size % 3 AS a, p_partkey % 3 = 1 AND p_size % 3 > 0 AS m FROM part)""",
)
def migrated_select(spark, sf_dir):
    k = F.col("p_partkey")
    accept = F.slice(F.array("p_brand", "p_name"), 1, (F.col("p_size") % 3).cast("int"))
    ex = F.struct(
        F.lit("e").alias("id"), F.lit("cloze").alias("type"), F.when(k % 2 == 0, F.col("p_name")).otherwise("").alias("prompt"), F.lit("select").alias("cloze_mode"), F.lit("a ___").alias("sentence"),
        F.slice(F.array(F.struct(accept.alias("accept")), F.struct(accept.alias("accept"))), 1, (k % 3).cast("int")).alias("blanks"), F.array(F.lit("wrong"), F.when(k % 7 == 0, F.col("p_brand")).otherwise(F.col("p_name"))).alias("distractors"),
    )
    lesson = F.struct(F.array(F.struct(F.lit("exercise").alias("type"), ex.alias("exercise"))).alias("steps"))
    done = migrate.migrate(table(spark, sf_dir, "part").select(k.alias("k"), typed(lesson).alias("lesson")))
    new, change = F.element_at("lesson.steps", 1)["exercise"], F.element_at("changes", 1)
    options = F.transform(new["options"], lambda o: F.concat(o["text"], F.when(F.coalesce(o["correct"], F.lit(False)), "+").otherwise("-")))
    return done.select(
        "k", change["status"].alias("status"), change["reason"].alias("reason"), new["type"].alias("type"), new["prompt"].alias("prompt"),
        F.coalesce(F.array_join(options, "|"), F.lit("")).alias("options"), F.coalesce(F.array_join(change["notes"], "; "), F.lit("")).alias("notes"),
    )


@query(
    "q41_ordering_lists",
    """
WITH s AS (SELECT c_custkey AS k, c_custkey % 4 AS r, lower(c_mktsegment) AS m FROM customer)
SELECT k, 'W-SET-ORDER-MIXED-PREFIX' AS id, 'some lesson ids carry an NN- ordering prefix and some do not (' || m || '); consumers sort ids lexicographically, so the unprefixed ids land wherever their first character falls' AS message FROM s WHERE r = 0
UNION ALL SELECT k, 'W-SET-ORDER-PREFIX-WIDTH', 'NN- ordering prefixes have different digit widths (1 and 2); lexicographic sorting puts ''10-'' before ''2-'', so zero-pad every prefix to one fixed width' FROM s WHERE r = 1
UNION ALL SELECT k, 'W-SET-ORDER-NUMERIC', 'the display order diverges from the numeric reading: consumers sort ''10-' || m || ''' before ''2-' || m || '''; zero-pad the embedded numbers to a fixed width' FROM s WHERE r = 1
UNION ALL SELECT k, 'W-SET-ORDER-NUMERIC', 'the display order diverges from the numeric reading: consumers sort ''' || m || '-10'' before ''' || m || '-9''; zero-pad the embedded numbers to a fixed width' FROM s WHERE r = 2""",
)
def ordering_lists(spark, sf_dir):
    m, k = F.lower("c_mktsegment"), F.col("c_custkey")
    ids = F.when(k % 4 == 0, F.array(F.concat(F.lit("01-"), m), m)).when(k % 4 == 1, F.array(F.concat(F.lit("2-"), m), F.concat(F.lit("10-"), m))).when(k % 4 == 2, F.array(F.concat(m, F.lit("-9")), F.concat(m, F.lit("-10")))).otherwise(F.array(m))
    return table(spark, sf_dir, "customer").select(k.alias("k"), F.explode(ordering.ordering_rules(ids)).alias("i")).select("k", "i.id", "i.message")


def set_manifests(spark, sf_dir) -> DataFrame:
    """A manifest of one set for each supplier, with a version that may be cached."""
    k = F.col("s_suppkey")
    book = F.struct(F.when(k % 3 == 0, " ").otherwise(F.col("s_name")).alias("title"), F.lit("A").alias("author"))
    one = F.struct(
        said("set-", k).alias("id"), F.col("s_name").alias("title"), F.when(k % 4 == 0, "de").alias("target_language"), F.when(k % 4 < 2, "fr").alias("language"), F.when(k % 5 == 0, "es").alias("source_language"),
        F.when(k % 3 == 1, "math").alias("domain"), F.lit("B1").alias("level"), F.concat(F.lit("1."), (k % 3).cast("string")).alias("version"), F.lit(3).alias("lesson_count"), F.when(k % 2 == 0, F.concat(F.lit("sets/own-"), k.cast("string"))).alias("path"),
        F.when(k % 5 == 1, "hidden").when(k % 5 == 2, "odd").alias("visibility"), F.when(k % 7 == 1, "reviewed").when(k % 7 == 2, "other").alias("review_status"), F.when(k % 2 == 1, F.array(F.lit("x"))).alias("tags"), F.when(k % 6 != 1, book).alias("book"),
    )
    cached = F.when(k % 2 == 0, F.create_map(said("set-", k), F.struct(F.lit("1.0").alias("version"), F.lit("2024-01-01").alias("downloaded_at"))))
    return table(spark, sf_dir, "supplier").select(k.alias("k"), F.lit("repo").alias("source"), F.lit("main").alias("branch"), typed(F.struct(F.array(one).alias("sets")), MANIFEST).alias("manifest"), cached.alias("cached"))


@query(
    "q42_set_entries",
    """
SELECT 'repo' AS source, 'set-' || k AS id, CASE WHEN k % 4 = 0 THEN 'de' WHEN k % 4 = 1 THEN 'fr' ELSE '' END AS target_language, CASE WHEN k % 5 = 0 THEN 'es' ELSE 'en' END AS source_language,
  CASE WHEN k % 3 = 1 THEN 'math' ELSE 'language' END AS domain, '1.' || (k % 3) AS version, CASE WHEN k % 2 = 0 THEN '1.0' END AS cached_version, k % 2 = 0 AND k % 3 <> 0 AS update_available, 'active' AS status,
  CASE WHEN k % 6 <> 1 AND k % 3 <> 0 THEN s_name END AS book_title, CASE WHEN k % 5 = 1 THEN 'hidden' ELSE 'visible' END AS visibility, CASE WHEN k % 7 = 1 THEN 'reviewed' ELSE 'authored' END AS review_status,
  CASE WHEN k % 2 = 1 THEN 'x' ELSE '' END AS tags, CASE WHEN k % 2 = 0 THEN 'sets/own-' || k ELSE 'sets/set-' || k END AS base_path
FROM (SELECT s_suppkey AS k, s_name FROM supplier)""",
)
def set_entries(spark, sf_dir):
    found = canonical.set_entries(set_manifests(spark, sf_dir))
    return found.select("source", "id", "target_language", "source_language", "domain", "version", "cached_version", "update_available", "status", F.col("book.title").alias("book_title"), "visibility", "review_status", F.array_join("tags", ",").alias("tags"), "base_path")


@query(
    "q43_aliases",
    """
SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'E-SCHEMA' WHEN s_suppkey % 3 = 1 THEN 'none' ELSE 'none' END AS found FROM supplier""",
)
def aliases(spark, sf_dir):
    """A manifest with the old name of a set's language alone, with both names, or with neither."""
    k = F.col("s_suppkey")
    one = F.struct(
        said("set-", k).alias("id"), F.col("s_name").alias("title"), F.when(k % 3 > 0, "fr").alias("language"), F.when(k % 3 == 2, "de").alias("target_language"), F.lit("B1").alias("level"), F.lit("1.0").alias("version"), F.lit(3).alias("lesson_count")
    )
    raw = F.to_json(F.struct(F.lit("m").alias("name"), F.array(one).alias("sets")))
    issues = structural.structural_issues(F.col("raw"), manifest=True)
    judged = table(spark, sf_dir, "supplier").select(k.alias("k"), raw.alias("raw")).withColumn("issues", issues)
    return judged.select("k", F.coalesce(F.get("issues", F.lit(0))["id"], F.lit("none")).alias("found"))


def inventory_lessons(spark, sf_dir) -> DataFrame:
    """set, filename, lesson of each part: its two cards and drills, by brand."""
    lessons = part_lessons(spark, sf_dir).withColumn("lesson", F.from_json("raw", LESSON))
    brand = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("set"))
    return lessons.join(brand, "k").select("set", F.concat(F.col("k").cast("string"), F.lit(".json")).alias("filename"), "lesson")


@query(
    "q44_inventory",
    """
WITH p AS (SELECT p_brand AS "set", p_partkey AS k, p_partkey // 6 AS n FROM part WHERE (p_partkey // 6) % 37 <> 0)
SELECT "set", k || '.json' AS lesson, CASE WHEN n % 19 = 0 THEN 'same-stable-id' ELSE 'card-two-' || k END AS stable_id, 'card' AS kind, 'card' AS type, 'c2' AS element, CASE WHEN n % 3 = 0 THEN 0 ELSE 1 END AS place FROM p
UNION ALL SELECT "set", k || '.json', 'same-stable-id', 'card', 'card', 'c1', 0 FROM p WHERE n % 19 = 0 AND n % 3 <> 0""",
)
def inventory(spark, sf_dir):
    return identity.inventory(inventory_lessons(spark, sf_dir)).select("set", "lesson", "stable_id", "kind", "type", "element", F.col("ord.at").alias("place"))


@query(
    "q44b_used_twice",
    """
WITH p AS (SELECT p_brand AS "set", p_partkey AS k, p_partkey // 6 AS n FROM part WHERE (p_partkey // 6) % 37 <> 0 AND (p_partkey // 6) % 19 = 0),
c AS (SELECT "set", sum(CASE WHEN n % 3 = 0 THEN 1 ELSE 2 END)::BIGINT AS n FROM p GROUP BY 1)
SELECT "set", 'V2' AS rule, n FROM c WHERE n > 1""",
)
def used_twice(spark, sf_dir):
    """V2 among all violations of an unchanged tree: ids that a set uses more than once."""
    lessons = inventory_lessons(spark, sf_dir)
    none = lessons.select("set", F.lit("x").alias("stable_id")).limit(0)
    tree = identity.inventory(lessons), lessons.select("set", "filename"), none
    found = identity.violations(tree, tree)
    return found.select("set", "rule", F.regexp_extract("message", r"is used ([0-9]+) times", 1).cast("long").alias("n"))


@query(
    "q45_mint",
    """
WITH s AS (SELECT s_suppkey AS k, 'card-' || substr(sha256(s_suppkey || '|card|0|'), 1, 12) AS card, 'ex-' || substr(sha256(s_suppkey || '|exercise|1|'), 1, 12) AS ex, s_suppkey % 3 = 0 AS has, s_suppkey % 7 = 0 AS bad FROM supplier)
SELECT k, NOT bad AS ok, CASE WHEN bad THEN 0 WHEN has THEN 1 ELSE 2 END AS minted, CASE WHEN NOT bad THEN
  '{"id":"l","cards":[{"id":"c1"' || CASE WHEN has THEN ',"stable_id":"own-id-1"' ELSE ', "stable_id": "' || card || '"' END || ',"front":"f"}],"steps":[{"id":"s1"},{"id":"s2","exercise":{"id":"e1", "stable_id": "' || ex || '","type":"free_text"}}]}' END AS new_text
FROM s""",
)
def minted(spark, sf_dir):
    k = F.col("s_suppkey")
    own = F.when(k % 3 == 0, ',"stable_id":"own-id-1"').otherwise("")
    raw = F.concat(F.lit('{"id":"l","cards":[{"id":"c1"'), own, F.lit(',"front":"f"}],"steps":[{"id":"s1"},{"id":"s2","exercise":{"id":"e1","type":"free_text"}}]'), F.when(k % 7 == 0, "").otherwise("}"))
    done = mint.mint(table(spark, sf_dir, "supplier").select(k.cast("string").alias("path"), raw.alias("raw")))
    return done.select(F.col("path").cast("long").alias("k"), "ok", "minted", "new_text")


def qti_documents(spark, sf_dir) -> DataFrame:
    """k, path, xml of one item for each part: choice, text entry, match, an unsupported one, none, or broken XML."""
    k = F.col("p_partkey")
    name, brand = qti.escaped(F.col("p_name")), qti.escaped(F.col("p_brand"))
    ns = qti.NAMESPACE
    put = lambda template, *values: qti._put(template, *values)
    right = lambda value: put('<responseDeclaration identifier="RESPONSE" cardinality="single"><correctResponse><value>{}</value></correctResponse></responseDeclaration>', value)
    choice = put('{}<itemBody><choiceInteraction responseIdentifier="RESPONSE"><prompt>Pick</prompt><simpleChoice identifier="A">{}</simpleChoice><simpleChoice identifier="B"> {} </simpleChoice></choiceInteraction></itemBody>', right(F.lit("B")), name, brand)
    entry = put('{}<itemBody><p>Say <b>{}</b></p><textEntryInteraction responseIdentifier="RESPONSE"/></itemBody>', right(name), brand)
    match = put(
        '{}<itemBody><matchInteraction responseIdentifier="RESPONSE"><simpleMatchSet><simpleAssociableChoice identifier="L">{}</simpleAssociableChoice></simpleMatchSet><simpleMatchSet><simpleAssociableChoice identifier="R">{}</simpleAssociableChoice></simpleMatchSet></matchInteraction></itemBody>',
        right(F.lit("L R")), name, brand,
    )
    other = F.lit("<itemBody><orderInteraction/></itemBody>")
    item = F.when(k % 6 == 0, choice).when(k % 6 == 1, entry).when(k % 6 == 2, match).otherwise(other)
    whole = put(f'<assessmentItem xmlns="{ns}" identifier="item-{{}}" title="T">{{}}</assessmentItem>', k.cast("string"), item)
    xml = F.when(k % 6 == 4, f'<assessmentTest xmlns="{ns}" identifier="t"/>').when(k % 6 == 5, "<broken").otherwise(whole)
    return dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")).select(k.alias("k"), k.cast("string").alias("path"), xml.alias("xml"))


QTI_PARTS = """
q AS (SELECT p_partkey AS k, p_partkey % 6 AS kind, p_name, p_brand FROM part)"""


@query(
    "q46_qti_import",
    f"""WITH {QTI_PARTS}
SELECT k, kind < 3 AS ok, CASE kind WHEN 0 THEN 'multiple_choice' WHEN 1 THEN 'free_text' WHEN 2 THEN 'matching' END AS type, CASE kind WHEN 0 THEN 'Pick' WHEN 1 THEN 'Say ' || p_brand WHEN 2 THEN 'T' END AS prompt,
  CASE kind WHEN 0 THEN p_name || '-|' || p_brand || '+' WHEN 1 THEN p_name WHEN 2 THEN p_name || '=' || p_brand END AS parts,
  CASE kind WHEN 3 THEN 'QTI import failed: 1 item(s) could not be mapped - item-' || k || ': orderInteraction (unsupported QTI interaction)' WHEN 4 THEN 'QTI document contains no assessmentItem elements' WHEN 5 THEN 'QTI document has no root element' END AS error
FROM q""",
)
def qti_import(spark, sf_dir):
    done = qti.import_qti(qti_documents(spark, sf_dir)).withColumn("ex", F.element_at(F.from_json("raw", LESSON)["steps"], 1)["exercise"])
    ex = F.col("ex")
    options = F.array_join(F.transform(ex["options"], lambda o: F.concat(o["text"], F.when(F.coalesce(o["correct"], F.lit(False)), "+").otherwise("-"))), "|")
    pairs = F.array_join(F.transform(ex["pairs"], lambda p: F.concat_ws("=", p["left"], p["right"])), "|")
    parts = F.when(ex["type"] == "multiple_choice", options).when(ex["type"] == "free_text", F.array_join(ex["accept"], "|")).when(ex["type"] == "matching", pairs)
    return done.select(F.col("path").cast("long").alias("k"), "ok", ex["type"].alias("type"), ex["prompt"].alias("prompt"), parts.alias("parts"), "error")


@query(
    "q46b_qti_round_trip",
    f"""WITH {QTI_PARTS} SELECT k, true AS same FROM q WHERE kind < 3""",
)
def qti_round_trip(spark, sf_dir):
    """What is exported and imported again is the lesson that was exported."""
    read = lambda rows: computed(rows, lesson=F.from_json("raw", LESSON)).select("path", "lesson")
    lessons = stored(read(qti.import_qti(qti_documents(spark, sf_dir)).filter("ok")), "qti-lessons")  # read twice
    again = read(qti.import_qti(qti.export_qti(lessons).select("path", "xml"))).withColumnRenamed("lesson", "again")
    content = lambda lesson: F.to_json(F.transform(lesson["steps"], lambda s: s["exercise"]))
    return lessons.join(again, "path").select(F.col("path").cast("long").alias("k"), (content(F.col("lesson")) == content(F.col("again"))).alias("same"))


@query(
    "q46c_qti_export",
    """
WITH p AS (SELECT p_partkey AS k, replace(replace(replace(p_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS name, p_partkey % 3 AS kind FROM part)
SELECT k, CASE WHEN kind < 2 THEN concat_ws(chr(10), '<?xml version="1.0" encoding="UTF-8"?>', '<assessmentTest xmlns="http://www.imsglobal.org/xsd/imsqti_v2p1" identifier="l-' || k || '" title="T">',
  '  <testPart identifier="part1" navigationMode="linear" submissionMode="individual">', '    <assessmentSection identifier="section1" title="T" visible="true">',
  '  <assessmentItem identifier="e1" title="e1" adaptive="false" timeDependent="false">',
  '    <responseDeclaration identifier="RESPONSE" cardinality="single" baseType="' || CASE kind WHEN 0 THEN 'identifier' ELSE 'string' END || '">', '      <correctResponse>',
  '        <value>' || CASE kind WHEN 0 THEN 'OPT1' ELSE name END || '</value>', '      </correctResponse>', '    </responseDeclaration>', '    <itemBody>',
  CASE kind WHEN 0 THEN concat_ws(chr(10), '      <choiceInteraction responseIdentifier="RESPONSE" shuffle="false" maxChoices="1">', '        <prompt>a &lt; b</prompt>',
    '        <simpleChoice identifier="OPT0">x</simpleChoice>', '        <simpleChoice identifier="OPT1">' || name || '</simpleChoice>', '      </choiceInteraction>')
  ELSE concat_ws(chr(10), '      <p>a &lt; b</p>', '      <textEntryInteraction responseIdentifier="RESPONSE" expectedLength="20"/>') END,
  '    </itemBody>', '  </assessmentItem>', '    </assessmentSection>', '  </testPart>', '</assessmentTest>', '') END AS xml,
  CASE WHEN kind = 2 THEN 'QTI export cannot represent exercise type(s): e1 (word_tiles)' END AS error
FROM p""",
)
def qti_export(spark, sf_dir):
    k, name = F.col("p_partkey"), F.col("p_name")
    option = lambda text, right: F.struct(text.alias("text"), F.lit(right).alias("correct"))
    ex = F.struct(
        F.lit("e1").alias("id"), F.when(k % 3 == 0, "multiple_choice").when(k % 3 == 1, "free_text").otherwise("word_tiles").alias("type"), F.lit("a < b").alias("prompt"),
        F.when(k % 3 == 0, F.array(option(F.lit("x"), False), option(name, True))).alias("options"), F.when(k % 3 == 1, F.array(name)).alias("accept"),
    )
    lesson = F.struct(said("l-", k).alias("id"), F.lit("T").alias("title"), F.array(F.struct(F.lit("exercise").alias("type"), ex.alias("exercise"))).alias("steps"))
    done = qti.export_qti(table(spark, sf_dir, "part").select(k.cast("string").alias("path"), typed(lesson).alias("lesson")))
    return done.select(F.col("path").cast("long").alias("k"), "xml", "error")


@query(
    "q47_yaml",
    """
SELECT c_custkey AS k, CASE WHEN c_custkey % 5 > 0 THEN c_name END AS name, CASE WHEN c_custkey % 5 > 0 THEN '1.10' END AS version, CASE WHEN c_custkey % 5 > 0 THEN 'no' END AS language, CASE WHEN c_custkey % 5 > 0 THEN (c_custkey % 100)::INT END AS lessons, CASE WHEN c_custkey % 5 > 0 THEN true END AS flag, c_custkey % 5 = 0 AS failed
FROM customer""",
)
def yaml_manifests(spark, sf_dir):
    k = F.col("c_custkey")
    text = F.concat(
        F.lit("# a manifest\nname: "), F.col("c_name"), F.lit('\nmetadata:\n  flag: true\nsets:\n  - id: a\n    title: >-\n      some\n      title\n    version: "1.10"\n    language: no\n    lesson_count: '), (k % 100).cast("string"), F.when(k % 5 == 0, "\n  tags: [").otherwise("\n")
    )
    found = yaml_of.manifests(dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_name")).select(k.cast("string").alias("path"), text.alias("raw")))
    first = F.element_at("manifest.sets", 1)
    return found.select(F.col("path").cast("long").alias("k"), F.col("manifest.name").alias("name"), first["version"].alias("version"), first["language"].alias("language"), first["lesson_count"].alias("lessons"), F.expr("try_variant_get(manifest.metadata, '$.flag', 'boolean')").alias("flag"), F.col("error").isNotNull().alias("failed"))


@query(
    "q48_paths",
    """
SELECT doc_id, 'repo/' || lang || '/s' || (doc_id % 4) AS "set", CASE WHEN doc_id % 5 = 0 THEN 'manifest.yaml' ELSE doc_id || CASE WHEN doc_id % 2 = 0 THEN '.json' ELSE '.md' END END AS file, doc_id % 5 <> 0 AND doc_id % 2 = 0 AS is_lesson, doc_id % 5 = 0 AS is_manifest FROM documents""",
)
def paths(spark, sf_dir):
    i = F.col("doc_id")
    folder = F.concat(F.lit("repo/"), "lang", F.lit("/s"), (i % 4).cast("string"))
    path = F.when(i % 5 == 0, F.concat(folder, F.lit("/manifest.yaml"))).otherwise(F.concat(folder, F.lit("/lessons/"), i.cast("string"), F.when(i % 2 == 0, ".json").otherwise(".md")))
    rows = table(spark, sf_dir, "documents").select("doc_id", path.alias("name"))
    name = F.col("name")
    return rows.select("doc_id", files_of.set_of(name).alias("set"), files_of.file_of(name).alias("file"), files_of.is_lesson(name).alias("is_lesson"), files_of.is_set_manifest(name).alias("is_manifest"))


@query(
    "q49_stable_ids",
    """
SELECT p_partkey AS k, ok AND n % 19 = 0 AND n % 3 <> 0 AS any_twice, CASE WHEN ok THEN 1 + (n % 19 = 0 AND n % 3 <> 0)::INT ELSE 0 END AS with_id, CASE WHEN NOT ok THEN '' WHEN n % 2 = 1 OR n % 3 = 0 OR n % 17 = 0 AND n % 11 <> 0 THEN CASE WHEN n % 3 = 0 THEN 'c2' ELSE 'c1,c2' END ELSE 'c2' END AS unused
FROM (SELECT *, p_partkey // 6 AS n, (p_partkey // 6) % 37 <> 0 AS ok FROM part)""",
)
def stable_id_columns(spark, sf_dir):
    lesson = F.col("lesson")
    rows = part_lessons(spark, sf_dir).withColumn("lesson", F.from_json("raw", LESSON))
    return rows.select("k", (F.size(rules.stable_id_duplicates(lesson)) > 0).alias("any_twice"), F.size(rules.stable_elements(lesson)).alias("with_id"), F.array_join(rules.unused_cards(lesson), ",").alias("unused"))


@query(
    "q50_majors",
    """
SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'ext:a-b=1' WHEN 1 THEN 'ext:a-b=2,ext:c-d=0' WHEN 2 THEN '' ELSE 'ext:e-f@1=3' END AS majors FROM orders""",
)
def majors(spark, sf_dir):
    k = F.col("o_orderkey")
    texts = lambda *xs: F.array(*[F.lit(x) for x in xs])
    named = F.when(k % 4 == 0, texts("ext:a-b@1", "ext:none", "ext:x@1.5")).when(k % 4 == 1, texts("ext:a-b@2", "ext:c-d@")).when(k % 4 == 3, texts("ext:e-f@1@3"))
    found = rules.required_majors(typed(F.struct(named.alias("requires_extensions"))))
    return table(spark, sf_dir, "orders").select(k.alias("k"), F.array_join(F.transform(found, lambda m: F.concat_ws("=", m["type"], m["major"].cast("string"))), ",").alias("majors"))


@query(
    "q51_conformance",
    """
WITH p AS (SELECT p_brand AS repo, p_partkey, p_partkey // 6 AS n FROM part)
SELECT repo, count(*) AS lessons, count_if(n % 37 = 0) AS parse_errors FROM p GROUP BY 1""",
)
def conformance_by_repo(spark, sf_dir):
    judged = validate_lessons(part_lessons(spark, sf_dir))
    brand = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("repo"))
    rows = judged.join(brand, "k")
    return conformance.tally(rows.withColumn("what", F.struct("repo")).select("repo", "ok_json"), "repo").select("repo", F.col("n").alias("lessons")).join(
        rows.groupBy("repo").agg(F.count_if(~F.col("ok_json")).alias("parse_errors")), "repo"
    )


@query(
    "q52_exit_code",
    "SELECT 1 AS exit_code",
)
def exit_code(spark, sf_dir):
    return reports.failed(validate_lessons(part_lessons(spark, sf_dir)), "valid")
