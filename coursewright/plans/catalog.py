"""The operators over the driver's tables, each beside DuckDB SQL that gives the same rows.

The tables hold no lessons; each query first builds the lesson-shaped view that its operator
takes, over whole tables. Counts and lengths are long on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coursewright.functions.invisible import invisible_count
from coursewright.functions.textsem import blank, markers, matches_whole, tells_length, trimmed
from coursewright.operators import canonical, conformance, extensions, identity, migrate, ordering, parity, wiring
from coursewright.plans import rules, validate
from coursewright.schemas import EXERCISE, LESSON, SLUG, STABLE_ID

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of a few bytes that each become a lesson: one file of them, read by one task, is work for all cores."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


@query(
    "q01_wiring",
    """
SELECT b.item_id AS card_id, CASE WHEN count(d.doc_id) = 0 THEN 'none' WHEN count(d.doc_id) = 1 THEN 'suggest' ELSE 'ambiguous' END AS verdict,
  count(d.doc_id) AS exercises, CASE WHEN count(d.doc_id) = 1 THEN min(d.doc_id) END AS exercise_id
FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) AND b.text <> '' GROUP BY b.item_id""",
)
def wiring_verdicts(spark, sf_dir):
    cards = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("card_id"), "text")
    quotes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("exercise_id"), F.col("text").alias("quote"))
    return wiring.verdicts(cards, wiring.keyed_containment(cards, quotes), [])


@query("q02_dup_ids", "SELECT md5(text) AS stable_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select(F.md5("text").alias("stable_id"))
    return identity.duplicate_counts(ids, ["stable_id"])


@query("q02b_dup_places", "SELECT md5(text) AS stable_id, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS places FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_places(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select(F.md5("text").alias("stable_id"), F.col("doc_id").alias("ord"))
    found = identity.duplicate_ids(ids, ["stable_id"])
    return found.withColumn("places", F.array_join(F.transform("places", lambda p: p["ord"].cast("string")), ","))


@query("q03_dup_in_set", 'SELECT source AS "set", md5(text) AS stable_id, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1')
def dup_in_set(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select(F.col("source").alias("set"), F.md5("text").alias("stable_id"))
    return identity.duplicate_counts(ids, identity.KEY)


def elements(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("set"), F.col("doc_id").alias("stable_id"), F.lit("exercise").alias("kind"), F.col("lang").alias("type"), F.col("doc_id").alias("ord"), F.col("doc_id").alias("lesson"))


BASE, HEAD = "stable_id % 10 <> 0", "stable_id % 7 <> 0"


def head(spark, sf_dir) -> DataFrame:
    return elements(spark, sf_dir).filter(HEAD).withColumn("type", F.when(F.col("stable_id") % 11 == 0, "zz").otherwise(F.col("type")))


def retired(spark, sf_dir, condition: str) -> DataFrame:
    return elements(spark, sf_dir).filter(condition).select(*identity.KEY)


ELEMENTS = "WITH e AS (SELECT source AS \"set\", doc_id AS stable_id, 'exercise' AS kind, lang AS type FROM documents), b AS (SELECT * FROM e WHERE stable_id % 10 <> 0), h AS (SELECT * EXCLUDE type, CASE WHEN stable_id % 11 = 0 THEN 'zz' ELSE type END AS type FROM e WHERE stable_id % 7 <> 0)"


@query("q04_v1", f'{ELEMENTS} SELECT b."set", b.stable_id FROM b ANTI JOIN h USING ("set", stable_id) ANTI JOIN (SELECT * FROM e WHERE stable_id % 14 = 0) r USING ("set", stable_id)')
def v1(spark, sf_dir):
    base = elements(spark, sf_dir).filter(BASE)
    return identity.disappeared(base, head(spark, sf_dir), retired(spark, sf_dir, "stable_id % 14 = 0")).select(*identity.KEY)


@query("q05_v3", f'{ELEMENTS} SELECT b."set", b.stable_id, b.type, h.kind AS now_kind, h.type AS now_type FROM b JOIN h USING ("set", stable_id) WHERE b.kind <> h.kind OR b.type <> h.type')
def v3(spark, sf_dir):
    return identity.moved(elements(spark, sf_dir).filter(BASE), head(spark, sf_dir)).select(*identity.KEY, "type", "now_kind", "now_type")


@query(
    "q06_v4",
    """
WITH f AS (SELECT DISTINCT source AS "set", doc_id % 40 AS filename FROM documents), h AS (SELECT * FROM f WHERE "set" <> 'src3' AND filename < 35)
SELECT f."set", f.filename FROM f SEMI JOIN h USING ("set") ANTI JOIN h h2 USING ("set", filename)""",
)
def v4(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("source").alias("set"), (F.col("doc_id") % 40).alias("filename")).distinct()
    return identity.lost_files(files, files.filter("set <> 'src3' AND filename < 35"))


@query("q07_v5", 'SELECT source AS "set", doc_id AS stable_id FROM documents WHERE doc_id % 14 = 0 AND doc_id % 28 <> 0')
def v5(spark, sf_dir):
    return identity.unretired(retired(spark, sf_dir, "stable_id % 14 = 0"), retired(spark, sf_dir, "stable_id % 28 = 0"))


@query("q08_v6", 'SELECT source AS "set", doc_id AS stable_id FROM documents WHERE doc_id % 15 = 0 AND doc_id % 7 <> 0')
def v6(spark, sf_dir):
    return identity.retired_alive(retired(spark, sf_dir, "stable_id % 15 = 0"), head(spark, sf_dir))


def snapshots(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("source").alias("set"), (F.col("doc_id") % 40).cast("string").alias("filename")).distinct()
    base = elements(spark, sf_dir).filter(BASE), files, retired(spark, sf_dir, "stable_id % 14 = 0")
    return base, (head(spark, sf_dir), files.filter("set <> 'src3' AND cast(filename as int) < 35"), retired(spark, sf_dir, "stable_id % 28 = 0 OR stable_id % 15 = 0"))


SNAPSHOTS = f"""{ELEMENTS},
br AS (SELECT "set", stable_id FROM e WHERE stable_id % 14 = 0), hr AS (SELECT "set", stable_id FROM e WHERE stable_id % 28 = 0 OR stable_id % 15 = 0),
bf AS (SELECT DISTINCT source AS "set", (doc_id % 40)::VARCHAR AS filename FROM documents), hf AS (SELECT * FROM bf WHERE "set" <> 'src3' AND filename::INT < 35)"""


@query(
    "q08b_violations",
    f"""{SNAPSHOTS},
v AS (
  SELECT 'V1' AS rule, "set", 'stable_id ''' || stable_id || ''' (exercise in ' || stable_id || ') disappeared without being declared in the set''s retired_ids; declare the retirement or restore the element' AS message FROM b ANTI JOIN h USING ("set", stable_id) ANTI JOIN hr USING ("set", stable_id)
  UNION ALL SELECT 'V3', b."set", 'stable_id ''' || b.stable_id || ''' moved from exercise/' || b.type || ' to exercise/' || h.type || ' (id reuse)' FROM b JOIN h USING ("set", stable_id) WHERE b.type <> h.type
  UNION ALL SELECT 'V5', "set", 'retired_id ''' || stable_id || ''' left the set''s retired_ids list; a published retirement is never un-declared' FROM br ANTI JOIN hr USING ("set", stable_id)
  UNION ALL SELECT 'V6', "set", 'retired_id ''' || stable_id || ''' is declared retired but still present in the set; a consumer resolves it as living, so the retirement would be silently ignored - remove the element or the declaration' FROM hr SEMI JOIN h USING ("set", stable_id)
  UNION ALL SELECT 'V4', "set", 'lesson file ''' || filename || ''' is gone while its set survives; the filename is the lesson''s identity for progress joins' FROM bf SEMI JOIN hf USING ("set") ANTI JOIN hf h2 USING ("set", filename))
SELECT * FROM v""",
)
def all_violations(spark, sf_dir):
    return identity.violations(*snapshots(spark, sf_dir)).select("rule", "set", "message")


@query(
    "q08c_checked",
    f"""{SNAPSHOTS} SELECT (SELECT count(*) FROM b) AS base_ids, (SELECT count(*) FROM bf) AS base_lessons, (SELECT count(*) FROM br) AS base_retired,
  (SELECT count(*) FROM h) AS head_ids, (SELECT count(*) FROM hf) AS head_lessons, (SELECT count(*) FROM hr) AS head_retired,
  NOT ((SELECT count(*) FROM hf) > 0 AND (SELECT count(*) FROM bf) = 0) AS credible, (SELECT count(*) FROM bf) > 0 AND (SELECT count(*) FROM hf) = 0 AS head_empty""",
)
def all_checked(spark, sf_dir):
    return identity.checked(*snapshots(spark, sf_dir))


def covered(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.expr("doc_id div 3").alias("set"), F.col("doc_id").alias("lesson"))
    has = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("lesson"), F.lit(True).alias("has_id")).distinct()
    return identity.coverage(d.select("set").distinct(), d.join(has, "lesson", "left").withColumn("has_id", F.coalesce("has_id", F.lit(False))))


COVERED = "WITH c AS (SELECT doc_id // 3 AS \"set\", count(*) AS lessons, bool_and(l.doc_id IS NOT NULL) AS covered FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1)"


@query("q09_coverage", f'{COVERED} SELECT "set", lessons, covered FROM c')
def coverage(spark, sf_dir):
    return covered(spark, sf_dir)


@query(
    "q10_gate",
    f"""{COVERED}, t AS (SELECT count(*) AS total, count_if(covered) AS n, string_agg("set"::VARCHAR, ', ' ORDER BY "set"::VARCHAR) FILTER (NOT covered) AS names FROM c)
SELECT 'REGRESSION' AS rule, 'coverage ' || n || ' below baseline 1000000 (regression)' AS message FROM t WHERE n < 1000000
UNION ALL SELECT 'INCOMPLETE', (total - n) || ' listed set(s) carry no complete stable_id coverage: ' || names FROM t WHERE total > n""",
)
def gate(spark, sf_dir):
    return identity.gate(covered(spark, sf_dir), 1_000_000)


def order_pairs(spark, sf_dir) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    return line.join(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey")


def order_issues(spark, sf_dir) -> DataFrame:
    """l_orderkey, ex, i: an exercise that matches the names of an order's parts with their brands, and each of its issues."""
    pairs = order_pairs(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("p_name").alias("left"), F.col("p_brand").alias("right"))).alias("pairs"))
    ex = F.struct("pairs", F.lit(False).alias("from_cards"), F.array().cast("array<string>").alias("card_ids"))
    judged = validate.computed(pairs, ex=ex).select("l_orderkey", "ex")
    return judged.select("l_orderkey", "ex", F.explode(rules.matching(F.col("ex"), F.lit("/exercise"))).alias("i"))


@query("q11_dup_left", "SELECT l_orderkey, lower(trim(p_name)) AS term, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 HAVING count(*) > 1")
def dup_left(spark, sf_dir):
    said = r"(?s)left value '(.*)' is repeated at positions ([0-9, ]+);"
    found = order_issues(spark, sf_dir).filter("i.id = 'E-MATCH-DUP-LEFT'")
    return found.select("l_orderkey", F.lower(trimmed(F.regexp_extract("i.message", said, 1))).alias("term"), F.size(F.split(F.regexp_extract("i.message", said, 2), ", ")).cast("long").alias("n"))


@query("q12_ambig", "SELECT l_orderkey, count(*) AS pairs, count(DISTINCT p_brand) AS rights FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(*) > count(DISTINCT p_brand)")
def ambiguous(spark, sf_dir):
    found = order_issues(spark, sf_dir).filter("i.id = 'W-MATCH-AMBIG'")
    rights = F.array_distinct(F.transform("ex.pairs", lambda p: p["right"]))
    return found.select("l_orderkey", F.size("ex.pairs").cast("long").alias("pairs"), F.size(rights).cast("long").alias("rights"))


@query("q13_markers", "SELECT doc_id, (len(string_split(replace(text, ' the ', ' ___ '), '___')) - 1)::BIGINT AS markers FROM documents")
def marker_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", markers(F.replace("text", F.lit(" the "), F.lit(" ___ "))).cast("long").alias("markers"))


INVISIBLE_SQL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}\x{ad}\x{200b}-\x{200f}\x{2028}-\x{202e}\x{2060}-\x{206f}\x{feff}]"


@query(
    "q14_invisible",
    f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN chr(173) || text || chr(8203) ELSE text END AS text FROM documents)
SELECT doc_id, len(regexp_extract_all(text, '{INVISIBLE_SQL}'))::BIGINT AS n FROM t WHERE regexp_matches(text, '{INVISIBLE_SQL}')""",
)
def invisible(spark, sf_dir):
    text = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("­"), "text", F.lit("​"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", invisible_count(text).cast("long").alias("n")).filter("n > 0")


@query(
    "q15_slug",
    rf"""SELECT p_partkey, regexp_full_match(p_name, '{SLUG}') AS plain, regexp_full_match(replace(lower(p_name), ' ', '-'), '{SLUG}') AS dashed, regexp_full_match(md5(p_name), '{STABLE_ID}') AS id_ok FROM part""",
)
def slugs(spark, sf_dir):
    dashed = F.replace(F.lower("p_name"), F.lit(" "), F.lit("-"))
    return table(spark, sf_dir, "part").select("p_partkey", matches_whole(F.col("p_name"), SLUG).alias("plain"), matches_whole(dashed, SLUG).alias("dashed"), matches_whole(F.md5("p_name"), STABLE_ID).alias("id_ok"))


def set_ids(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("set"), F.concat_ws("-", "p_name", F.col("p_size").cast("string")).alias("id"), F.col("p_partkey").alias("position"))


@query(
    "q16_ordering",
    """
WITH ids AS (SELECT p_brand AS "set", p_name || '-' || p_size AS id, p_partkey AS pos, p_name, p_size FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY "set" ORDER BY id, pos) AS a, row_number() OVER (PARTITION BY "set" ORDER BY p_name, p_size, pos) AS b FROM ids),
d AS (SELECT x."set", x.a AS rank, x.id AS shown, y.id AS meant FROM k x JOIN k y ON x."set" = y."set" AND x.a = y.b WHERE x.id <> y.id)
SELECT "set", min(rank) AS rank, arg_min(shown, rank) AS shown, arg_min(meant, rank) AS meant FROM d GROUP BY "set\"""",
)
def divergence(spark, sf_dir):
    return ordering.divergence(set_ids(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


def prefixed_ids(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    number = F.when(F.col("p_size") >= 10, F.concat(F.col("p_size").cast("string"), F.lit("-"))).when(F.col("p_size") >= 5, F.concat(F.lit("00"), F.col("p_size").cast("string"), F.lit("-"))).otherwise("")
    return p.select(F.col("p_brand").alias("set"), F.concat(number, F.lit("x"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("id"))


PREFIXED = "WITH i AS (SELECT p_brand AS \"set\", CASE WHEN p_size >= 10 THEN p_size || '-' WHEN p_size >= 5 THEN '00' || p_size || '-' ELSE '' END || 'x' || replace(p_name, ' ', '-') AS id FROM part)"


@query("q17_prefix", f"""{PREFIXED} SELECT "set", count_if(NOT regexp_matches(id, '^[0-9]+-')) AS bare, count(*) AS total FROM i GROUP BY 1 HAVING bare > 0 AND bare < total""")
def prefixes(spark, sf_dir):
    return ordering.mixed_prefixes(prefixed_ids(spark, sf_dir))


@query(
    "q18_width",
    f"""{PREFIXED}, w AS (SELECT DISTINCT "set", len(regexp_extract(id, '^([0-9]+)-', 1)) AS n FROM i WHERE regexp_matches(id, '^[0-9]+-'))
SELECT "set", string_agg(n::VARCHAR, ' and ' ORDER BY n) AS widths FROM w GROUP BY 1 HAVING count(*) > 1""",
)
def widths(spark, sf_dir):
    return ordering.prefix_widths(prefixed_ids(spark, sf_dir))


@query("q19_unused", "SELECT p_partkey, p_name FROM part ANTI JOIN (SELECT l_partkey AS p_partkey FROM lineitem WHERE l_quantity > 45) USING (p_partkey)")
def unused(spark, sf_dir):
    """A lesson for ten parts: they are its cards, and the large lines that order them its exercises."""
    used = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.expr("l_partkey div 10").alias("lesson_id"), F.col("l_partkey").cast("string").alias("card")).distinct()
    steps = used.groupBy("lesson_id").agg(F.collect_list(F.struct(F.struct(F.array("card").alias("card_ids")).alias("exercise"))).alias("steps"))
    cards = table(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 10").alias("lesson_id")).agg(F.collect_list(F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("front"))).alias("cards"))
    lessons = cards.join(steps, "lesson_id", "left").select(F.struct("cards", "steps").alias("lesson"))
    left = rules.unused_cards(F.col("lesson"))
    named = lessons.select(F.explode(F.filter("lesson.cards", lambda c: F.array_contains(left, c["id"]))).alias("c"))
    return named.select(F.col("c.id").cast("long").alias("p_partkey"), F.col("c.front").alias("p_name"))


@query("q20_cardref", "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem ANTI JOIN (SELECT p_partkey AS l_partkey FROM part WHERE p_size <= 40) USING (l_partkey)")
def card_refs(spark, sf_dir):
    """A lesson for each order: its parts of size 40 or less are cards, and an exercise names all its lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"), "l_linenumber")
    rows = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", "left")
    ref = F.concat_ws("/", "p_partkey", "l_linenumber")
    lessons = rows.groupBy("l_orderkey").agg(F.collect_list(ref).alias("card_ids"), F.collect_list(F.when(F.col("p_size") <= 40, ref)).alias("cards"))
    ex = typed(F.struct(F.lit("e").alias("id"), F.lit("free_text").alias("type"), "card_ids"), EXERCISE)
    majors = F.array().cast("array<struct<type string, major int>>")
    found = rules.exercise(F.col("ex"), F.lit("/exercise"), F.col("cards"), majors, {})
    told = lessons.select("l_orderkey", "cards", ex.alias("ex")).select("l_orderkey", F.explode(found).alias("i")).filter("i.id = 'E-CARD-REF'")
    at = F.split(F.regexp_extract("i.message", r"unknown card '([0-9/]+)'", 1), "/")
    return told.select("l_orderkey", at[0].cast("long").alias("l_partkey"), at[1].cast("int").alias("l_linenumber"))


def typed(x, kind: str):
    """A struct as one of the format's types, what it doesn't have null."""
    return F.from_json(F.to_json(x), kind)


def conversation_steps(spark, sf_dir) -> DataFrame:
    """A lesson step per turn: assistants drill, others teach; some payloads and bodies are left out."""
    c = table(spark, sf_dir, "conversations")
    drill = F.col("role") == "assistant"
    ex = F.when(F.col("turn") % 3 != 0, F.from_json(F.to_json(F.struct(F.lit("e").alias("id"), F.lit("free_text").alias("type"), F.col("text").alias("prompt"), F.when(F.col("turn") % 5 != 0, F.array("text")).alias("accept"))), EXERCISE))
    return c.select(
        "conv_id",
        "turn",
        "role",
        F.struct(F.when(drill, "exercise").otherwise("theory").alias("type"), F.when(F.col("turn") % 4 != 2, F.col("text")).alias("body"), ex.alias("exercise")).alias("step"),
    )


@query(
    "q21_steps",
    """
WITH s AS (SELECT conv_id, turn, role = 'assistant' AS drill, CASE WHEN turn % 4 <> 2 THEN text END AS body, turn % 3 <> 0 AS has_ex, turn % 5 <> 0 AS has_accept FROM conversations),
f AS (
  SELECT conv_id, turn, unnest([CASE WHEN NOT drill AND coalesce(body, '') = '' THEN 'E-STEP-THEORY-BODY' END, CASE WHEN NOT drill AND has_ex THEN 'E-STEP-THEORY-EXERCISE' END,
    CASE WHEN drill AND NOT has_ex THEN 'E-STEP-EXERCISE-PAYLOAD' END, CASE WHEN drill AND has_ex AND NOT has_accept THEN 'E-FREETEXT-ACCEPT' END,
    CASE WHEN drill AND body IS NOT NULL THEN 'E-STEP-EXERCISE-BODY' END]) AS id FROM s)
SELECT conv_id, turn, id FROM f WHERE id IS NOT NULL""",
)
def step_rules(spark, sf_dir):
    none = F.array().cast("array<string>")
    majors = F.array().cast("array<struct<type string, major int>>")
    found = rules.step(F.col("step"), F.concat(F.lit("/steps/"), F.col("turn").cast("string")), none, majors, {})
    return conversation_steps(spark, sf_dir).select("conv_id", "turn", F.explode(found).alias("i")).select("conv_id", "turn", "i.id")


@query(
    "q22_from_cards",
    """SELECT l_orderkey, string_agg(p_name || '=' || p_brand, ', ' ORDER BY l_linenumber, l_partkey, l_extendedprice) AS pairs FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 40 GROUP BY 1""",
)
def from_cards(spark, sf_dir):
    """A lesson for each order: an exercise whose pairs come from the cards of its lines, in order."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"), "l_linenumber", "l_extendedprice")
    rows = line.join(table(spark, sf_dir, "part").filter("p_size <= 40").select("p_partkey", "p_name", "p_brand"), "p_partkey", "left")
    id_ = F.col("p_partkey").cast("string")
    refs = F.collect_list(F.struct("l_linenumber", "p_partkey", "l_extendedprice", id_.alias("id")))
    cards = F.collect_list(F.when(F.col("p_name").isNotNull(), F.struct(id_.alias("id"), F.col("p_name").alias("front"), F.col("p_brand").alias("back"))))
    lessons = rows.groupBy("l_orderkey").agg(F.transform(F.sort_array(refs), lambda r: r["id"]).alias("card_ids"), cards.alias("cards"))
    ex = F.struct(F.lit("e").alias("id"), F.lit("matching").alias("type"), F.lit(True).alias("from_cards"), "card_ids")
    lesson = typed(F.struct("cards", F.array(F.struct(F.lit("exercise").alias("type"), ex.alias("exercise"))).alias("steps")), LESSON)
    made = validate.computed(lessons.filter(F.size("cards") > 0), lesson=lesson)
    done = validate.computed(made, lesson=canonical.resolve_from_cards(F.col("lesson")))
    pairs = F.element_at("lesson.steps", 1)["exercise"]["pairs"]
    return done.select("l_orderkey", F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", p["left"], p["right"])), ", ").alias("pairs"))


@query(
    "q23_context",
    """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus ELSE n_name END AS target_language, CASE WHEN o_orderkey % 7 = 0 THEN 'xx' ELSE coalesce(r_name, 'en') END AS source_language, coalesce(c_mktsegment, 'language') AS domain
FROM orders LEFT JOIN (SELECT c_custkey, c_mktsegment, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) ON o_custkey = c_custkey""",
)
def context(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    entries = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    entries = entries.select(F.col("c_custkey").alias("set"), F.col("n_name").alias("target_language"), F.col("r_name").alias("source_language"), F.coalesce("c_mktsegment", F.lit("language")).alias("domain"))
    key = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    own = F.struct(F.when(key % 5 == 0, F.col("o_orderstatus")).alias("target_language"), F.when(key % 7 == 0, "xx").alias("source_language"), none.alias("domain"))
    lessons = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("set"), own.alias("lesson"))
    return canonical.inject_context(lessons, entries).select("o_orderkey", "lesson.*")


@query(
    "q24_strict",
    """
SELECT event_id, 'E-UNKNOWN-FIELD' AS id, 'k' AS field, json_extract_string(props, '$.k') AS value FROM events WHERE list_contains(json_keys(props), 'k')""",
)
def strict(spark, sf_dir):
    """A lesson for each event, with the members of its properties among its own."""
    head = F.concat(F.lit('{"id":"event-'), F.col("event_id").cast("string"), F.lit('","title":"t","steps":[{"id":"s","type":"theory","body":"b"}]'))
    rest = F.regexp_replace("props", r"(?s)\A\s*\{(\s*\}\z)?", "")
    raw = F.concat(head, F.when(rest == "", "}").otherwise(F.concat(F.lit(","), rest)))
    judged = validate.exploded(validate.validate_lessons(table(spark, sf_dir, "events").select("event_id", "props", raw.alias("raw"))), "event_id", "props")
    field = F.regexp_extract("message", r"additional properties \((.*)\)", 1)
    return judged.filter("id = 'E-UNKNOWN-FIELD'").select("event_id", "id", field.alias("field"), F.get_json_object("props", "$.k").alias("value"))


@query(
    "q25_quiz",
    """
WITH g AS (SELECT l_orderkey, sum(l_quantity) AS total, sum(l_quantity * greatest(0, round(l_discount * 100) - 3) / 10) AS earned FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(total, 4) AS total, round(earned, 4) AS earned, total > 0 AND earned / total * 100 >= 20.03 AS passed FROM g""",
)
def quiz(spark, sf_dir):
    hits = F.round(F.col("l_discount") * 100)
    share = extensions.partial_credit(hits, F.lit(3.0), F.lit(10.0))
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("t"), F.sum(F.col("l_quantity") * share).alias("e"))
    return sums.select("l_orderkey", F.round("t", 4).alias("total"), F.round("e", 4).alias("earned"), ((F.col("t") > 0) & (F.col("e") / F.col("t") * 100 >= 20.03)).alias("passed"))


@query("q26_tally", "SELECT role, count(*) AS n FROM conversations GROUP BY 1")
def tally(spark, sf_dir):
    return conformance.tally(table(spark, sf_dir, "conversations"), "role")


@query("q26b_first", "SELECT conv_id, turn, role, place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations) WHERE place <= 4")
def first_turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return conformance.first_of_each(c, ["conv_id"], ["turn"]).withColumn("place", F.col("place").cast("long"))


@query(
    "q26c_summary",
    """
SELECT count(DISTINCT source) AS repos, count(DISTINCT (source, lang)) AS sets, count(*) AS lessons, 0::BIGINT AS parse_errors, count_if(n_chars < 100) AS invalid, 1::BIGINT AS empty_repos, false AS ok FROM documents""",
)
def corpus_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    judged = d.select(F.col("source").alias("repo"), F.col("lang").alias("set"), F.lit(True).alias("ok_json"), (F.col("n_chars") >= 100).alias("valid"))
    repos = judged.select("repo").distinct().unionByName(spark.createDataFrame([("repo without lessons",)], "repo string"))
    return conformance.summary(repos, judged)


@query(
    "q27_parity",
    """
WITH t AS (SELECT 'v' || (p_partkey % 20) || '.' || (p_partkey % 50) || '.' || p_partkey AS tag, p_partkey, p_size FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT 'release-' || p_partkey, p_partkey, p_size FROM part WHERE p_partkey % 3 = 0)
SELECT tag, 'page' AS missing FROM t WHERE tag LIKE 'v%' AND p_size > 40 UNION ALL SELECT tag, 'version' FROM t WHERE tag LIKE 'v%' AND p_size < 5 AND tag NOT IN ('v0.1.0', 'v0.3.0', 'v0.10.0')""",
)
def release_parity(spark, sf_dir):
    key = F.col("p_partkey")
    version = F.concat_ws(".", (key % 20).cast("string"), (key % 50).cast("string"), key.cast("string"))
    rows = table(spark, sf_dir, "part").select("p_size", version.alias("version"), F.when(key % 3 != 0, F.concat(F.lit("v"), version)).otherwise(F.concat(F.lit("release-"), key.cast("string"))).alias("tag"))
    return parity.release_gaps(rows.select("tag"), rows.filter("p_size <= 40").select("tag"), rows.filter("p_size >= 5").select("version"))


@query(
    "q28_migrate",
    """
WITH e AS (SELECT l_orderkey, list(p_name ORDER BY p_partkey, l_linenumber, l_extendedprice) FILTER (p_size > 25) AS accept, list(p_name ORDER BY p_partkey, l_linenumber, l_extendedprice) FILTER (p_size <= 30) AS wrong FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT l_orderkey, CASE WHEN accept IS NULL THEN 'skipped' ELSE 'converted' END AS status, CASE WHEN accept IS NULL THEN 'cloze' ELSE 'multiple_choice' END AS type,
  CASE WHEN accept IS NULL THEN '' ELSE array_to_string(list_concat(accept, [x FOR x IN coalesce(wrong, []) IF NOT list_contains(accept, x)]), '|') END AS options,
  CASE WHEN accept IS NULL THEN 0 ELSE len(accept) END::BIGINT AS correct
FROM e""",
)
def migrated(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"), "l_linenumber", "l_extendedprice")
    rows = line.join(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")
    one = lambda condition: F.transform(F.sort_array(F.collect_list(F.when(F.expr(condition), F.struct("p_partkey", "l_linenumber", "l_extendedprice", "p_name")))), lambda x: x["p_name"])
    grouped = rows.groupBy("l_orderkey").agg(one("p_size > 25").alias("accept"), one("p_size <= 30").alias("distractors"))
    raw = F.to_json(F.struct(F.lit("e").alias("id"), F.lit("cloze").alias("type"), F.lit("q").alias("prompt"), F.lit("multiselect").alias("cloze_mode"), F.lit("s").alias("sentence"), "accept", "distractors"))
    ex = grouped.select("l_orderkey", F.from_json(raw, EXERCISE).alias("ex"))
    done = ex.select("l_orderkey", migrate.audit(F.col("ex"))["status"].alias("status"), migrate.converted(F.col("ex")).alias("new"))
    options = F.coalesce("new.options", F.array().cast(migrate.OPTIONS))
    return done.select(
        "l_orderkey",
        "status",
        "new.type",
        F.array_join(F.transform(options, lambda o: o["text"]), "|").alias("options"),
        F.size(F.filter(options, lambda o: F.coalesce(o["correct"], F.lit(False)))).cast("long").alias("correct"),
    )


@query(
    "q29_vocab",
    f"""
WITH c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN 'Language' WHEN 2 THEN 'MATH' WHEN 3 THEN c_mktsegment END AS domain, ['a1 ', 'B2', c_name, ' None', 'C3'][c_custkey % 5 + 1] AS level FROM customer)
SELECT c_custkey, lower(coalesce(domain, '')) IN ('', {', '.join(f"'{d}'" for d in validate.DOMAINS)}) AS domain_known,
  upper(trim(level)) IN ({', '.join(f"'{x}'" for x in validate.LEVELS)}) OR (lower(coalesce(domain, 'language')) <> 'language' AND lower(trim(level)) = 'none') AS level_known
FROM c""",
)
def vocabulary(spark, sf_dir):
    k = F.col("c_custkey")
    domain = F.when(k % 4 == 1, "Language").when(k % 4 == 2, "MATH").when(k % 4 == 3, F.col("c_mktsegment"))
    level = F.element_at(F.array(F.lit("a1 "), F.lit("B2"), F.col("c_name"), F.lit(" None"), F.lit("C3")), (k % 5 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", validate.known_domain(domain).alias("domain_known"), validate.known_level(domain, level).alias("level_known"))


@query(
    "q30_hints",
    r"""SELECT doc_id, regexp_matches(text, '(?i)([0-9]+|zwei|drei|vier|f[üÜ]nf|sechs|sieben|acht|neun|zehn|two|three|four|five|six|seven|eight|nine|ten)') AND regexp_matches(text, '(?i)(buchstabe|zeichen|letter|character)') AS tells FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text || ' Zeichen' ELSE text END AS text FROM documents)""",
)
def hints(spark, sf_dir):
    text = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit(" Zeichen"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", tells_length(text).alias("tells"))


@query(
    "q31_prompts",
    """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN lang || chr(10) || chr(10) || source ELSE source END AS prompt FROM documents""",
)
def prompts(spark, sf_dir):
    n = F.col("doc_id") % 3
    none = F.lit(None).cast("string")
    ex = F.struct(F.when(n != 2, F.col("lang")).otherwise(none).alias("prompt"), F.when(n == 0, F.lit("___")).otherwise(F.col("source")).alias("sentence"))
    return table(spark, sf_dir, "documents").select("doc_id", migrate.merged_prompt(ex).alias("prompt"))


@query("q32_blank", r"SELECT doc_id, regexp_full_match(text, '\s*') AS is_blank, regexp_full_match(CASE WHEN doc_id % 3 = 0 THEN text ELSE chr(160) || chr(65279) || chr(9) END, '[\s\x{a0}\x{feff}]*') AS is_odd_blank FROM documents")
def blanks(spark, sf_dir):
    text = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise("\u00a0\ufeff\t")
    return table(spark, sf_dir, "documents").select("doc_id", blank(F.col("text")).alias("is_blank"), blank(text).alias("is_odd_blank"))


from coursewright.plans import catalog_lessons  # noqa: E402, F401  adds its queries
from coursewright.plans import catalog_content  # noqa: E402, F401
from coursewright.plans import catalog_jobs  # noqa: E402, F401
