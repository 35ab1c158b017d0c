"""Gates, trees of files, short cards and one large set, over whole tables, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursewright.operators import canonical, conformance, identity, ordering, quality, wiring
from coursewright.plans import catalog
from coursewright.plans.catalog import query, table
from coursewright.plans.validate import exploded, validate_lessons
from coursewright.schemas import SLUG
from coursewright.scratch import folder, shared_dir
from coursewright.sources.snapshots import open_snapshot, write_snapshot
from coursewright.sources.tree import read_tree, write_tree
from coursewright.streaming import landing

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"]


def line_step(at: Column) -> Column:
    """A line of an order and its part as a step: returned lines are theory, the others one of three exercises whose texts are the part's words."""
    words = lambda x: F.split(x, " ")
    kind = F.element_at(F.array(F.lit("matching"), F.lit("free_text"), F.lit("cloze")), (at["l_linenumber"] % 3 + 1).cast("int"))
    said = F.concat(words(at["p_name"]), F.filter(words(at["p_type"]), lambda w: F.length(w) > 7))
    return F.struct(
        F.when(at["l_returnflag"] == "R", "theory").otherwise("exercise").alias("type"),
        F.struct(
            kind.alias("type"),
            F.filter(words(at["p_name"]), lambda w: F.length(w) > 4).alias("accept"),
            F.transform(said, lambda w: F.struct(w.alias("left"), w.alias("right"))).alias("pairs"),
            (at["l_linestatus"] == "F").alias("from_cards"),
            F.transform(F.filter(F.sequence(F.lit(0), F.lit(6)), lambda i: i < at["p_size"] % 7), lambda i: i.cast("string")).alias("card_ids"),
        ).alias("exercise"),
    )


def order_lessons(spark, sf_dir) -> DataFrame:
    """id, lesson: the lines of each order with their parts."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    lines = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    at = F.struct(*LINE_ORDER, "l_returnflag", "l_linestatus", "p_name", "p_type", "p_size")
    return lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(at)).alias("at")).select("id", F.struct(F.transform("at", line_step).alias("steps")).alias("lesson"))


QUALITY = f"""
WITH s AS (
  SELECT l_orderkey AS id, '/steps/' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) - 1) || '/exercise' AS path,
    l_returnflag = 'R' AS theory, l_linenumber % 3 AS kind,
    coalesce(len(list_filter(string_split(p_name, ' '), lambda w: length(w) > 4)), 0) AS accepts,
    CASE WHEN l_linestatus = 'F' THEN coalesce(p_size % 7, 0) ELSE coalesce(len(string_split(p_name, ' ')) + len(list_filter(string_split(p_type, ' '), lambda w: length(w) > 7)), 0) END AS pairs
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey),
w AS (
  SELECT id, count(*) FILTER (NOT theory) AS drills, count(DISTINCT kind) FILTER (NOT theory) AS kinds, count(*) FILTER (theory) AS theory FROM s GROUP BY id),
f AS (
  SELECT id, 'minExerciseTypes' AS rule, '/steps' AS path, kinds AS found, 2 AS minimum FROM w
  UNION ALL SELECT id, 'minExercisesPerLesson', '/steps', drills, 5 FROM w
  UNION ALL SELECT id, 'minTheorySteps', '/steps', theory, 1 FROM w
  UNION ALL SELECT id, 'minFreeTextAccepts', path, accepts, 2 FROM s WHERE NOT theory AND kind = 1
  UNION ALL SELECT id, 'minMatchingPairs', path, pairs, 3 FROM s WHERE NOT theory AND kind = 0)"""


@query("q53_quality", f"{QUALITY} SELECT id, rule, path, found::BIGINT AS found, minimum::BIGINT AS minimum FROM f WHERE found < minimum")
def shortfalls(spark, sf_dir):
    judged = quality.judged(order_lessons(spark, sf_dir))
    return judged.select("id", F.explode("shortfalls").alias("s")).select("id", "s.*")


@query(
    "q53b_quality_gate",
    f"""{QUALITY}, b AS (SELECT DISTINCT id, rule FROM f WHERE found < minimum)
SELECT 'lessons' AS metric, count(*) AS n FROM w
UNION ALL SELECT 'good', count(*) FROM w WHERE id NOT IN (SELECT id FROM b)
UNION ALL SELECT 'unread', 0
UNION ALL SELECT r.rule, count(b.id) FROM (SELECT DISTINCT rule FROM f) r LEFT JOIN b USING (rule) GROUP BY 1""",
)
def quality_gate(spark, sf_dir):
    """The metrics that the gate reads, observed while the shortfalls are written."""
    judged, seen = quality.observed(quality.judged(order_lessons(spark, sf_dir)))
    judged.select("id", "shortfalls").write.format("noop").mode("overwrite").save()
    return spark.createDataFrame(sorted(seen.get.items()), "metric string, n long")  # a row per metric


def part_tree(spark, sf_dir) -> str:
    """The root of a new tree with a lesson for each part; it goes when the driver ends."""
    p = table(spark, sf_dir, "part")
    lesson = F.struct(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("id"), F.concat_ws(" \"é\" ", "p_name", "p_brand").alias("title"), F.array().cast("array<string>").alias("steps"))
    path = F.concat_ws("/", F.lit("parts"), F.lower("p_type"), F.translate("p_brand", "#", "-"), F.lit("lessons"), F.concat(F.col("p_partkey").cast("string"), F.lit(".json")))
    root = f"{shared_dir(spark).rstrip('/')}/tree-{uuid.uuid4().hex}"
    write_tree(p.select(path.alias("path"), F.concat(F.to_json(lesson), F.lit("\n")).alias("raw")), root)
    folder(spark, root, lambda fs, at: fs.deleteOnExit(at))
    return root


PART_FILES = """
WITH f AS (
  SELECT 'parts/' || lower(p_type) || '/' || translate(p_brand, '#', '-') AS "set", p_partkey || '.json' AS file,
    p_name || ' "é" ' || p_brand AS title, '{"id":"part-' || p_partkey || '","title":"' || p_name || ' \\"é\\" ' || p_brand || '","steps":[]}' || chr(10) AS raw FROM part)
SELECT "set", file, "set" || '/lessons/' || file AS path, title, md5(raw) AS digest, CAST(NULL AS VARCHAR) AS error FROM f"""


def read_back(files: DataFrame) -> DataFrame:
    return files.select("set", "file", "path", F.get_json_object("raw", "$.title").alias("title"), F.md5("raw").alias("digest"), "error")


@query("q54_tree", PART_FILES)
def tree_round_trip(spark, sf_dir):
    """Written as files, and read back from the folders."""
    return read_back(read_tree(spark, part_tree(spark, sf_dir)))


@query("q54b_sets", f"SELECT * FROM ({PART_FILES}) WHERE \"set\" IN ('parts/economy/Brand-2', 'parts/economy/Brand-17', 'parts/none/none')")
def sets_of_a_tree(spark, sf_dir):
    """Two sets of the tree (and one that isn't there): only their folders are opened."""
    every = read_tree(spark, part_tree(spark, sf_dir))
    return read_back(every.filter(F.col("set").isin("parts/economy/Brand-2", "parts/economy/Brand-17", "parts/none/none")))


@query(
    "q55_short_cards",
    """
WITH w AS (SELECT item_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM benchmark),
c AS (SELECT DISTINCT w AS card_id FROM w WHERE w <> '' UNION SELECT DISTINCT a.w || ' ' || b.w FROM w a JOIN w b ON a.item_id = b.item_id AND b.i = a.i + 1)
SELECT card_id, CASE WHEN count(d.doc_id) = 0 THEN 'none' WHEN count(d.doc_id) = 1 THEN 'suggest' ELSE 'ambiguous' END AS verdict,
  count(d.doc_id) AS exercises, CASE WHEN count(d.doc_id) = 1 THEN min(d.doc_id) END AS exercise_id
FROM c LEFT JOIN documents d ON contains(d.text, c.card_id) GROUP BY card_id""",
)
def short_cards(spark, sf_dir):
    """Cards of one and of two words: every word, and every two words in a row, of the benchmark."""
    words = F.split("text", " ")
    one = F.filter(words, lambda w: w != "")
    two = F.filter(F.transform(words, lambda w, i: F.when(F.get(words, i + 1).isNotNull(), F.concat_ws(" ", w, F.get(words, i + 1)))), lambda w: w.isNotNull())
    cards = table(spark, sf_dir, "benchmark").select(F.explode(F.concat(one, two)).alias("text")).distinct().select(F.col("text").alias("card_id"), "text")
    quotes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("exercise_id"), F.col("text").alias("quote"))
    return wiring.verdicts(cards, wiring.keyed_containment(cards, quotes), [])


@query(
    "q56_one_set",
    """
WITH ids AS (SELECT p_name || '-' || p_size || '-' || p_partkey AS id, p_name, p_size, p_partkey FROM part),
k AS (SELECT id, row_number() OVER (ORDER BY id) AS a, row_number() OVER (ORDER BY p_name, p_size, p_partkey) AS b FROM ids),
d AS (SELECT x.a AS rank, x.id AS shown, y.id AS meant FROM k x JOIN k y ON x.a = y.b WHERE x.id <> y.id)
SELECT 'all' AS "set", min(rank) AS rank, arg_min(shown, rank) AS shown, arg_min(meant, rank) AS meant FROM d HAVING count(*) > 0""",
)
def one_set(spark, sf_dir):
    """One set of all parts: its order is found without a window over the set."""
    ids = table(spark, sf_dir, "part").select(F.lit("all").alias("set"), F.concat_ws("-", "p_name", F.col("p_size").cast("string"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_partkey").alias("position"))
    return ordering.divergence(ids)


@query(
    "q57_totals",
    """
WITH d AS (SELECT source AS repo, lang AS "set", text LIKE '%.%' AS ok_json, n_chars >= 100 AS valid, true AS has FROM documents
  UNION ALL SELECT DISTINCT source || ' (archive)', NULL, true, true, false FROM documents WHERE source < 'src2'),
g AS (
  SELECT GROUPING(repo) AS gr, GROUPING("set", has) AS gs, repo, "set", has, count(DISTINCT repo) FILTER (has) AS repos, count(DISTINCT (repo, "set")) FILTER (has) AS sets, count(*) FILTER (has) AS lessons,
    count(*) FILTER (has AND NOT ok_json) AS parse_errors, count(*) FILTER (has AND ok_json AND NOT valid) AS invalid, count(DISTINCT repo) AS listed
  FROM d GROUP BY GROUPING SETS ((), (repo), (repo, "set", has)))
SELECT CASE WHEN gr = 1 THEN 'corpus' WHEN gs > 0 THEN 'repo' ELSE 'set' END AS level, repo, "set", repos, sets, lessons, parse_errors, invalid, listed - repos AS empty_repos,
  lessons > 0 AND parse_errors = 0 AND invalid = 0 AND listed = repos AS ok
FROM g WHERE gs > 0 OR has""",
)
def corpus_totals(spark, sf_dir):
    """Sources as repositories, languages as sets; texts without a full stop count as unread, short ones as invalid. Some sources have an archive without lessons."""
    d = table(spark, sf_dir, "documents")
    judged = d.select(F.col("source").alias("repo"), F.col("lang").alias("set"), F.col("text").contains(".").alias("ok_json"), (F.col("n_chars") >= 100).alias("valid"))
    archives = d.filter("source < 'src2'").select(F.concat("source", F.lit(" (archive)")).alias("repo"))
    return conformance.totals(judged.select("repo").unionByName(archives), judged)


def stored_snapshots(spark, sf_dir):
    """The two snapshots of q08b, stored in buckets and opened again."""
    base, head = catalog.snapshots(spark, sf_dir)
    root, opened = shared_dir(spark), []
    for snapshot in (base, head):
        name = f"snapshot_{uuid.uuid4().hex}"
        write_snapshot(snapshot, name, root, buckets=8)
        for part in ("elements", "lessons", "retired"):
            folder(spark, f"{root.rstrip('/')}/{name}_{part}", lambda fs, at: fs.deleteOnExit(at))
        opened.append(open_snapshot(spark, name))
    return opened


@query("q08d_stored", catalog.ORACLES["q08b_violations"])
def stored_violations(spark, sf_dir):
    return identity.violations(*stored_snapshots(spark, sf_dir)).select("rule", "set", "message")


def customer_lessons(spark, sf_dir) -> DataFrame:
    """name, raw: a lesson for each order, whose card and exercise have the ids of the customer and of the customer's clerk of the day."""
    o = table(spark, sf_dir, "orders")
    stable = lambda kind, x: F.concat(F.lit(f"{kind}-"), F.lpad(x.cast("string"), 8, "0"))
    card = F.struct(F.lit("c").alias("id"), F.lit("f").alias("front"), F.lit("b").alias("back"), stable("customer", F.col("o_custkey")).alias("stable_id"))
    ex = F.struct(F.lit("x").alias("id"), F.lit("free_text").alias("type"), F.lit("p").alias("prompt"), stable("clerk", F.col("o_custkey") * 7 + F.dayofmonth("o_orderdate")).alias("stable_id"))
    lesson = F.struct(F.lit("l").alias("id"), F.lit("T").alias("title"), F.array(card).alias("cards"), F.array(F.struct(F.lit("s").alias("id"), F.lit("exercise").alias("type"), ex.alias("exercise"))).alias("steps"))
    name = F.concat(F.lit("orders/status/"), "o_orderstatus", F.lit("/lessons/"), F.col("o_orderkey").cast("string"), F.lit(".json"))
    return o.select(name.alias("name"), F.to_json(lesson).alias("raw"))


@query(
    "q59_landed",
    """
WITH e AS (
  SELECT 'orders/status/' || o_orderstatus AS "set", o_orderkey || '.json' AS lesson, 'card' AS kind, 'customer-' || lpad(o_custkey::VARCHAR, 8, '0') AS stable_id FROM orders
  UNION ALL SELECT 'orders/status/' || o_orderstatus, o_orderkey || '.json', 'exercise', 'clerk-' || lpad((o_custkey * 7 + day(o_orderdate))::VARCHAR, 8, '0') FROM orders)
SELECT "set", stable_id, count(*) AS n, min(lesson) AS lesson, min(kind) AS kind FROM e GROUP BY 1, 2 HAVING count(*) > 1""",
)
def landed_ids(spark, sf_dir):
    """The lessons land in three batches; the state carries an id from one to the next."""
    root = f"{shared_dir(spark).rstrip('/')}/landed-{uuid.uuid4().hex}"
    tasks = spark.sparkContext.defaultParallelism  # of each batch
    customer_lessons(spark, sf_dir).repartition(3 * tasks).write.parquet(f"{root}/lessons")
    folder(spark, root, lambda fs, at: fs.deleteOnExit(at))
    stream = spark.readStream.schema("name string, raw string").option("maxFilesPerTrigger", tasks).parquet(f"{root}/lessons")
    landing.watch_ids(stream, f"{root}/changes", f"{root}/state").awaitTermination()
    return landing.repeated_so_far(spark, f"{root}/changes").select("set", "stable_id", "n", "first.lesson", "first.kind")


def odd_lessons(spark, sf_dir) -> DataFrame:
    """k, raw: a lesson for each part with the part's texts and numbers, of which some break each kind of structural rule."""
    k, when = F.col("p_partkey"), F.when
    ex = F.struct(
        F.lit("e1").alias("id"),
        F.lit("picture_choice").alias("type"),
        when(k % 3 != 0, F.col("p_name")).alias("prompt"),
        when(k % 17 == 0, F.array_repeat(F.col("p_brand"), 51)).alias("card_ids"),
        F.array(F.struct(F.col("p_name").alias("label"), when(k % 19 == 0, F.repeat("p_name", F.lit(60))).otherwise(F.col("p_name")).alias("src"))).alias("images"),
    )
    step = F.struct(F.lit("s1").alias("id"), when(k % 5 == 0, F.lower("p_type")).otherwise("exercise").alias("type"), ex.alias("exercise"))
    tag = when(k % 4 == 0, F.col("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit("-")))
    card = F.struct(F.lit("c1").alias("id"), F.col("p_name").alias("front"), F.col("p_brand").alias("back"), (F.col("p_size") % 7).alias("difficulty"), F.array(tag).alias("tags"))
    lesson = F.struct(
        when(k % 11 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("part-"), k.cast("string"))).alias("id"),
        when(k % 7 == 0, "@size@").otherwise(F.col("p_name")).alias("title"),
        ((F.col("p_size") - 10) * 7).alias("estimated_minutes"),
        when(k % 23 == 0, F.col("p_type")).alias("extra"),
        F.array(card).alias("cards"),
        when(k % 13 == 0, F.array().cast("array<string>")).alias("none"),
        when(k % 13 != 0, F.array(step)).alias("steps"),
    )
    text = F.replace(F.replace(F.to_json(lesson), F.lit('"@size@"'), F.col("p_size").cast("string")), F.lit('"none":'), F.lit('"steps":'))
    return table(spark, sf_dir, "part").select(k.alias("k"), text.alias("raw"))


#: The pattern of ids, as its message has it.
SLUG_LIKE = f'must match pattern "^{SLUG}$"'
SCHEMA_KINDS = [
    ("", "/id", SLUG_LIKE, "k % 11 = 0"),
    ("", "/title", "must be string", "k % 7 = 0"),
    ("", "/estimated_minutes", "must be >= 1", "p_size <= 10"),
    ("", "/estimated_minutes", "must be <= 240", "(p_size - 10) * 7 > 240"),
    ("", "/", "must NOT have additional properties (extra)", "k % 23 = 0"),
    ("", "/cards/0/difficulty", "must be >= 1", "p_size % 7 = 0"),
    ("", "/cards/0/difficulty", "must be <= 5", "p_size % 7 = 6"),
    ("", "/cards/0/tags/0", SLUG_LIKE, "k % 4 = 0 AND contains(p_name, ' ')"),
    ("", "/steps", "must NOT have fewer than 1 items", "k % 13 = 0"),
    ("step", "/steps/0/type", "must be equal to one of the allowed values", "k % 5 = 0"),
    ("step", "/steps/0/exercise", "must have required property 'prompt'", "k % 3 = 0"),
    ("step", "/steps/0/exercise/card_ids", "must NOT have more than 50 items", "k % 17 = 0"),
    ("step", "/steps/0/exercise/images/0/src", "must NOT have more than 500 characters", "k % 19 = 0 AND length(p_name) * 60 > 500"),
]


@query(
    "q58_schema_kinds",
    "WITH p AS (SELECT p_partkey AS k, p_name, p_size FROM part) "
    + " UNION ALL ".join(
        f"SELECT k, '{'E-UNKNOWN-FIELD' if 'additional' in said else 'E-SCHEMA'}' AS id, '{path}' AS path, '{said.replace(chr(39), chr(39) * 2)}' AS message FROM p WHERE {condition}{' AND k % 13 <> 0' if of else ''}"
        for of, path, said, condition in SCHEMA_KINDS
    ),
)
def schema_kinds(spark, sf_dir):
    """Lessons that break the structure have these issues and no others: their rules and lints wait."""
    issues = exploded(validate_lessons(odd_lessons(spark, sf_dir)), "k", "valid")
    return issues.filter("id IN ('E-SCHEMA', 'E-UNKNOWN-FIELD')").select("k", "id", "path", "message")


@query(
    "q10b_gate_branches",
    f"""{catalog.COVERED}, t AS (SELECT count(*) AS total, count_if(covered) AS n, string_agg("set"::VARCHAR, ', ' ORDER BY "set"::VARCHAR) FILTER (NOT covered) AS names FROM c),
u AS (SELECT count(*) AS total FROM c WHERE covered)
SELECT 'all' AS run, 'UNDECLARED_RAISE' AS rule, 'coverage ' || n || ' above baseline 0; raise it deliberately' AS message FROM t WHERE n > 0
UNION ALL SELECT 'all', 'INCOMPLETE', (total - n) || ' listed set(s) carry no complete stable_id coverage: ' || names FROM t WHERE total > n
UNION ALL SELECT 'covered', 'UNDECLARED_RAISE', 'coverage ' || total || ' above baseline 0; raise it deliberately' FROM u WHERE total > 0
UNION ALL SELECT 'none', 'NO_SETS', 'the root manifest lists no sets; a run over nothing is never fully covered'""",
)
def gate_branches(spark, sf_dir):
    """All sets, those that are covered, and none, against a baseline of 0."""
    sets = catalog.covered(spark, sf_dir)
    runs = {"all": sets, "covered": sets.filter("covered"), "none": sets.filter("set IS NULL AND set IS NOT NULL")}
    found = [identity.gate(rows, 0).select(F.lit(run).alias("run"), "rule", "message") for run, rows in runs.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(
    "q61_parse",
    """
WITH s AS (SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey)
SELECT s_suppkey, 'T ' || s_name AS title, CASE WHEN s_suppkey % 3 = 0 THEN 'own' ELSE lower(r_name) END AS target_language, 'en' AS source_language, lower(n_name) AS domain,
  CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE s_name || '=' || n_name || ' | ' || 'second=last' END AS pairs, s_suppkey % 4 = 0 AS from_cards
FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def parsed_lessons(spark, sf_dir):
    """The whole of parse_lessons over suppliers' JSON: the set's context, pairs from cards in order (the last of a repeated id, unknown ids left out), a resolver of titles."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    rows = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    card = lambda i, front, back: F.struct(F.lit(i).alias("id"), front.alias("front"), back.alias("back"))
    cards = F.array(card("a", F.lit("second"), F.lit("first")), card("b", F.col("s_name"), F.col("n_name")), card("a", F.lit("second"), F.lit("last")))
    kind = F.when(F.col("s_suppkey") % 4 == 0, "free_text").otherwise("matching")
    ex = F.struct(F.lit("e").alias("id"), kind.alias("type"), F.lit("p").alias("prompt"), F.lit(True).alias("from_cards"), F.array(F.lit("b"), F.lit("nothing"), F.lit("a")).alias("card_ids"))
    lesson = F.struct(
        F.concat(F.lit("s-"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("title"), F.when(F.col("s_suppkey") % 3 == 0, "own").alias("target_language"),
        cards.alias("cards"), F.array(F.struct(F.lit("s1").alias("id"), F.lit("exercise").alias("type"), ex.alias("exercise"))).alias("steps"),
    )
    raw = rows.select("s_suppkey", F.col("n_name").alias("set"), F.to_json(lesson).alias("raw"))
    entries = nation.select(F.col("n_name").alias("set"), F.lower("r_name").alias("target_language"), F.lit("en").alias("source_language"), F.lower("n_name").alias("domain"))
    titled = lambda at: at.withField("title", F.concat(F.lit("T "), at["title"]))
    done = canonical.parse_lessons(raw, entries, resolvers=[titled])
    first = F.col("lesson.steps")[0]["exercise"]
    pairs = F.array_join(F.transform(F.coalesce(first["pairs"], F.array()), lambda p: F.concat_ws("=", p["left"], p["right"])), " | ")
    return done.select("s_suppkey", "lesson.title", "lesson.target_language", "lesson.source_language", "lesson.domain", pairs.alias("pairs"), F.coalesce(first["from_cards"], F.lit(False)).alias("from_cards"))
