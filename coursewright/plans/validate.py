"""Validation of lessons and manifests: structure first, rules only where the structure holds.

Both return their input with ``issues`` (array), ``errors`` and ``warnings`` (the parts of it) and
``valid``. All is row-local; one read of the raw text serves all rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursewright.functions.textsem import file_stem, is_true, trimmed
from coursewright.operators.ordering import ordering_rules
from coursewright.plans import rules
from coursewright.plans.rules import issue, none, when
from coursewright.plans.structural import structural_and_unseen, structural_issues
from coursewright.schemas import ISSUES, LESSON

#: The vocabulary of domains and levels.
DOMAINS = ["language", "knowledge", "programming", "software", "psychology", "math", "ai", "technology", "philosophy", "dog-training", "traffic-knowledge"]
LEVELS = ["A1", "A2", "B1", "B2", "C1", "C2"]
NO_LEVEL = "none"


def known_domain(domain: Column) -> Column:
    """Absent and empty ones are known; case doesn't matter, blanks do."""
    return (F.coalesce(domain, F.lit("")) == "") | is_true(F.lower(domain).isin(DOMAINS))


def known_level(domain: Column, level: Column) -> Column:
    other = F.lower(F.when(F.coalesce(domain, F.lit("")) == "", "language").otherwise(domain)) != "language"
    return is_true(F.upper(trimmed(level)).isin(LEVELS)) | is_true(other & (F.lower(trimmed(level)) == NO_LEVEL))


def parsed(df: DataFrame, raw: str = "raw") -> DataFrame:
    """With ``ok_json``: whether the raw text is one JSON value. Duplicate keys are JSON."""
    return df.withColumn("ok_json", F.coalesce(F.json_array_length(F.concat(F.lit("["), F.col(raw), F.lit("]"))) == 1, F.lit(False)))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """The columns as a generator's output, which the optimizer does not copy into what is built on them: each is computed once a row."""
    once = F.explode_outer(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("once_")
    return df.select("*", once).select(*[F.col(c) for c in df.columns if c not in columns], *[F.col(f"once_.{name}").alias(name) for name in columns])


def _judged(df: DataFrame, issues: Column) -> DataFrame:
    errors = F.filter("issues", lambda i: i["severity"] == "error")
    return (
        computed(df, issues=issues)
        .withColumn("errors", errors)
        .withColumn("warnings", F.filter("issues", lambda i: i["severity"] == "warning"))
        .withColumn("valid", F.size("errors") == 0)
    )


def validate_lessons(df: DataFrame, registry: dict | None = None, permissive: bool = False) -> DataFrame:
    """Rows with ``raw`` JSON; adds ``lesson`` (typed) and the verdict. Raw text that isn't JSON gets null issues and valid = false.

    ``registry`` maps (type, major) to a function from an exercise to its issues; ``permissive``
    accepts every declared extension without a check of its payload.
    """
    read = computed(df, raw=F.col("raw"))  # which may be an expression
    read = computed(parsed(read), raw_json=F.when(F.col("ok_json"), F.col("raw"))).withColumn("faults", structural_and_unseen(F.col("raw_json")))
    read = computed(read, lesson=F.from_json("raw_json", LESSON)).withColumn("structure", F.col("faults.structure")).withColumn("unseen", F.col("faults.unseen")).withColumn("ok_json", F.col("structure").isNotNull())
    read = computed(read, declared_=rules.required_majors(F.col("lesson")))
    semantic = rules.lesson_rules(F.col("lesson"), F.col("unseen"), registry, permissive, F.col("declared_"))
    judged = _judged(read, F.when(F.col("ok_json"), F.when(F.size("structure") > 0, F.col("structure")).otherwise(semantic)))
    return judged.withColumn("valid", is_true(F.col("valid"))).drop("faults", "structure", "unseen", "raw_json", "declared_")


def _strings(v: str, path: str) -> Column:
    return F.expr(f"filter(transform(try_variant_get({v}, '{path}', 'array<variant>'), x -> CASE WHEN schema_of_variant(x) = 'STRING' THEN variant_get(x, '$', 'string') END), x -> x IS NOT NULL)")


def validate_manifests(df: DataFrame) -> DataFrame:
    """Rows with ``raw`` JSON of a manifest (see sources.manifests for YAML)."""
    read = computed(parsed(computed(df, raw=F.col("raw"))), raw_json=F.when(F.col("ok_json"), F.col("raw")))
    read = read.withColumn("structure", structural_issues(F.col("raw_json"), manifest=True)).withColumn("ok_json", F.col("structure").isNotNull())
    read = computed(read, v=F.expr("try_parse_json(raw_json)"))
    listed = "schema_of_variant(variant_get(v, '$.metadata.retired_ids')) LIKE 'ARRAY%'"
    retired = _strings("v", "$.metadata.retired_ids")
    size = F.expr("size(try_variant_get(v, '$.metadata.retired_ids', 'array<variant>'))")
    read = (
        read.withColumn("has_retired", F.expr("coalesce(array_contains(json_object_keys(get_json_object(raw_json, '$.metadata')), 'retired_ids'), false)"))
        .withColumn("retired", retired)
        .withColumn("retired_ok", F.expr(f"coalesce({listed}, false)") & is_true(F.size("retired") == size))
        .withColumn("lesson_ids", F.transform(_strings("v", "$.metadata.lessons"), file_stem))
        .withColumn("sets", F.from_json(F.get_json_object("raw_json", "$.sets"), "array<struct<domain string, level string>>"))
    )
    read = computed(read, **{name: F.col(name) for name in ("retired", "retired_ok", "lesson_ids", "sets", "structure")})
    wrong_type = issue(
        "E-RETIRED-IDS-TYPE",
        "/metadata/retired_ids",
        "'retired_ids' must be a list of strings (each entry the stable_id - author slug for pre-stable_id elements - of a retired exercise or card)",
        "stable-identity-stable_id",
    )
    # in the order in which an entry repeats for the first time
    repeat = F.array_distinct(F.filter(F.transform("retired", lambda x, i: F.when(is_true(F.array_contains(F.slice("retired", 1, i), x)), x)), lambda x: x.isNotNull()))
    dup = when(
        F.size(repeat) > 0,
        issue(
            "W-RETIRED-IDS-DUP",
            "/metadata/retired_ids",
            F.concat(F.lit("retired_ids lists "), F.array_join(F.transform(repeat, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit(" more than once; a retirement is declared once - the duplicate usually hides a mis-edited entry")),
            "stable-identity-stable_id",
        ),
    )
    ordering = F.transform(ordering_rules(F.col("lesson_ids")), lambda i: i.withField("path", F.lit("/metadata/lessons")))

    def vocabulary(s: Column, i: Column) -> Column:
        at = lambda name: F.concat(F.lit("/sets/"), i.cast("string"), F.lit(f"/{name}"))
        domain = F.concat(
            F.lit("domain '"), s["domain"], F.lit(f"' is outside the known vocabulary ({', '.join(DOMAINS)}); it stays valid ('other' contract), but consumers cannot group it with existing subjects - prefer a known domain or accept the fragmentation deliberately")
        )
        level = F.concat(F.lit("level '"), s["level"], F.lit("' is neither a CEFR band (A1..C2) nor, for a non-language set, the explicit 'none' sentinel; a level facet would offer it as a category"))
        return F.concat(
            when(~known_domain(s["domain"]), issue("W-DOMAIN-UNKNOWN", at("domain"), domain, "content-domains")),
            when(s["level"].isNotNull() & ~known_level(s["domain"], s["level"]), issue("W-LEVEL-UNKNOWN", at("level"), level, "content-domains")),
        )

    words = F.flatten(F.transform(F.coalesce("sets", F.array()), vocabulary))
    warnings = F.concat(F.coalesce(ordering.cast(ISSUES), none()), words, F.coalesce(dup, none()))
    semantic = F.when(F.col("has_retired") & ~F.col("retired_ok"), F.array(wrong_type).cast(ISSUES)).otherwise(warnings)
    judged = _judged(read, F.when(F.col("ok_json"), F.when(F.size("structure") > 0, F.col("structure")).otherwise(semantic)))
    return judged.withColumn("valid", is_true(F.col("valid"))).drop("structure", "v", "raw_json", "has_retired", "retired", "retired_ok", "lesson_ids", "sets")


def exploded(judged: DataFrame, *keys: str) -> DataFrame:
    """A row per issue with its ordinal."""
    return judged.select(*keys, F.posexplode("issues").alias("ord", "issue")).select(*keys, "ord", "issue.*")
