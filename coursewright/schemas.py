"""Explicit schemas of lessons and manifests, and the flat tables that the operators exchange."""

from __future__ import annotations

EXAMPLE = "STRUCT<content STRING, language STRING, title STRING>"
CARD = (
    "STRUCT<id STRING, stable_id STRING, front STRING, back STRING, hint STRING, notes STRING, difficulty INT, media_type STRING, "
    "code_language STRING, code_snippet STRING, expected_output STRING, image STRING, audio STRING, tags ARRAY<STRING>, "
    "token_roles ARRAY<STRUCT<token STRING, role STRING>>>"
)
EXERCISE = (
    "STRUCT<id STRING, stable_id STRING, type STRING, prompt STRING, hint STRING, direction STRING, card_ids ARRAY<STRING>, "
    f"distractors ARRAY<STRING>, examples ARRAY<{EXAMPLE}>, from_cards BOOLEAN, pairs ARRAY<STRUCT<left STRING, right STRING>>, "
    "images ARRAY<STRUCT<src STRING, label STRING, is_correct STRING>>, accept ARRAY<STRING>, tiles ARRAY<STRING>, "
    "accept_orderings ARRAY<ARRAY<INT>>, cloze_mode STRING, sentence STRING, "
    "blanks ARRAY<STRUCT<accept ARRAY<STRING>, hint STRING, placeholder STRING>>, multiple BOOLEAN, "
    "options ARRAY<STRUCT<text STRING, correct BOOLEAN>>, ext_payload VARIANT>"
)
STEP = (
    "STRUCT<id STRING, type STRING, title STRING, body STRING, example_url STRING, example_label STRING, "
    f"examples ARRAY<{EXAMPLE}>, review_lesson_id STRING, theory_ref STRING, exercise {EXERCISE}>"
)
LESSON = (
    "STRUCT<id STRING, title STRING, description STRING, target_language STRING, source_language STRING, domain STRING, "
    "estimated_minutes INT, contributed_at STRING, contributed_by STRING, variation_of STRING, variation_note STRING, "
    "requires_extensions ARRAY<STRING>, resources ARRAY<STRUCT<type STRING, title STRING, url STRING, author STRING, "
    "description STRING, duration STRING, free BOOLEAN, language STRING, level STRING, partnership BOOLEAN, tags ARRAY<STRING>>>, "
    f"cards ARRAY<{CARD}>, steps ARRAY<{STEP}>>"
)
SET = (
    "STRUCT<id STRING, title STRING, title_native STRING, language STRING, target_language STRING, source_language STRING, "
    "domain STRING, domain_label STRING, level STRING, version STRING, lesson_count INT, path STRING, description STRING, "
    "tags ARRAY<STRING>, cover_image STRING, visibility STRING, review_status STRING, "
    "assets ARRAY<STRUCT<path STRING, size_kb INT>>, book STRUCT<title STRING, author STRING, url STRING, asin STRING>, "
    "attribution STRUCT<author STRING, derived_from ARRAY<STRUCT<author STRING>>>>"
)
MANIFEST = f"STRUCT<schema_version STRING, name STRING, description STRING, metadata VARIANT, sets ARRAY<{SET}>>"
ISSUE = "STRUCT<path STRING, message STRING, id STRING, severity STRING, doc_anchor STRING>"
ISSUES = f"ARRAY<{ISSUE}>"

#: Fixed values of the format: names that a rule tests.
CORE_TYPES = ["matching", "picture_choice", "free_text", "word_tiles", "cloze", "multiple_choice"]
STEP_TYPES = ["theory", "exercise"]
SLUG = r"[\p{Ll}\p{Nd}]+(-[\p{Ll}\p{Nd}]+)*"
STABLE_ID = r"[a-z0-9][a-z0-9_-]{7,63}"
EXT_TYPE = r"ext:[a-z0-9]+-[a-z0-9-]+"
