"""QTI 2.x documents: import in tasks, which parse XML to a row of parts per item that Columns map; export as a string expression."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coursewright.functions.textsem import is_true
from coursewright.plans.validate import validate_lessons

ENTITY = re.compile(r"<!ENTITY")
NAMESPACE = "http://www.imsglobal.org/xsd/imsqti_v2p1"
SUPPORTED = ["choiceInteraction", "textEntryInteraction", "matchInteraction"]

ITEM = (
    "path string, root_id string, root_title string, has_root boolean, ord int, item string, item_title string, body boolean, interactions array<string>, prompt string, "
    "paragraph string, cardinality string, correct array<string>, keys array<string>, choices array<struct<id string, text string>>"
)


def _name(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _kids(e: ET.Element | None, name: str) -> list[ET.Element]:
    return [] if e is None else [c for c in e if isinstance(c.tag, str) and _name(c) == name]


def _kid(e: ET.Element | None, name: str) -> ET.Element | None:
    return next(iter(_kids(e, name)), None)


def _text(e: ET.Element | None) -> str | None:
    return None if e is None else "".join(e.itertext()).strip()


def _items(path: str, xml: str) -> Iterator[tuple]:
    """A row of parts per item: no mapping, which is left to Columns."""
    try:
        if ENTITY.search(xml or ""):  # what it would expand to is not bounded
            raise ValueError("entities are not read")
        root = ET.fromstring((xml or "").encode())
    except (ET.ParseError, ValueError, RecursionError):
        yield path, None, None, False, *[None] * 11
        return
    found = [root] if _name(root) == "assessmentItem" else [e for e in root.iter() if isinstance(e.tag, str) and e is not root and _name(e) == "assessmentItem"]
    head = path, root.get("identifier"), root.get("title"), True
    if not found:
        yield *head, *[None] * 11
    for i, item in enumerate(found):
        body = _kid(item, "itemBody")
        inside = [] if body is None else [e for e in body.iter() if isinstance(e.tag, str) and e is not body and _name(e).endswith("Interaction")]
        one = inside[0] if inside else None
        response = None if one is None else next((d for d in _kids(item, "responseDeclaration") if d.get("identifier") == one.get("responseIdentifier", "RESPONSE")), None)
        choices = _kids(one, "simpleChoice") + [c for s in _kids(one, "simpleMatchSet") for c in _kids(s, "simpleAssociableChoice")]
        yield (
            *head,
            i,
            item.get("identifier") or "qti-item",
            item.get("title"),
            body is not None,
            [_name(e) for e in inside],
            _text(_kid(one, "prompt")),
            _text(_kid(body, "p")),
            None if response is None else response.get("cardinality"),
            [_text(v) for v in _kids(_kid(response, "correctResponse"), "value")],
            [e.get("mapKey") or "" for e in _kids(_kid(response, "mapping"), "mapEntry")],
            [{"id": c.get("identifier") or "", "text": _text(c)} for c in choices],
        )


def read_items(documents: DataFrame) -> DataFrame:
    """The parts of each item of QTI documents (path, xml)."""
    names = [part.strip().split(" ")[0] for part in ITEM.replace("array<struct<id string, text string>>", "x").split(",")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [row for p, x in zip(batch["path"], batch["xml"], strict=True) for row in _items(p, x)]
            yield pd.DataFrame(rows, columns=names).astype({"ord": "Int32"})

    return documents.select("path", "xml").mapInPandas(work, ITEM)


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))


def mapped(items: DataFrame) -> DataFrame:
    """Items with ``issue`` (why an item cannot be mapped) or ``exercise`` (as a JSON-ready struct)."""
    n = F.size("interactions")
    only = F.get("interactions", F.lit(0))
    why = lambda what, reason: F.struct(F.col("item").alias("item"), what.alias("interaction"), F.lit(reason).alias("reason"))
    issue = (
        F.when(~F.col("body"), why(F.lit("(none)"), "assessmentItem has no itemBody"))
        .when(n == 0, why(F.lit("(none)"), "no interaction element found"))
        .when(n > 1, why(F.array_join("interactions", "+"), "multiple interactions in one item are not supported"))
        .when(~only.isin(SUPPORTED), why(only, "unsupported QTI interaction"))
    )
    text_of = lambda i: F.coalesce(F.element_at(F.filter("choices", lambda c: c["id"] == i), -1)["text"], F.lit(""))
    side = lambda v, i: F.coalesce(F.get(F.split(v, r"\s+"), F.lit(i)), F.lit(""))
    options = F.transform("choices", lambda c: F.struct(c["text"].alias("text"), F.when(F.array_contains("correct", c["id"]), True).alias("correct")))
    pairs = F.transform("correct", lambda v: F.struct(text_of(side(v, 0)).alias("left"), text_of(side(v, 1)).alias("right")))
    choice, entry = only == "choiceInteraction", only == "textEntryInteraction"
    exercise = F.struct(
        F.col("item").alias("id"),
        F.when(choice, "multiple_choice").when(entry, "free_text").otherwise("matching").alias("type"),
        F.coalesce("prompt", "paragraph", "item_title", "item").alias("prompt"),
        F.when(choice, options).alias("options"),
        F.when(choice & is_true(F.coalesce("cardinality", F.lit("single")) == "multiple"), True).alias("multiple"),
        F.when(entry, F.concat("correct", "keys")).alias("accept"),
        F.when(~choice & ~entry, pairs).alias("pairs"),
    )
    return items.withColumn("issue", F.when(F.col("ord").isNotNull(), issue)).withColumn("exercise", F.when(F.col("ord").isNotNull() & issue.isNull(), exercise))


def import_qti(documents: DataFrame) -> DataFrame:
    """path, ok, raw (the lesson as JSON), error of each document; all of a document is mapped, or nothing."""
    rows = mapped(read_items(documents))
    step = F.struct(F.col("exercise.id").alias("id"), F.lit("exercise").alias("type"), F.col("exercise"))
    per = rows.groupBy("path", "has_root", "root_id", "root_title").agg(
        F.count("ord").alias("items"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("issue").isNotNull(), F.struct("ord", "issue")))), lambda x: x["issue"]).alias("issues"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("exercise").isNotNull(), F.struct("ord", step.alias("step")))), lambda a, b: a["ord"] - b["ord"]), lambda x: x["step"]).alias("steps"),
        F.min_by("item_title", "ord").alias("first_title"),
    )
    detail = F.array_join(F.transform("issues", lambda i: F.concat(i["item"], F.lit(": "), i["interaction"], F.lit(" ("), i["reason"], F.lit(")"))), "; ")
    raw = F.to_json(
        F.struct(
            F.coalesce("root_id", F.lit("qti-lesson")).alias("id"),
            F.coalesce("root_title", "first_title", F.lit("Imported QTI lesson")).alias("title"),
            F.array().cast("array<string>").alias("cards"),
            F.col("steps"),
        )
    )
    refused = (
        F.when(~F.col("has_root"), F.lit("QTI document has no root element"))
        .when(F.col("items") == 0, F.lit("QTI document contains no assessmentItem elements"))
        .when(F.size("issues") > 0, F.concat(F.lit("QTI import failed: "), F.size("issues").cast("string"), F.lit(" item(s) could not be mapped - "), detail))
    )
    judged = validate_lessons(per.select("path", "issues", refused.alias("refused"), F.when(refused.isNull(), raw).alias("raw")).drop("issues"))
    faults = F.array_join(F.transform("errors", lambda e: F.concat(F.lit("["), e["id"], F.lit("] "), e["path"], F.lit(" "), e["message"])), "; ")
    error = F.coalesce("refused", F.when(~F.col("valid"), F.concat(F.lit("QTI import produced an invalid lesson: "), faults)))
    return judged.select("path", error.isNull().alias("ok"), F.when(error.isNull(), F.col("raw")).alias("raw"), error.alias("error"))


def escaped(x: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(sign), F.lit(entity))
    return x


def quoted(x: Column) -> Column:
    return F.replace(escaped(x), F.lit('"'), F.lit("&quot;"))


def _lines(*parts) -> Column:
    """Texts and arrays of texts as lines; null parts have none."""
    return F.array_join(F.concat(*[F.array(F.lit(p)) if isinstance(p, str) else p for p in parts]), "\n")


def _put(template: str, *values: Column) -> Column:
    """The template with each {} replaced by a value."""
    pieces, out = template.split("{}"), []
    for i, piece in enumerate(pieces):
        out += [F.lit(piece)] + ([values[i]] if i < len(values) else [])
    return F.concat(*out)


def _item(ex: Column) -> Column:
    head = F.array(_put('  <assessmentItem identifier="{}" title="{}" adaptive="false" timeDependent="false">', quoted(ex["id"]), quoted(ex["id"])))
    tail = ["    </itemBody>", "  </assessmentItem>"]
    many, n = is_true(ex["multiple"]), lambda i: i.cast("string")
    declared = lambda card, base: F.array(_put(f'    <responseDeclaration identifier="RESPONSE" cardinality="{{}}" baseType="{base}">', card))
    end = ["      </correctResponse>", "    </responseDeclaration>", "    <itemBody>"]
    prompt = F.array(_put("        <prompt>{}</prompt>", escaped(ex["prompt"])))
    right = F.array_compact(F.transform(ex["options"], lambda o, i: F.when(is_true(o["correct"]), _put("        <value>OPT{}</value>", n(i)))))
    right = F.when(F.size(right) > 0, right).otherwise(F.array(F.lit("")))
    choice = _lines(
        head,
        declared(F.when(many, "multiple").otherwise("single"), "identifier"),
        "      <correctResponse>",
        right,
        *end,
        F.array(_put('      <choiceInteraction responseIdentifier="RESPONSE" shuffle="false" maxChoices="{}">', F.when(many, "0").otherwise("1"))),
        prompt,
        F.transform(ex["options"], lambda o, i: _put('        <simpleChoice identifier="OPT{}">{}</simpleChoice>', n(i), escaped(o["text"]))),
        "      </choiceInteraction>",
        *tail,
    )
    accept = F.coalesce(ex["accept"], F.array().cast("array<string>"))
    others = F.slice(accept, 2, 1 << 20)
    mapping = F.when(
        F.size(others) > 0,
        F.concat(F.array(F.lit('      <mapping defaultValue="0">')), F.transform(others, lambda a: _put('        <mapEntry mapKey="{}" mappedValue="1"/>', quoted(a))), F.array(F.lit("      </mapping>"))),
    ).otherwise(F.array().cast("array<string>"))
    entry = _lines(
        head,
        declared(F.lit("single"), "string"),
        "      <correctResponse>",
        F.array(_put("        <value>{}</value>", escaped(F.coalesce(F.get(accept, F.lit(0)), F.lit(""))))),
        "      </correctResponse>",
        mapping,
        "    </responseDeclaration>",
        "    <itemBody>",
        F.array(_put("      <p>{}</p>", escaped(ex["prompt"]))),
        '      <textEntryInteraction responseIdentifier="RESPONSE" expectedLength="20"/>',
        *tail,
    )
    pairs = F.coalesce(ex["pairs"], F.array())
    some = lambda xs: F.when(F.size(xs) > 0, xs).otherwise(F.array(F.lit("")))
    side = lambda letter, name: some(F.transform(pairs, lambda p, i: _put(f'        <simpleAssociableChoice identifier="{letter}{{}}" matchMax="1">{{}}</simpleAssociableChoice>', n(i), escaped(p[name]))))
    match = _lines(
        head,
        declared(F.lit("multiple"), "directedPair"),
        "      <correctResponse>",
        some(F.transform(pairs, lambda p, i: _put("        <value>L{} R{}</value>", n(i), n(i)))),
        *end,
        '      <matchInteraction responseIdentifier="RESPONSE" shuffle="false" maxAssociations="0">',
        prompt,
        "        <simpleMatchSet>",
        side("L", "left"),
        "        </simpleMatchSet>",
        "        <simpleMatchSet>",
        side("R", "right"),
        "        </simpleMatchSet>",
        "      </matchInteraction>",
        *tail,
    )
    return F.when(ex["type"] == "multiple_choice", choice).when(ex["type"] == "free_text", entry).otherwise(match)


def export_qti(lessons: DataFrame) -> DataFrame:
    """path, xml, unmappable (ids), error of lessons (path, lesson); theory steps are left out, other types refuse the lesson."""
    drills = F.transform(F.filter("lesson.steps", lambda s: is_true(s["type"] == "exercise") & s["exercise"].isNotNull()), lambda s: s["exercise"])
    bad = F.filter("drills", lambda e: ~is_true(e["type"].isin("multiple_choice", "free_text", "matching")))
    title = quoted(F.col("lesson.title"))
    xml = _lines(
        '<?xml version="1.0" encoding="UTF-8"?>',
        F.array(_put(f'<assessmentTest xmlns="{NAMESPACE}" identifier="{{}}" title="{{}}">', quoted(F.col("lesson.id")), title)),
        '  <testPart identifier="part1" navigationMode="linear" submissionMode="individual">',
        F.array(_put('    <assessmentSection identifier="section1" title="{}" visible="true">', title)),
        F.array(F.array_join(F.transform("drills", _item), "\n")),
        "    </assessmentSection>",
        "  </testPart>",
        "</assessmentTest>",
        "",
    )
    error = F.when(
        F.size("bad") > 0,
        F.concat(F.lit("QTI export cannot represent exercise type(s): "), F.array_join(F.transform("bad", lambda e: F.concat(e["id"], F.lit(" ("), e["type"], F.lit(")"))), "; ")),
    )
    rows = lessons.withColumn("drills", drills).withColumn("bad", bad).withColumn("error", error)
    return rows.select("path", F.when(F.col("error").isNull(), xml).alias("xml"), F.transform("bad", lambda e: e["id"]).alias("unmappable"), "error")
