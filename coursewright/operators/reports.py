"""Reports as text: the lines of each file as a Column, row by row, and the lines that close a batch.

``lines`` arrays are joined by a sink in order of path; nothing is gathered here but counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursewright.functions.textsem import is_true

DRY_RUN = "dry run - pass --write to apply"
DRY_WIRING = "dry run - review each suggestion, then re-run with --write --accept <suggestion-id>"


def said(template: str, *values: Column) -> Column:
    """The template with each {} replaced by a value."""
    parts = template.split("{}")
    return F.concat(*[x for i, p in enumerate(parts) for x in ([F.lit(p), values[i].cast("string")] if i < len(values) else [F.lit(p)])])


def told(issues: Column, anchor: bool) -> Column:
    form = "  [{}] {} {}  (see {})" if anchor else "  [{}] {} {}"
    return F.transform(issues, lambda i: said(form, i["id"], i["path"], i["message"], *([i["doc_anchor"]] if anchor else [])))


def not_json(path: Column, error: Column | str = "not JSON") -> Column:
    return F.array(said("ERROR {}: invalid JSON - {}", path, F.lit(error) if isinstance(error, str) else error))


def lint(judged: DataFrame) -> DataFrame:
    """path, lines; from judged (path, ok_json, errors, warnings)."""
    path = F.col("path")
    clean = (F.size("errors") == 0) & (F.size("warnings") == 0)
    head = F.when(F.size("errors") > 0, said("ERROR {}", path)).otherwise(said("WARN  {}", path))
    lines = F.when(clean, F.array(said("OK    {}", path))).otherwise(F.concat(F.array(head), told(F.concat("errors", "warnings"), True)))
    return judged.select("path", F.when(F.col("ok_json"), lines).otherwise(not_json(path)).alias("lines"))


def migration(migrated: DataFrame, write: bool = False) -> DataFrame:
    """path, lines; from migrated (path, ok_json, valid, errors, converted, changes)."""
    path = F.col("path")
    change = lambda c: F.concat(
        F.array(F.concat(said("  {} {}", F.when(c["status"] == "converted", "converted").otherwise("skipped  "), c["id"]), F.coalesce(F.concat(F.lit(" - "), c["reason"]), F.lit("")))),
        F.transform(F.coalesce(c["notes"], F.array().cast("array<string>")), lambda n: said("    note: {}", n)),
    )
    good = F.concat(F.array(said("OK    {}: {} {} exercise(s)", path, F.lit("wrote" if write else "would convert"), F.col("converted"))), F.flatten(F.transform("changes", change)))
    bad = F.concat(F.array(said("ERROR {}: migrated lesson fails validation (not written)", path)), told(F.col("errors"), False))
    return migrated.select("path", F.when(~F.col("ok_json"), not_json(path)).when(F.col("valid"), good).otherwise(bad).alias("lines"))


def minting(minted: DataFrame) -> DataFrame:
    """path, lines; from minted (path, ok, minted, eligible, error)."""
    head = F.when(F.col("minted") == 0, "ok   ").otherwise("MINT ")
    good = F.array(said("{}{}: {} of {} eligible stable_id(s)", head, F.col("path"), F.col("minted"), F.col("eligible")))
    return minted.select("path", F.when(F.col("ok"), good).otherwise(not_json(F.col("path"), F.col("error"))).alias("lines"))


def minting_total(minted: DataFrame) -> DataFrame:
    """One row: lines."""
    total = minted.agg(F.coalesce(F.sum(F.when(F.col("ok"), F.col("minted"))), F.lit(0)).alias("n"), F.count("*").alias("files"))
    return total.select(F.array(said("total: {} stable_id(s) across {} file(s)", F.col("n"), F.col("files"))).alias("lines"))


def wiring(suggestions: DataFrame) -> DataFrame:
    """path, lines of the dry run; from the rows of operators.wiring.suggest."""
    evidence = F.transform("evidence", lambda e: said("    {} '{}' appears in {}: \"{}\"", e["card_side"], e["matched_text"], e["field"], e["quote"]))
    found = F.concat(F.array(said("  suggest {}", F.col("suggestion_id"))), evidence)
    manual = F.array(F.concat(said("  manual  {} - {}", F.col("card_id"), F.col("reason")), F.coalesce(said(" (candidates: {})", F.array_join("candidates", ", ")), F.lit(""))))
    is_found = F.col("suggestion_id").isNotNull()
    rows = suggestions.select("path", F.struct(F.when(is_found, 0).otherwise(1).alias("part"), "ord", F.when(is_found, found).otherwise(manual).alias("lines")).alias("row"))
    per = rows.groupBy("path").agg(F.sort_array(F.collect_list("row")).alias("rows"), F.count_if(F.col("row.part") == 0).alias("n"), F.count_if(F.col("row.part") == 1).alias("m"))
    head = said("OK    {}: {} suggestion(s), {} card(s) for manual review", F.col("path"), F.col("n"), F.col("m"))
    return per.select("path", F.concat(F.array(head), F.flatten(F.transform("rows", lambda r: r["lines"]))).alias("lines"))


def stability(checked: DataFrame, violations: DataFrame) -> DataFrame:
    """ord, line: the counts, the verdict, then a line per violation in order of phase and place."""
    c = lambda name: F.col(name)
    counts = said(
        "checked: {} base id(s) / {} head id(s), {} base lesson(s) / {} head lesson(s), {} base retired / {} head retired",
        c("base_ids"), c("head_ids"), c("base_lessons"), c("head_lessons"), c("base_retired"), c("head_retired"),
    )
    n = violations.agg(F.count("*").alias("n"))
    verdict = F.when(F.col("n") == 0, F.lit("ok: every published stable_id still points at its element")).otherwise(said("FAIL: {} stability violation(s)", F.col("n")))
    none = F.lit(None).cast("string")
    first = checked.select(F.lit(-2).alias("phase"), none.alias("ord"), counts.alias("line"))
    second = n.select(F.lit(-1).alias("phase"), none.alias("ord"), verdict.alias("line"))
    rest = violations.select("phase", "ord", said("  {} {}: {}", F.col("rule"), F.col("set"), F.col("message")).alias("line"))
    return first.unionByName(second).unionByName(rest)


def coverage(covered: DataFrame, failures: DataFrame, baseline: int) -> DataFrame:
    """ord, line of a coverage table and its gate."""
    total = covered.agg(F.count_if("covered").alias("n"), F.count("*").alias("total"))
    head = total.select(F.lit(0).alias("ord"), said(f"stable-id coverage: {{}} of {{}} set(s) fully minted, baseline {baseline}", F.col("n"), F.col("total")).alias("line"))
    bad = failures.select(F.lit(2).alias("ord"), said("FAIL {}: {}", F.col("rule"), F.col("message")).alias("line"))
    good = failures.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(1).alias("ord"), F.lit("ok: every listed set is fully minted and the baseline matches").alias("line"))
    return head.unionByName(good).unionByName(bad)


def failed(rows: DataFrame, ok: str = "ok") -> DataFrame:
    """One row: exit_code, 1 if any file failed."""
    return rows.agg(F.when(F.coalesce(F.bool_and(is_true(F.col(ok))), F.lit(True)), 0).otherwise(1).alias("exit_code"))
