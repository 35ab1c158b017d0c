"""The operators as jobs: ``spark-submit coursewright/jobs.py lint FOLDER`` and the like.

A job reads a folder, prints its report and exits with 0 or 1; 2 means it could not run. With
--write, files that changed and are valid go to a new folder, --out, as Parquet of path and text, or
with --files as files at the same places below it; what was read is never written over.
"""

from __future__ import annotations

import argparse
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursewright.operators import identity, migrate, mint, quality, reports, wiring
from coursewright.plans.validate import parsed, validate_lessons
from coursewright.sources import lessons as source
from coursewright.sources.tree import write_tree


def arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="coursewright")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name in ("lint", "migrate", "mint", "suggest-wiring"):
        job = jobs.add_parser(name)
        job.add_argument("folder")
        job.add_argument("--json", action="store_true")
        if name != "lint":
            job.add_argument("--write", action="store_true")
            job.add_argument("--out")
            job.add_argument("--files", action="store_true", help="write files, not Parquet")
    jobs.choices["suggest-wiring"].add_argument("--accept", action="append", default=[])
    job = jobs.add_parser("check-stable-ids")
    job.add_argument("base")
    job.add_argument("head")
    job.add_argument("--allow-empty-base", action="store_true")
    job = jobs.add_parser("check-stable-id-coverage")
    job.add_argument("folder")
    job.add_argument("--manifest", default="manifest.yaml")
    job.add_argument("--baseline", type=int, default=0)
    job.add_argument("--baseline-file", help="a file that holds the number; no such file: --baseline")
    job = jobs.add_parser("quality")
    job.add_argument("folder")
    job.add_argument("--json", action="store_true")
    job.add_argument("--minimums", help="a JSON file with an object rules; without it the published minimums hold")
    args = parser.parse_args(argv)
    if getattr(args, "write", False) and not args.out:
        parser.error("--write needs --out, a new folder")
    if args.job == "suggest-wiring" and args.write != bool(args.accept):
        parser.error("--write and --accept go together: what is written is what was reviewed")
    return args


_held: list[DataFrame] = []


def held(df: DataFrame) -> DataFrame:
    """Persisted until the job ends."""
    _held.append(df.persist())
    return df


def show(lines: DataFrame, *order: str) -> None:
    """Prints report lines as they arrive, one partition at a time."""
    for row in lines.orderBy(*order).toLocalIterator():
        for line in row["lines"] if "lines" in row else [row["line"]]:
            print(line)


def show_json(rows: DataFrame, *columns: str) -> None:
    for row in rows.select("path", F.to_json(F.struct(*columns)).alias("json")).orderBy("path").toLocalIterator():
        print(row["json"])


def tree(spark: SparkSession, folder: str) -> DataFrame:
    return source.read_raw(spark, folder, "*").withColumn("name", source.relative(F.col("path"), folder))


def write_back(rows: DataFrame, args: argparse.Namespace, text: str = "raw") -> None:
    """The texts at the places where they were read, below --out."""
    if args.files:
        write_tree(rows.select(source.relative(F.col("path"), args.folder).alias("path"), F.col(text).alias("raw")), args.out)
    else:
        source.write_texts(rows, args.out, text)


def lint(spark: SparkSession, args: argparse.Namespace) -> int:
    judged = held(validate_lessons(source.read_raw(spark, args.folder)))
    show_json(judged, "path", "valid", "errors", "warnings") if args.json else show(reports.lint(judged), "path")
    return reports.failed(judged, "valid").first()[0]


def migration(spark: SparkSession, args: argparse.Namespace) -> int:
    done = held(migrate.migrated_and_valid(source.typed(source.read_raw(spark, args.folder))))
    show_json(done, "path", "valid", "converted", "changes", "errors") if args.json else show(reports.migration(done, args.write), "path")
    if args.write:
        write_back(done.filter("valid AND converted > 0"), args)
    elif not args.json and not done.filter("converted > 0").isEmpty():
        print(reports.DRY_RUN)
    return reports.failed(done, "valid").first()[0]


def minting(spark: SparkSession, args: argparse.Namespace) -> int:
    done = held(mint.mint(source.read_raw(spark, args.folder)))
    if args.json:
        show_json(done, "path", "ok", "minted", "eligible", "error")
    else:
        show(reports.minting(done), "path")
        show(reports.minting_total(done), "lines")
        if not args.write:
            print(reports.DRY_RUN)
    if args.write:
        write_back(done.filter("ok AND minted > 0"), args, "new_text")
    return reports.failed(done).first()[0]


def suggestions(spark: SparkSession, args: argparse.Namespace) -> int:
    judged = held(validate_lessons(source.read_raw(spark, args.folder)))
    good = judged.filter("valid").select("path", "raw", "lesson")
    found = held(wiring.suggest(good))
    code = reports.failed(judged, "valid").first()[0]
    show(reports.lint(judged.filter(~F.col("valid"))), "path")
    if not args.write:
        show_json(found, *found.columns) if args.json else show(reports.wiring(found), "path")
        if not args.json and not found.filter("suggestion_id IS NOT NULL").isEmpty():
            print(reports.DRY_WIRING)
        return code
    wanted = spark.createDataFrame([(a,) for a in args.accept], "suggestion_id string").distinct()
    wired = wiring.rewired(good, found, wanted)
    again = held(validate_lessons(wired))
    write_back(again.filter("valid"), args)
    lost = [r[0] for r in wiring.unmatched(wanted, found).collect()]  # no more than were given
    for name in lost:
        print(f"ERROR --accept {name} matches no suggestion in any given file - nothing applied for it")
    return max(code, reports.failed(again, "valid").first()[0], int(bool(lost)))


def stable_ids(spark: SparkSession, args: argparse.Namespace) -> int:
    base, head = (tuple(held(df) for df in source.inventory_of(tree(spark, folder))) for folder in (args.base, args.head))
    counts, found = held(identity.checked(base, head)), held(identity.violations(base, head))
    show(reports.stability(counts, found), "phase", "ord")
    row = counts.first()
    if row["head_empty"]:
        print("FAIL: the base carries lessons but the head yields none")
        return 1
    if not row["credible"] and not args.allow_empty_base:
        print("FAIL: the comparison base carries no lessons while the head does (--allow-empty-base for a first publication)")
        return 1
    return int(not found.isEmpty())


def coverage(spark: SparkSession, args: argparse.Namespace) -> int:
    sets, elements = source.listed_elements(tree(spark, args.folder), args.manifest)
    baseline = args.baseline
    if args.baseline_file:
        name = args.baseline_file.rsplit("/", 1)
        lines = source.read_raw(spark, name[0] if len(name) > 1 else ".", name[-1]).select("raw").limit(1).collect()
        said = lines[0]["raw"].strip() if lines else str(baseline)
        if not re.match(r"[+-]?[0-9]+", said):
            print(f"the baseline in {args.baseline_file} is not a number")
            return 2
        baseline = int(re.match(r"[+-]?[0-9]+", said)[0])
    covered = held(identity.coverage(sets, elements))
    failures = held(identity.gate(covered, baseline))
    show(reports.coverage(covered, failures, baseline), "ord", "line")
    return int(not failures.isEmpty())


def minimums(spark: SparkSession, args: argparse.Namespace) -> int:
    """Shortfalls as they are found; the gate reads what was counted meanwhile."""
    least = quality.read_minimums(spark, args.minimums) if args.minimums else quality.MINIMUMS
    read = parsed(source.typed(source.read_raw(spark, args.folder)))
    lessons = read.withColumn("lesson", F.when(F.col("ok_json"), F.col("lesson")))
    judged, seen = quality.observed(quality.judged(lessons, least), least)
    rows = held(judged.select("path", "shortfalls"))
    rows.write.format("noop").mode("overwrite").save()
    some = rows.filter("shortfalls IS NULL OR size(shortfalls) > 0")
    if args.json:
        show_json(some, "path", "shortfalls")
    else:
        told = F.transform("shortfalls", lambda s: F.concat(F.lit("  "), s["rule"], F.lit(" at "), s["path"], F.lit(": "), s["found"].cast("string"), F.lit(" of "), s["minimum"].cast("string")))
        show(some.select("path", F.concat(F.array(F.concat(F.lit("SHORT "), "path")), F.coalesce(told, F.array(F.lit("  cannot be read")))).alias("lines")), "path")
    ok, lines = quality.gate(seen.get)
    if not args.json:
        print("\n".join(lines))
    return int(not ok)


JOBS = {"quality": minimums, "lint": lint, "migrate": migration, "mint": minting, "suggest-wiring": suggestions, "check-stable-ids": stable_ids, "check-stable-id-coverage": coverage}


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    args = arguments(argv)
    try:
        return JOBS[args.job](spark or SparkSession.builder.appName(f"coursewright-{args.job}").getOrCreate(), args)
    finally:
        while _held:
            _held.pop().unpersist()


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
