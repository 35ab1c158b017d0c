"""Rewrites of raw lessons: members of exercises set or dropped, and all else as it was written."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edit(step: Column, put: Column, drop: list[str] | None = None) -> Column:
    """One edit of the exercise of a step: a struct of members to put, and names of members to drop first."""
    return F.struct(step.alias("step"), put.alias("put"), F.array(*[F.lit(d) for d in drop or []]).cast("array<string>").alias("drop"))


def _patched(raw: str, edits: str) -> str:
    value = json.loads(raw)
    for one in json.loads(edits):
        exercise = value["steps"][one["step"]]["exercise"]
        for name in one.get("drop", []):
            exercise.pop(name, None)
        exercise.update(one["put"])
    return json.dumps(value, ensure_ascii=False, indent=2) + "\n"


def rewritten(rows: DataFrame, edits: Column) -> DataFrame:
    """Rows with ``raw`` after the edits (an array), without their typed ``lesson``: order of members, nulls and unknown members stay, and the text itself where there is no edit."""
    some = rows.withColumn("edits", F.when(F.size(edits) > 0, F.to_json(edits))).drop("lesson")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column("raw").to_pylist(), batch.column("edits").to_pylist()
            new = pa.array([t if e is None else _patched(t, e) for t, e in zip(texts, found, strict=True)], pa.string())
            yield batch.set_column(batch.schema.get_field_index("raw"), "raw", new).drop_columns(["edits"])

    return some.mapInArrow(work, some.drop("edits").schema)
