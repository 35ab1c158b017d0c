"""Places of rows in an order, for groups of any size: ranges of the whole order are sorted apart, and counts of the ranges before are added.

A window per group would bring a whole group to one task. Here the rows of a group may lie in any
number of ranges; only what each range says of its first and last group comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursewright.scratch import stored


def ranked(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "rank") -> DataFrame:
    """The rows with ``name``: 1, 2, 3 ... in ``order`` within each group of equal ``keys`` (all rows are one group without keys).

    Nulls in keys are a group of their own. Rows that tie have successive places, any of them
    first. Rows that repeat are rows of their own; no rows: no rows. ``df`` has no column named
    place_, run_, part_ or tie_.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(k) for k in keys], *order]
    tie = df.withColumn("tie_", F.monotonically_increasing_id())  # rows that tie may be more than a task should have
    dealt = tie.repartitionByRange(n, *by, "tie_").sortWithinPartitions(*by, "tie_").drop("tie_")
    schema = T.StructType([*df.schema.fields, T.StructField("place_", T.LongType()), T.StructField("run_", T.LongType()), T.StructField("part_", T.IntegerType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, place, last = TaskContext.get().partitionId(), 0, -1, None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = np.zeros(batch.num_rows, bool)
            for k in keys:
                codes = np.asarray(batch.column(k).dictionary_encode(null_encoding="encode").indices)
                starts[1:] |= codes[1:] != codes[:-1]
            first = [batch.column(k)[0].as_py() for k in keys]
            starts[0] = last is not None and first != last
            last = [batch.column(k)[-1].as_py() for k in keys]
            runs = run + np.cumsum(starts)
            at = np.arange(batch.num_rows)
            since = np.maximum.accumulate(np.where(starts, at, -1))
            places = np.where(since < 0, place + 1 + at, at - since)
            run, place = int(runs[-1]), int(places[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(places), pa.array(runs), pa.array(np.full(len(at), part, np.int32))], [*batch.schema.names, "place_", "run_", "part_"]
            )

    rows = stored(dealt.mapInArrow(work, schema), "ranked")
    group = F.struct(*keys) if keys else F.lit(0)
    spot = F.struct("run_", "place_")
    ends = (
        rows.groupBy("part_")
        .agg(F.min_by(group, spot).alias("first"), F.max_by(group, spot).alias("last"), F.max(spot).alias("end"))
        .orderBy("part_")
        .collect()  # a row per range
    )
    before, offsets = None, [(-1, 0)]
    for e in ends:
        carried = before[1] if before is not None and before[0] == e["first"] else 0
        offsets.append((e["part_"], carried))
        before = (e["last"], e["end"]["place_"] + 1 + (carried if e["end"]["run_"] == 0 else 0))
    carried = F.broadcast(df.sparkSession.createDataFrame(offsets, "part_ int, carried_ long"))
    rank = F.col("place_") + 1 + F.when(F.col("run_") == 0, F.col("carried_")).otherwise(0)
    return rows.join(carried, "part_").withColumn(name, rank).select(*df.columns, name)
