"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Rows with equal texts make a group, and groups are placed in descending order, each in the
shard where the dot product of its vector with the residual capacity is highest. Groups of
more than 1 / HEAVY of a shard's capacity, of which there can be no more than
3 * HEAVY * shards, are placed first, on the driver. The others are dealt by hash to tasks,
and each task places its own against its part of what the heavy ones left.
A group that exceeds a whole shard in any dimension is split by a hash of its rows' ids.

Defined results: a null text is a group without bytes or tokens; size is the UTF-8 bytes
plus 1, so that empty texts spread too. Of shards with equal dot products the first is taken, of
equally heavy groups the one of least key. A very long text is a group like others, heavy if it
fills enough of a shard; its words are counted as a whole. Rows that repeat are rows of one group;
which of two equal ones has the lesser slot does not show. No rows: no rows. Other columns of the
input are not read, so that their names cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coursewright.llm.common import partitions, stored, word_count

SHARDS, HEAVY = 16, 512
#: Pieces that make up a shard, for groups larger than one.
PIECES = 4
#: Groups that a task places, and rows that are numbered in one window.
TASK_ITEMS, TASK_ROWS = 50_000, 100_000
DIMS = ("bytes", "tokens", "rows")
#: What each dimension counts in the dot product: the law promises near equal bytes.
IMPORTANCE = np.array([16.0, 1.0, 1.0])


def place(vectors: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """The shard of each vector, in the given order; ``residual`` (shards x dimensions) is used up."""
    out = np.empty(len(vectors), np.int32)
    for i, v in enumerate(vectors):
        out[i] = s = int((residual @ (v * IMPORTANCE)).argmax())
        residual[s] -= v
    return out


def descending(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["weight", "gkey", "piece"], ascending=[False, True, True], kind="stable")


def pack(base: DataFrame, shards: int = SHARDS, heavy: int = HEAVY) -> DataFrame:
    """``base`` (gkey, salt, bytes, tokens, rows=1 per row) with the column shard."""
    spark = base.sparkSession
    groups = stored(base.groupBy("gkey").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")), "shard-groups")
    total = groups.agg(*[F.sum(d).alias(d) for d in DIMS], F.count("*").alias("n")).first()
    if not total["n"]:
        return base.withColumn("shard", F.lit(0)).withColumn("group_rows", F.lit(1).cast("long"))
    cap = {d: max(total[d], 1) / shards for d in DIMS}
    weight = F.greatest(*[F.col(d) / F.lit(cap[d]) for d in DIMS])
    over = {r["gkey"]: math.ceil(r["w"] * PIECES) for r in groups.withColumn("w", weight).filter("w > 1").select("gkey", "w").collect()}  # fewer than 3 * shards
    pieces = F.lit(0)
    for key, n in sorted(over.items()):
        pieces = F.when(F.col("gkey") == key, F.pmod(F.col("salt"), F.lit(n)).cast("int")).otherwise(pieces)
    base = base.withColumn("piece", pieces)
    items = groups.withColumn("piece", F.lit(0))
    if over:
        hot = base.filter(F.col("gkey").isin(list(over)))
        items = items.filter(~F.col("gkey").isin(list(over))).unionByName(hot.groupBy("gkey", "piece").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")))
    items = items.withColumn("weight", weight)
    large = descending(items.filter(F.col("weight") > 1 / heavy).toPandas())  # 3 * heavy * shards at most
    scale = np.array([cap[d] for d in DIMS])
    residual = np.ones((shards, 3))
    vectors = large[list(DIMS)].to_numpy(float).reshape(-1, 3) / scale
    large["shard"] = place(vectors, residual)
    rest = 1 - vectors.sum(axis=0) / shards  # of the mean residual, in each dimension
    rest = np.where(rest > 1e-12, rest, 1)

    def light(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = descending(pdf)
        own = pdf[list(DIMS)].to_numpy(float) / scale
        pdf["shard"] = place(own, residual * (own.sum(axis=0) / shards / rest))
        return pdf[["gkey", "shard"]]

    tasks = max(1, math.ceil(total["n"] / TASK_ITEMS))
    small = (
        items.filter(F.col("weight") <= 1 / heavy)
        .withColumn("task", F.pmod(F.xxhash64("gkey"), F.lit(tasks)))
        .groupBy("task")
        .applyInPandas(light, "gkey string, shard int")
    )
    schema = "gkey string, piece int, shard int, group_rows long"
    first = spark.createDataFrame(list(large[["gkey", "piece", "shard", "rows"]].itertuples(index=False, name=None)), schema)
    placed = base.join(F.broadcast(first), ["gkey", "piece"], "left")
    later = placed.filter("shard IS NULL").drop("shard", "group_rows").join(small.join(groups.select("gkey", F.col("rows").alias("group_rows")), "gkey"), "gkey")
    return placed.filter("shard IS NOT NULL").unionByName(later)


def numbered(placed: DataFrame, rows: int) -> DataFrame:
    """A gapless slot from 0 within each shard: numbers within (shard, bucket) plus the buckets before."""
    buckets = max(1, math.ceil(rows / TASK_ROWS), min(partitions(placed.sparkSession), rows // 100))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")
    return placed.join(offsets, ["shard", "bucket"]).withColumn("slot", F.row_number().over(within) - 1 + F.col("offset")).drop("offset", "bucket")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, bytes, tokens, text_crc32, shard, slot, group_rows."""
    text = F.col("text")
    base = stored(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("bytes"),
            word_count(text).alias("tokens"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
            F.coalesce(F.md5(text), F.lit("null")).alias("gkey"),
            F.xxhash64("doc_id").alias("salt"),
        ),
        "shard-rows",
    )
    placed = stored(pack(base, shards), "shard-placed")
    return numbered(placed, placed.count()).select("doc_id", "bytes", "tokens", "text_crc32", "shard", "slot", "group_rows")


def query(docs: DataFrame) -> DataFrame:
    return shard(docs).select(
        "doc_id", F.col("bytes").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens", "group_rows"
    )
