"""Connected components by large-star and small-star rounds (Kiveris and others, 2014), as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from coursewright.llm.common import discard, stored

#: Rounds after which something must be wrong; the number needed grows with the logarithm of the nodes.
MOST_ROUNDS = 60


def _least(arcs: DataFrame) -> DataFrame:
    """u, v, m: each arc with the least of u and its neighbours."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return arcs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node), for all nodes of edges (a, b) of longs, as a stored table."""
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "arcs")
    sign = None
    for _ in range(MOST_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.filter("u <> v").distinct()
        small = _least(down)
        star = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        seen = Observation()
        before, now = now, stored(star.distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "arcs")
        discard(before)
        last, sign = sign, (seen.get["n"], seen.get["h"])
        if sign == last:
            break
    else:
        raise RuntimeError("components did not settle")
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")))
    out = stored(ends.distinct(), "components")
    discard(now)
    return out
