"""Mixing sources to target weights, with DataFrame operations only.

Each source's words, its documents one after the other in the order of a hash, are packed
into blocks of fixed length. A source takes its target as slots, each a block or a part of one.
An output shard has a fixed number of slots, and how many of them each source has is drawn: shard by
shard, from what the sources have left, so that each shard is a draw of its own and all together have what the
targets ask for. Such draws are the pieces of one pseudorandom permutation of all slots, cut at every
shard's end; so no shard waits for another. A shard's slots then follow those of the shards
before it, and a source's j-th slot is the block at
place j of a pseudorandom index permutation of the source, a new one for each pass over its
blocks; the last pass ends where the target is reached. Slots and documents meet in a join on
(source, block).

Defined results: null text or no word: size 0, nothing taken. A null source is a source of
its own, the last. Rows that repeat are rows of their own; rows of one doc_id follow in order of
size, and which of two equal ones comes first does not show. A very long text has pieces in many
blocks. No rows: no rows. Other columns of the input are not read, so that their names cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursewright.llm.common import WORD_PATTERN, partitions, spare, stored, word_count

#: Words in a block, and slots of an output shard.
BLOCK_WORDS, SHARD_SLOTS = 1024, 1024
WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2
#: Rounds of a walk of the permutation, and walks at most: more than any cycle of a domain of 64 has, and beyond that
#: fewer than 2 in 9 indices need another walk each time.
ROUNDS, WALKS = 4, 64
#: In place of a source's key in the permutation of all slots; no key is equal to it.
SHARDS = "*"
#: Slots that one row is exploded into.
RUN = 4096


def number(*parts: Column) -> Column:
    """A pseudorandom long of 60 bits for the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def row_hash() -> Column:
    """Equal for rows of equal doc_id, source and text."""
    return F.xxhash64(*[x for c in ("doc_id", "source", "text") for x in (F.col(c), F.col(c).isNull())])


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and key (the source as a string that is never null)."""
    return docs.select(
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")).alias("key"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"),
        row_hash().alias("row"),
    )


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, repeats=REPEATS) -> DataFrame:
    """key, source, source_size, target for each source, from rows (key, source, size).

    Weights repeat over the sources by code point, null last. Targets share ``share`` times all
    sizes by weight; none exceeds ``repeats`` times its source's size, and what is over is
    shared again. That is min(cap, level * weight) for one level, which the sources in order
    of cap / weight show. The windows have a row per source.
    """
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").isNull(), "source")
    by_ratio = every.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = (
        sizes.groupBy("key", "source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("wanted", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("capped", F.sum("cap").over(by_ratio) - F.col("cap"))
        .withColumn("left", F.sum("weight").over(every) - F.sum("weight").over(by_ratio) + F.col("weight"))
        .withColumn("level", (F.col("wanted") - F.col("capped")) / F.col("left"))
        .withColumn("place", F.sum(F.lit(1)).over(by_ratio))
        .withColumn("level", F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.col("place"))).over(every))
    )
    return s.select("key", "source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), "cap")).alias("target"))


def permuted(at: Column, n: Column, seed: int, key: Column, turn: Column) -> Column:
    """The place of index ``at`` in a pseudorandom permutation of 0 to n - 1, one for each seed, key and turn.

    A Feistel network on pairs below the root of n, rounded up, permutes the next square number;
    what falls outside of n walks on. A state is a number, -1 - number when it has arrived.
    """
    root = F.ceil(F.sqrt(n.cast("double"))).cast("long")

    def step(state: Column, i: Column) -> Column:
        left, right = F.floor(state / root).cast("long"), state % root
        moved = right * root + (left + number(F.lit(seed), F.lit("f"), key, turn, i % ROUNDS, right) % root) % root
        return F.when(state < 0, state).when((i % ROUNDS == ROUNDS - 1) & (moved < n), -1 - moved).otherwise(moved)

    return -1 - F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS * WALKS - 1)), at.cast("long"), step)


def spread(rows: DataFrame, n: str, name: str, *keys: str) -> DataFrame:
    """Each row once for each number ``name`` from 0 to n - 1, dealt to tasks by ``keys`` in runs of RUN numbers."""
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({n} - 1) div {RUN}"))).alias("run")
    dealt = rows.filter(f"{n} > 0").select("*", run).repartition(partitions(rows.sparkSession), *keys, "run")
    return dealt.select("*", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col(n), (F.col("run") + 1) * RUN) - 1)).alias(name)).drop("run")


def shard_counts(per: DataFrame, seed: int = 0, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """key, shard, k: how many of an output shard's slots (``shard_slots`` at most, in all shards as many or one more) each source has; from rows (key, n)."""
    by_key = Window.partitionBy(F.lit(0)).orderBy("key")  # a row per source
    starts = per.select("key", "n", (F.sum("n").over(by_key) - F.col("n")).alias("first"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("all"))
    each = spread(starts, "n", "i", "key")
    place = permuted(F.col("first") + F.col("i"), F.col("all"), seed, F.lit(SHARDS), F.lit(0))
    return each.withColumn("place", place).groupBy("key", F.expr(f"(place * ceil(all / {shard_slots})) div all").alias("shard")).agg(F.count("*").alias("k"))


def slots(sources: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """key, shard, slot, turn (pass over the source), block, len (words used of the block): a row per slot, from rows (key, source_size, target)."""
    b = block_words
    per = (
        sources.filter("source_size > 0")
        .select("key", F.col("source_size").alias("s"), F.round("target").cast("long").alias("take"))
        .withColumn("whole", F.expr(f"s div {b}"))
        .withColumn("tail", F.expr(f"s % {b}"))
        .withColumn("blocks", F.col("whole") + F.when(F.col("tail") > 0, 1).otherwise(0))
        .withColumn("passes", F.expr("take div s"))
        .withColumn("rest", F.expr("take % s"))
        .withColumn("rest_whole", F.least(F.expr(f"rest div {b}"), "whole"))
        .withColumn("rest_part", F.col("rest") - F.col("rest_whole") * b)
        .withColumn("n", F.col("passes") * F.col("blocks") + F.col("rest_whole") + F.when(F.col("rest_part") > 0, 1).otherwise(0))
        .filter("n > 0")
    )
    before = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per output shard
    counts = shard_counts(per, seed, shard_slots).withColumn("start", F.coalesce(F.sum("k").over(before), F.lit(0)))
    each = spread(counts.join(F.broadcast(per), "key"), "k", "j", "key", "shard")
    in_rest = F.col("turn") == F.col("passes")
    return (
        each.withColumn("slot", F.col("start") + F.col("j"))
        .withColumn("turn", F.expr("slot div blocks"))
        .withColumn("at", F.expr("slot % blocks"))
        .withColumn("block", F.when(F.col("at") < F.col("whole"), permuted(F.col("at"), F.col("whole"), seed, F.col("key"), F.col("turn"))).otherwise(F.col("whole")))
        .withColumn("len", F.when(in_rest & (F.col("at") == F.col("rest_whole")), F.col("rest_part")).when(F.col("at") < F.col("whole"), F.lit(b).cast("long")).otherwise(F.col("tail")))
        .select("key", "shard", "slot", "turn", "block", "len")
    )


def mix(docs: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """Taken words of each row, and the slots.

    First: row, doc_id, source, size, source_size, target, start (of the row's words in its
    source), taken, and takes: an array of (turn, slot, shard, first, words) for each run of
    words taken. Second: what ``slots`` gives.
    """
    base = stored(sized(docs), "mix-sizes")
    # documents of a source are dealt by the first hex digits of their hash: about as many buckets as documents in each
    bucket = F.substring("h", 1, max(1, math.ceil(math.log(max(base.count(), 1), 16) / 2)))
    sums = base.groupBy("key", "source", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
    targets = stored(source_targets(sums), "mix-targets")
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("key", "bucket", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset")).join(targets.drop("source"), "key")
    before = Window.partitionBy("key", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        base.withColumn("bucket", bucket)
        .join(offsets, ["key", "bucket"])
        .withColumn("start", F.col("offset") + F.coalesce(F.sum("size").over(before), F.lit(0)))
    )
    dealt = slots(targets, seed, block_words)
    last = F.expr(f"(start + size - 1) div {block_words}")
    keep = ["row", "doc_id", "source", "size", "source_size", "target"]
    pieces = (
        placed.filter("size > 0")
        .select(*keep, "key", "start", F.explode(F.sequence(F.expr(f"start div {block_words}"), last)).alias("block"))
        .withColumn("lo", F.greatest(F.col("start") - F.col("block") * block_words, F.lit(0)))
        .withColumn("hi", F.least(F.col("start") + F.col("size") - F.col("block") * block_words, F.lit(block_words)))
    )
    words = F.greatest(F.least(F.col("hi"), F.coalesce(F.col("len"), F.lit(0))) - F.col("lo"), F.lit(0))
    joined = pieces.join(dealt.hint("merge"), ["key", "block"], "left")  # both sides grow with the corpus
    take = F.when(words > 0, F.struct("turn", "slot", "shard", (F.col("block") * block_words + F.col("lo") - F.col("start")).alias("first"), words.alias("words")))
    taken = (
        joined.groupBy("key", "start")
        .agg(*[F.first(c).alias(c) for c in keep], F.coalesce(F.sum(words), F.lit(0)).alias("taken"), F.collect_list(take).alias("takes"))
        .select(*keep, "start", "taken", "takes")
    )
    none = F.array().cast("array<struct<turn:bigint,slot:bigint,shard:bigint,first:bigint,words:bigint>>")
    empty = placed.filter("size = 0").select(*keep, "start", F.lit(0).cast("long").alias("taken"), none.alias("takes"))
    return taken.unionByName(empty), dealt


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` as the mix takes them, with the same columns: once for each pass that takes words of a row.

    A row that a pass takes whole keeps its text; of one taken in part the text is the words
    taken, one blank between them. n_chars, where there is one, counts the new text.
    """
    taken, _ = mix(docs, seed)
    runs_of = lambda turn: F.filter("takes", lambda t: t["turn"] == turn)
    words_of = lambda turn: F.array_sort(F.transform(runs_of(turn), lambda t: F.struct(t["first"].alias("first"), t["words"].alias("words"))))
    turns = F.array_distinct(F.transform("takes", lambda t: t["turn"]))
    # a row's passes; what rows that repeat take is gathered, as it doesn't matter which of them has which pass
    row, size, passes, runs = spare(docs.columns, "row", "size", "passes", "runs")
    each = stored(taken.select(F.col("row").alias(row), F.col("size").alias(size), F.transform(turns, words_of).alias(passes)), "mix-plan")
    plan = each.groupBy(row).agg(F.first(size).alias(size), F.flatten(F.collect_list(passes)).alias(passes), F.count("*").alias("n"))
    rows = docs.withColumn(row, row_hash())
    if not plan.filter("n > 1").isEmpty():
        rows = rows.dropDuplicates([row])
    plan = plan.filter(F.size(passes) > 0).drop("n")
    rows = rows.join(plan, row).withColumn(runs, F.explode(passes))
    words = F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0))
    some = F.flatten(F.transform(runs, lambda r: F.slice(words, (r["first"] + 1).cast("int"), r["words"].cast("int"))))
    whole = F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["words"]) >= F.col(size)
    rows = rows.withColumn("text", F.when(whole, F.col("text")).otherwise(F.array_join(some, " ")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def query(docs: DataFrame) -> DataFrame:
    """The contract's columns, the least output shard that takes words of a document (null: none) and how many do."""
    taken, _ = mix(docs)
    shards = F.array_sort(F.array_distinct(F.transform("takes", lambda t: t["shard"])))
    return taken.select("doc_id", "size", "source_size", "target", "taken", F.get(shards, F.lit(0)).alias("first_shard"), F.size(shards).cast("long").alias("n_shards"))


ORACLE = f"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS k, md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
src AS (
  SELECT k, source, sum(size)::BIGINT AS s, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS w
  FROM base GROUP BY k, source),
lev AS (
  SELECT *, count(*) OVER o AS place, (1.5::DOUBLE * sum(s) OVER () - (sum(2.0::DOUBLE * s) OVER o - 2.0::DOUBLE * s)) / (sum(w) OVER () - sum(w) OVER o + w) AS l
  FROM src WINDOW o AS (ORDER BY 2.0::DOUBLE * s / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
tgt AS (
  SELECT k, s, least(2.0::DOUBLE * s, coalesce(arg_min(l, CASE WHEN l <= 2.0::DOUBLE * s / w THEN place END) OVER () * w, 2.0::DOUBLE * s)) AS target FROM lev),
per AS (
  SELECT *, s // {BLOCK_WORDS} AS whole, s % {BLOCK_WORDS} AS tail, round(target)::BIGINT AS take FROM tgt WHERE s > 0),
per2 AS (
  SELECT *, whole + (tail > 0)::INT AS blocks, take // s AS passes, take % s AS rest, least((take % s) // {BLOCK_WORDS}, whole) AS rw FROM per),
dr AS (
  SELECT *, ceil(sqrt(whole::DOUBLE))::BIGINT AS root, (sum(nn) OVER (ORDER BY k) - nn)::BIGINT AS start_n, (sum(nn) OVER ())::BIGINT AS all_n
  FROM (SELECT *, (passes * blocks + rw + (rest > rw * {BLOCK_WORDS})::INT)::BIGINT AS nn FROM per2) WHERE nn > 0),
ct0 AS (
  SELECT k AS own, '{SHARDS}' AS k, 0 AS turn, all_n, all_n AS whole, ceil(sqrt(all_n::DOUBLE))::BIGINT AS root, start_n + unnest(range(nn)) AS pos FROM dr),
ct AS (SELECT own AS k, (PLACE) * ceil(all_n / {SHARD_SLOTS})::BIGINT // all_n AS shard, count(*) AS kk FROM ct0 GROUP BY 1, 2),
sl AS (
  SELECT dr.*, shard, unnest(range(first::BIGINT, (first + kk)::BIGINT)) AS slot
  FROM (SELECT *, sum(kk) OVER (PARTITION BY k ORDER BY shard) - kk AS first FROM ct) c JOIN dr USING (k)),
sl2 AS (
  SELECT *, slot // blocks AS turn, slot % blocks AS pos FROM sl),
sl3 AS (
  SELECT k, shard, CASE WHEN pos < whole THEN PLACE ELSE whole END AS block,
    CASE WHEN turn = passes AND pos = rw THEN rest - rw * {BLOCK_WORDS} WHEN pos < whole THEN {BLOCK_WORDS} ELSE tail END AS n
  FROM sl2),
pos AS (
  SELECT *, sum(size) OVER (PARTITION BY k ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start FROM base),
pc AS (
  SELECT *, unnest(range((start // {BLOCK_WORDS})::BIGINT, ((start + size - 1) // {BLOCK_WORDS})::BIGINT + 1)) AS block FROM pos WHERE size > 0),
tk AS (
  SELECT k, start, sum(words)::BIGINT AS taken, min(shard) FILTER (words > 0) AS first_shard, count(DISTINCT shard) FILTER (words > 0) AS n_shards
  FROM (
    SELECT pc.k, pc.start, sl3.shard, greatest(0, least(least(start + size - pc.block * {BLOCK_WORDS}, {BLOCK_WORDS}), sl3.n)
      - greatest(start - pc.block * {BLOCK_WORDS}, 0)) AS words
    FROM pc JOIN sl3 ON pc.k = sl3.k AND pc.block = sl3.block) GROUP BY 1, 2)
SELECT pos.doc_id, pos.size, tgt.s AS source_size, tgt.target AS target, (CASE WHEN size > 0 THEN coalesce(taken, 0) ELSE 0 END)::BIGINT AS taken,
  first_shard, coalesce(n_shards, 0) AS n_shards
FROM pos JOIN tgt USING (k) LEFT JOIN tk ON tk.k = pos.k AND tk.start = pos.start AND pos.size > 0
""".replace(
    "PLACE", f"-1 - list_reduce(range({ROUNDS * WALKS}), lambda state, i: CASE WHEN state < 0 THEN state WHEN i % {ROUNDS} = {ROUNDS - 1} AND MOVED < whole THEN -1 - MOVED ELSE MOVED END, pos::BIGINT)"
).replace(
    "MOVED", f"((state % root) * root + (state // root + ('0x' || substr(md5('0/f/' || k || '/' || turn || '/' || (i % {ROUNDS}) || '/' || (state % root)), 1, 15))::BIGINT % root) % root)"
)
