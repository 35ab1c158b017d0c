"""Importance resampling to a target distribution, over hashed n-grams of words.

Documents are dealt to tasks by a row number, and a position table made there: a row per word, in
order. The words after it, within the document, come from lead(); a word with none, one and two of
them are the n-grams that begin at this place. Each falls into a bucket by its hash. Buckets are
counted over all documents and over the target, and their log ratio is a bucket's gain. A document weighs
what the gains of its n-grams sum up to. Adding Gumbel noise, drawn from its id, and taking the
highest is sampling without replacement by these weights.

The text is shuffled once; the position table is never shuffled, and kept as three bucket numbers a word.
Gains are a row for each bucket, so that the table that is joined has a bound. Ranks come from sorted
ranges.

Defined results: a null text and one without a word have no n-grams, weight 0, and are not drawn; neither
are documents of fewer than LEAST_WORDS words. A null doc_id draws noise for an empty id, and comes after all
others in ties. Rows that repeat are rows of their own, weigh the same, and have ranks of their own. A very long
text is dealt whole to one task, which reads it as rows. No documents: no rows. No target: T is 0
in all gains. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursewright.llm.common import partitions, stored
from coursewright.operators.ranking import ranked

BUCKETS, ORDERS = 10_000, 3
#: Words of a document that may be drawn, and the share drawn, in hundredths.
LEAST_WORDS, PERCENT = 20, 5
SEED = 42
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ngrams(docs: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """row, doc_id, pos, g1 ... gN: the buckets of the n-grams that begin with each word; one row of nulls for a document without words."""
    dealt = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").repartition(partitions(docs.sparkSession), "row")
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0))
    table = dealt.select("row", "doc_id", F.posexplode_outer(words).alias("pos", "word"))
    in_order = Window.partitionBy("row").orderBy("pos")
    grams, gram = [], F.col("word")
    for k in range(orders):
        gram = F.concat(gram, F.lit(" "), F.lead("word", k).over(in_order)) if k else gram  # null behind the last word
        grams.append((F.crc32(gram) % buckets).cast("smallint").alias(f"g{k + 1}"))
    return table.select("row", "doc_id", "pos", *grams)


def bucket_counts(grams: DataFrame, orders: int = ORDERS) -> DataFrame:
    """bucket, n: from all orders; a row for each bucket there is."""
    every = grams.select(F.col("g1").alias("bucket"))
    for k in range(2, orders + 1):
        every = every.unionAll(grams.select(F.col(f"g{k}").alias("bucket")))
    return every.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain: a row for each of all buckets, from the bucket counts of both sides."""
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("smallint").alias("bucket"))
    counted = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    whole = Window.partitionBy(F.lit(0))  # as many rows as there are buckets
    s, t, all_s, all_t = (c.cast("double") for c in (F.col("s"), F.col("t"), F.sum("s").over(whole), F.sum("t").over(whole)))
    ratio = ((t + 1) * (all_s + float(buckets))) / ((s + 1) * (all_t + float(buckets)))
    return counted.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weights(grams: DataFrame, gain: DataFrame, orders: int = ORDERS) -> DataFrame:
    """row, doc_id, n_words, n_features, weight: a row per document of the position table."""
    rows, total, count = grams, F.lit(0).cast("long"), F.lit(0).cast("long")
    for k in range(1, orders + 1):
        named = gain.select(F.col("bucket").alias(f"g{k}"), F.col("gain").alias(f"gain{k}"))
        rows = rows.join(F.broadcast(named), f"g{k}", "left")  # a row per bucket
        total, count = total + F.coalesce(f"gain{k}", F.lit(0).cast("long")), count + F.col(f"g{k}").isNotNull().cast("long")
    of = rows.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.count("g1").alias("n_words"), F.sum(count).alias("n_features"), F.sum(total).alias("weight"))
    return of


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, of the id alone."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(said, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every row of ``docs``; ``target`` has a column text."""
    grams = stored(ngrams(docs), "importance-ngrams")
    theirs = ngrams(target.select(F.lit(0).alias("doc_id"), "text"))
    gain = stored(gains(bucket_counts(grams), bucket_counts(theirs)), "importance-gains")
    scored = stored(weights(grams, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "importance-scores")
    can = scored.filter(F.col("n_words") >= least_words)
    draw = percent * can.count() // 100
    placed = ranked(can, [], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()])
    drawn = placed.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resampled(docs, benchmark)


#: CRC-32 of the UTF-8 bytes of a text of n bytes, whose hex digits are x, bit by bit.
CRC = (
    "xor(list_reduce(range(8 * n), lambda s, k: CASE WHEN BIT % 2 = 1 THEN xor(BIT // 2, 3988292384) ELSE BIT // 2 END, 4294967295::BIGINT), 4294967295)"
).replace("BIT", "(CASE WHEN k % 8 = 0 THEN xor(s, ('0x' || substr(x, (k // 4 + 1)::INT, 2))::BIGINT) ELSE s END)")

ORACLE = f"""
WITH texts AS (
  SELECT 0 AS side, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), 0, text FROM benchmark),
words AS (
  SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
grams AS (
  SELECT side, r, unnest(list_transform(range(1, len(w) + 2 - o), lambda i: array_to_string(w[i:i + o - 1], ' '))) AS g
  FROM words, (VALUES (1), (2), (3)) AS orders(o)),
kinds AS (
  SELECT g, {CRC} % {BUCKETS} AS b FROM (SELECT g, strlen(g) AS n, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM grams))),
feats AS (SELECT side, r, b FROM grams JOIN kinds USING (g)),
counts AS (SELECT b, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM feats GROUP BY b),
gain AS (
  SELECT b, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts) + {BUCKETS})::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM counts),
per AS (SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM feats JOIN gain USING (b) WHERE side = 0 GROUP BY r),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN per USING (r) WHERE side = 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS place, sum((n_words >= {LEAST_WORDS})::INT) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {LEAST_WORDS} AND place <= {PERCENT} * n // 100 THEN place END AS rank FROM placed
"""
