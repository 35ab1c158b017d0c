"""The prefix trie of conversations: a Cartesian tree over the common prefixes of sorted conversations.

Conversations are sequences of turn digests. The different sequences are sorted into blocks, a range
of them in each; ``lcp`` of a sequence is the number of turns it has in common with the one before.
The nearest smaller values on both sides of each lcp bound the sequences below a branching node: each block finds its
own, and what a block leaves open is found in the nearest block whose minimum is smaller, among
that block's prefix or suffix minima. Equal lcp with equal bounds are one node. A sequence that
goes on beyond both its neighbours ends in a node of its own. All a node tells is a difference of running sums
at its bounds, or a minimum within a block, or over block minima between. Depths between a node and its
parent are nodes with the same members, and are made last.

Equal conversations are one sequence with a count, so that thousands of copies cost one row. Only
the number of blocks decides what the driver sees: two minima of each block.

Defined results: a null role or text is empty. Rows of one turn number go by role, then by a digest of
role and text; a null turn is first. Rows without a conv_id belong to no conversation and are left out.
Repeated rows are turns of their own. c % 5 of a negative c is negative, as in SQL. A very long
text is read once, for its digest and size; a very long conversation is one row of digests. No
conversation: no node, not even the root. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coursewright.llm.common import in_arrow, look_up, partitions, stored

#: Bytes of a turn's digest. Ids that share all but the last CHUNK_BITS bits are joined to one text before they meet others.
DIGEST, CHUNK_BITS = 16, 12
#: Conversations of GROUP successive ids begin alike: with up to HEADS - 1 turns of the first of them.
GROUP, HEADS = 5, 9
NOTHING = hashlib.sha256(b"").hexdigest()
#: Running sums over the sorted sequences: conversations, their bytes, bytes of turns the sequence before lacks, childless ends.
SUMS = ("convs", "bytes", "fresh", "ends")


def sequences(convs: DataFrame) -> DataFrame:
    """conv_id, turns: an array of (digest, size) in order for each conversation of rows (conv_id, turn, role, text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    digest = F.unhex(F.substring(said, 1, 2 * DIGEST))
    rows = convs.filter("conv_id IS NOT NULL").select("conv_id", F.struct("turn", role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size")).alias("t"))
    turns = F.sort_array(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.transform(turns, lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Each conversation with its first turns from the first conversation of its group, as many as its id decides."""
    own = sequences(convs)
    heads = own.select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    both = own.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base")).join(heads, "base", "left")
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    head = F.coalesce(F.slice("head", 1, F.col("h")), F.slice("turns", 1, 0))
    return both.select("conv_id", F.concat(head, rest).alias("turns"))


def member_digests(members: DataFrame) -> DataFrame:
    """seq, ends: SHA-256 of the sorted ids of each sequence, from rows (seq, conv_id): chunks of ids are joined first, then hashed one after the other."""
    chunk = F.shiftright("conv_id", CHUNK_BITS).alias("chunk")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = members.groupBy("seq", chunk).agg(ids.alias("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for batch in batches:
            done = []
            for seq, ids in zip(batch.column("seq").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if seq != now:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = seq, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["seq", "ends"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], ["seq", "ends"])

    dealt = chunks.repartition(partitions(members.sparkSession), "seq").sortWithinPartitions("seq", "chunk").select("seq", "ids")
    return in_arrow(dealt, work, "seq binary, ends string")


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two sequences of digests have in common from the start."""
    n = min(len(a), len(b)) // DIGEST
    left, right = (np.frombuffer(x, np.uint8, n * DIGEST).reshape(n, DIGEST) for x in (a, b))
    differ = np.flatnonzero((left != right).any(axis=1))
    return int(differ[0]) if len(differ) else n


def sorted_blocks(seqs: DataFrame) -> DataFrame:
    """The sequences in order, in blocks: block, k (place in the block), lcp and after (in common with the one before and after; null at the block's ends, which have their key)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, k = TaskContext.get().partitionId(), 0
        held: dict | None = None  # the last row waits for what comes after it

        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema)

        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                now = row | {"block": block, "k": k, "lcp": None, "after": None, "first": row["key"] if k == 0 else None, "last": None}
                if held is not None:
                    now["lcp"] = held["after"] = common_turns(held["key"], row["key"])
                    rows.append(held)
                held, k = now, k + 1
            yield out(rows)
        if held is not None:
            held["last"] = held["key"]
            yield out([held])

    schema = pa.schema(
        [("block", pa.int32()), ("k", pa.int64()), ("lcp", pa.int32()), ("after", pa.int32()), ("first", pa.binary()), ("last", pa.binary())]
        + [("len", pa.int32()), ("sums", pa.list_(pa.int64())), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string())]
    )
    dealt = seqs.repartitionByRange(partitions(seqs.sparkSession), "key").sortWithinPartitions("key")
    return in_arrow(dealt, work, "block int, k long, lcp int, after int, first binary, last binary, len int, sums array<long>, n long, least long, ends string")


def block_borders(blocks: DataFrame) -> DataFrame:
    """block, b (its number among those with rows), offset, border and next_border (lcp with the blocks beside; -1 where there is none): a row per block."""
    in_order = Window.partitionBy(F.lit(0)).orderBy("block")  # a row per block
    ends = blocks.groupBy("block").agg(F.count("*").alias("rows"), F.max("first").alias("first"), F.max("last").alias("last"))
    beside = ends.select(
        "block",
        (F.row_number().over(in_order) - 1).alias("b"),
        (F.sum("rows").over(in_order) - F.col("rows")).alias("offset"),
        "first",
        F.lag("last").over(in_order).alias("before"),
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("before").to_pylist(), batch.column("first").to_pylist(), strict=True)
            border = [-1 if before is None else common_turns(before, first) for before, first in pairs]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("block", "b", "offset")), pa.array(border, pa.int32())], ["block", "b", "offset", "border"])

    told = in_arrow(beside, work, "block int, b int, offset long, border int")
    return told.withColumn("next_border", F.coalesce(F.lead("border").over(in_order), F.lit(-1)))


def smaller_before(values: np.ndarray) -> np.ndarray:
    """The last place before each with a smaller value, -1 where there is none."""
    out, stack = np.full(len(values), -1, np.int64), []
    for i, v in enumerate(values.tolist()):
        while stack and stack[-1][0] >= v:
            stack.pop()
        out[i] = stack[-1][1] if stack else -1
        stack.append((v, i))
    return out


def least_between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of values[lo:hi] for each pair lo < hi."""
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        half, last = 1 << (len(levels) - 1), levels[-1]
        levels.append(np.minimum(last[:-half], last[half:]))
    level = np.frexp(np.maximum(hi - lo, 1).astype(float))[1] - 1
    out = np.empty(len(lo), values.dtype)
    for at in np.unique(level):
        pick = level == at
        out[pick] = np.minimum(levels[at][lo[pick]], levels[at][hi[pick] - (1 << int(at))])
    return out


def within_blocks(rows: DataFrame) -> DataFrame:
    """Each block's own share: smaller values before and after, least id between them and to the block's ends, running sums; from rows (b, i, lcp, least, SUMS)."""
    most = np.iinfo(np.int64).max

    def work(block: pa.Table) -> pa.Table:
        block = block.sort_by("i")
        i, lcp, least = (block.column(c).to_numpy() for c in ("i", "lcp", "least"))
        before, after = smaller_before(lcp), len(lcp) - 1 - smaller_before(lcp[::-1])[::-1]
        inside = (before >= 0) & (after < len(lcp))
        inner = np.full(len(i), most)
        inner[inside] = least_between(least, before[inside], after[inside])
        to_end = np.minimum.accumulate(least[::-1])[::-1]
        from_start = np.concatenate([[most], np.minimum.accumulate(least)[:-1]])
        optional = lambda x, ok: pa.array(x, pa.int64(), mask=~ok)
        columns = {
            "b": block.column("b"), "i": block.column("i"), "lcp": block.column("lcp"),
            "before": optional(i[np.maximum(before, 0)], before >= 0), "after": optional(i[np.minimum(after, len(i) - 1)], after < len(i)),
            "inner": optional(inner, inside), "to_end": pa.array(to_end), "from_start": optional(from_start, from_start < most),
        }
        for name in SUMS:
            values = block.column(name).to_numpy()
            columns[f"e_{name}"] = pa.array(np.cumsum(values) - values)
        return pa.table(columns)

    sums = ", ".join(f"e_{name} long" for name in SUMS)
    return rows.groupBy("b").applyInArrow(work, f"b int, i long, lcp int, before long, after long, inner long, to_end long, from_start long, {sums}")


def open_bounds(local: DataFrame, minima: np.ndarray, side: str) -> DataFrame:
    """b, lcp, at: for the values a block leaves open on a side, the place of the nearest smaller value in another block."""
    back = side == "before"
    nearest = F.max if back else F.min
    asked = local.filter(F.col(side).isNull() & (F.col("lcp") >= 0)).select("b", "lcp").distinct()
    other = "after" if back else "before"
    steps = local.filter(F.col(other).isNull()).groupBy("b", "lcp").agg(nearest("i").alias("at"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for b, v in zip(batch.column("b").to_pylist(), batch.column("lcp").to_pylist(), strict=True):
                smaller = np.flatnonzero(minima[:b] < v)[-1:] if back else b + 1 + np.flatnonzero(minima[b + 1 :] < v)[:1]
                found.append(int(smaller[0]) if len(smaller) else None)
            yield pa.RecordBatch.from_arrays([batch.column("b"), batch.column("lcp"), pa.array(found, pa.int32())], ["b", "lcp", "to"])

    aimed = in_arrow(asked, work, "b int, lcp int, to int")
    # the step of largest value under the one asked for is the nearest
    questions = aimed.filter("to IS NOT NULL").select(F.col("to").alias("b"), "lcp").distinct()
    so_far = Window.partitionBy("b").orderBy("lcp", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = (
        steps.select("b", "lcp", F.lit(1).alias("kind"), "at")
        .unionByName(questions.select("b", "lcp", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("at")))
        .withColumn("at", F.last("at", ignorenulls=True).over(so_far))
        .filter("kind = 0")
        .select(F.col("b").alias("to"), "lcp", "at")
    )
    return aimed.join(told, ["to", "lcp"], "left").select("b", "lcp", "at")


def trie(convs: DataFrame) -> DataFrame:
    """A row per node: what the contract of ``query`` names."""
    whole = rebuilt(convs)
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    named = stored(whole.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes")), "trie-rebuilt")
    seq = F.unhex(F.sha2("key", 256)).alias("seq")
    running = F.aggregate("sizes", F.array(F.lit(0).cast("long")), lambda sums, size: F.concat(sums, F.array(F.element_at(sums, -1) + size)))
    seqs = named.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.first("sizes").alias("sizes"))
    seqs = seqs.select("*", seq).join(member_digests(named.select(seq, "conv_id")), "seq")
    blocks = stored(sorted_blocks(seqs.select("key", F.size("sizes").alias("len"), running.alias("sums"), "n", "least", "ends")), "trie-sorted")
    borders = stored(block_borders(blocks), "trie-borders")

    placed = (
        blocks.join(F.broadcast(borders), "block")  # a row per block
        .withColumn("i", F.col("offset") + F.col("k"))
        .withColumn("lcp", F.coalesce("lcp", "border"))
        .withColumn("after", F.coalesce("after", "next_border"))
        .withColumn("all", F.element_at("sums", -1))
        .withColumn("convs", F.col("n"))
        .withColumn("bytes", F.col("n") * F.col("all"))
        .withColumn("fresh", F.col("all") - F.element_at("sums", F.greatest("lcp", F.lit(0)) + 1))
        .withColumn("own_end", F.col("len") > F.greatest("lcp", "after"))
    )
    childless = (F.col("after") < F.col("len")).cast("long")
    local = stored(within_blocks(placed.select("b", "i", "lcp", "least", "convs", "bytes", "fresh", childless.alias("ends"))), "trie-local")
    totals = placed.groupBy("b").agg(F.min("lcp").alias("low"), F.min("least").alias("least"), F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in SUMS[:3]], F.sum(childless).alias("ends"))
    totals = totals.orderBy("b").collect()  # a row per block
    if not totals:
        return convs.sparkSession.createDataFrame([], SCHEMA)
    n = sum(t["rows"] for t in totals)
    low, leasts = (np.array([t[c] for t in totals], np.int64) for c in ("low", "least"))

    bounds = {side: open_bounds(local, low, side).withColumnRenamed("at", f"far_{side}") for side in ("before", "after")}
    known = local
    for side in bounds:
        known = known.join(bounds[side], ["b", "lcp"], "left").withColumn(side, F.coalesce(side, f"far_{side}")).drop(f"far_{side}")
    known = stored(known.withColumn("after", F.coalesce("after", F.lit(n))), "trie-bounds")

    branching = known.filter("lcp >= 0").select(F.col("before").alias("l"), F.col("after").alias("z"), F.col("lcp").alias("d"), F.lit(1).cast("long").alias("splits"), "inner")
    ends = placed.filter("own_end").select(F.col("i").alias("l"), (F.col("i") + 1).alias("z"), F.col("len").alias("d"), F.lit(0).cast("long").alias("splits"), F.col("least").alias("inner"))
    root = convs.sparkSession.createDataFrame([(0, n, 0, 0, None)], "l long, z long, d int, splits long, inner long")
    nodes = branching.unionByName(ends).unionByName(root).groupBy("l", "z", "d").agg(F.sum("splits").alias("splits"), F.max("inner").alias("inner"))

    # running sums of whole blocks go before those within a block; a last row stands behind all
    offsets, sums = [], [0] * len(SUMS)
    for t in totals:
        offsets.append((t["b"], *sums))
        sums = [s + t[c] for s, c in zip(sums, SUMS, strict=True)]
    before = convs.sparkSession.createDataFrame(offsets, "b int, " + ", ".join(f"o_{c} long" for c in SUMS))
    behind = convs.sparkSession.createDataFrame([(n, len(totals), -1, None, None, *sums)], "i long, b int, lcp int, before long, from_start long, " + ", ".join(f"{c} long" for c in SUMS))
    spots = known.join(F.broadcast(before), "b").withColumns({c: F.col(f"o_{c}") + F.col(f"e_{c}") for c in SUMS})
    left = spots.select(F.col("i").alias("l"), "b", F.col("lcp").alias("l_lcp"), F.col("before").alias("l_before"), "to_end", *[F.col(c).alias(f"l_{c}") for c in SUMS])
    left = left.join(placed.select(F.col("i").alias("l"), "len", F.col("sums").alias("run"), "all", F.col("fresh").alias("own_fresh"), F.col("ends").alias("ends_sha256")), "l")
    right = spots.select("i", "b", "lcp", "before", "from_start", *SUMS).unionByName(behind)
    right = right.select(F.col("i").alias("z"), F.col("b").alias("z_b"), F.col("lcp").alias("z_lcp"), F.col("before").alias("z_before"), "from_start", *SUMS)
    both = nodes.join(left, "l").join(right, "z")
    # what holds all sequences has the root above it, though no lcp is that small
    up = F.greatest("l_lcp", "z_lcp", F.when(F.col("d") > 0, 0))
    both = both.select(
        "l", "d", "b", "z_b", "inner", "to_end", "from_start", "len", "run", "ends_sha256",
        up.alias("p"),
        F.coalesce(F.when(F.col("l_lcp") >= F.col("z_lcp"), F.col("l_before")).otherwise(F.col("z_before")), F.lit(0)).alias("parent_l"),
        (F.col("splits") + (F.col("len") > F.col("d")).cast("long")).alias("kids"),
        (F.col("convs") - F.col("l_convs")).alias("n_convs"),
        (F.col("ends") - F.col("l_ends")).alias("n_leaves"),
        (F.col("bytes") - F.col("l_bytes") - (F.col("fresh") - F.col("l_fresh")) + F.col("own_fresh") - F.col("all")).alias("repeated"),
    )
    nodes = stored(with_least(both, leasts), "trie-nodes")
    return expanded(nodes)


def with_least(nodes: DataFrame, leasts: np.ndarray) -> DataFrame:
    """The nodes with ``least``, their least member: known within a block, else from the blocks' ends and the least of blocks between."""
    fields = [f for f in nodes.schema.fields if f.name not in ("b", "z_b", "inner", "to_end", "from_start")]
    most = np.iinfo(np.int64).max

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = {c: batch.column(c).cast(pa.int64()).fill_null(most).to_numpy(zero_copy_only=False) for c in ("b", "z_b", "inner", "to_end", "from_start")}
            least = value["inner"].copy()
            wide = np.flatnonzero(batch.column("inner").is_null().to_numpy(zero_copy_only=False))
            lo, hi = value["b"][wide] + 1, value["z_b"][wide]
            middle = np.full(len(wide), most)
            some = hi > lo
            middle[some] = least_between(leasts, lo[some], hi[some])
            least[wide] = np.minimum(np.minimum(value["to_end"][wide], value["from_start"][wide]), middle)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(least)], [*(f.name for f in fields), "least"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return in_arrow(nodes, work, f"{kept}, least long")


SCHEMA = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def expanded(nodes: DataFrame) -> DataFrame:
    """Every depth from below a node's parent to its own; the parent of the first is looked up, as a root may have a third of all nodes below it."""
    name = lambda left, depth: F.concat_ws("/", left, depth)
    parents = nodes.select(name("l", "d").alias("up"), F.col("least").alias("up_least"))
    below = look_up(nodes.filter("p >= 0").withColumn("up", name("parent_l", "p")), parents, "up").drop("up")
    every = below.unionByName(nodes.filter("p < 0").withColumn("up_least", F.lit(None).cast("long")))
    # bytes of the turns before each depth, which are not part of the subtree
    depth = F.explode(F.transform(F.sequence(F.col("p") + 1, "d"), lambda d: F.struct(d.alias("depth"), F.when(d > 0, F.get("run", d - 1)).otherwise(0).alias("above"))))
    rows = every.withColumn("at", depth).withColumn("depth", F.col("at.depth"))
    last = F.col("depth") == F.col("d")
    return rows.select(
        F.col("least").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") > F.col("p") + 1, F.col("least")).otherwise(F.col("up_least")).alias("parent_conv_id"),
        "n_convs",
        F.when(last, F.col("kids")).otherwise(1).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("repeated") - (F.col("n_convs") - 1) * F.col("at.above")).alias("saved_tokens"),
        F.when(last & (F.col("len") == F.col("d")), F.col("ends_sha256")).otherwise(NOTHING).alias("ends_sha256"),
    )


def query(convs: DataFrame) -> DataFrame:
    return trie(convs.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text"))


ORACLE = f"""
WITH h AS (
  SELECT c, (xor(list_reduce(range(8 * length(c::VARCHAR)), lambda s, k: CASE WHEN X % 2 = 1 THEN xor(X // 2, 3988292384) ELSE X // 2 END, 4294967295::BIGINT), 4294967295) % {HEADS})::INT AS h
  FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL)),
t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, dig) AS p, dig, bytes
  FROM (
    SELECT conv_id, turn, role, strlen(text) AS bytes, substr(sha256(strlen(role)::VARCHAR || ':' || role || text), 1, {2 * DIGEST}) AS dig
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL))),
r AS (
  SELECT h.c, t.p, t.dig, t.bytes FROM h JOIN t ON t.c = h.c - h.c % {GROUP} AND t.p <= h.h
  UNION ALL SELECT h.c, 1000 + t.p, t.dig, t.bytes FROM h JOIN t ON t.c = h.c AND t.p > h.h),
s AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY p) AS d, sha256(string_agg(dig, '') OVER (PARTITION BY c ORDER BY p)) AS k, bytes FROM r
  UNION ALL SELECT c, 0, '', 0 FROM h),
m AS (SELECT d, k, count(*) AS n_convs, min(c) AS c, (count(*) - 1) * min(bytes) AS saved FROM s GROUP BY d, k),
up AS (SELECT m.d, m.k, q.k AS pk FROM m JOIN s q ON q.c = m.c AND q.d = m.d - 1),
kids AS (SELECT d - 1 AS d, pk AS k, count(*) AS n FROM up GROUP BY 1, 2),
sub AS (
  SELECT a.d, a.k, count(*) FILTER (kids.n IS NULL) AS n_leaves, sum(m.saved) AS saved
  FROM m JOIN s a ON a.c = m.c AND a.d <= m.d LEFT JOIN kids ON kids.d = m.d AND kids.k = m.k GROUP BY 1, 2),
fin AS (SELECT d, k, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha FROM (SELECT c, max(d) AS d, arg_max(k, d) AS k FROM s GROUP BY c) GROUP BY d, k)
SELECT m.c AS conv_id, m.d::BIGINT AS depth, pm.c AS parent_conv_id, m.n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, sub.n_leaves,
  sub.saved::BIGINT AS saved_tokens, coalesce(fin.sha, sha256('')) AS ends_sha256
FROM m JOIN sub ON sub.d = m.d AND sub.k = m.k LEFT JOIN kids ON kids.d = m.d AND kids.k = m.k LEFT JOIN fin ON fin.d = m.d AND fin.k = m.k
LEFT JOIN up ON up.d = m.d AND up.k = m.k LEFT JOIN m pm ON pm.d = m.d - 1 AND pm.k = up.pk
""".replace("X", "(CASE WHEN k % 8 = 0 THEN xor(s, ascii(substr(c::VARCHAR, (k // 8 + 1)::INT, 1))) ELSE s END)")
