"""Card wiring: cards that no exercise uses, beside the exercises whose text contains them word for word."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursewright.functions.textsem import falsy
from coursewright.operators.rewrite import edit, rewritten
from coursewright.plans.rules import array_of, unused_cards
from coursewright.plans.validate import computed

NO_MATCH = "no verbatim match in any exercise text field"


def text_fields(ex: Column) -> Column:
    """(field, quote) of an exercise, in the order in which evidence is told."""
    one = lambda field, quote: F.struct(field.alias("field"), quote.alias("quote"))
    at = lambda name, i, rest="": F.concat(F.lit(f"{name}["), i.cast("string"), F.lit(f"]{rest}"))
    kind = "array<struct<field string, quote string>>"
    listed = lambda name: F.transform(array_of(ex[name]), lambda x, i: one(at(name, i), x))
    pairs = F.flatten(F.transform(F.coalesce(ex["pairs"], F.array()), lambda p, i: F.array(one(at("pairs", i, ".left"), p["left"]), one(at("pairs", i, ".right"), p["right"]))))
    blanks = F.flatten(
        F.transform(F.coalesce(ex["blanks"], F.array()), lambda b, i: F.transform(array_of(b["accept"]), lambda x, j: one(F.concat(at("blanks", i, ".accept["), j.cast("string"), F.lit("]")), x)))
    )
    return F.concat(
        F.array(one(F.lit("prompt"), ex["prompt"])).cast(kind),
        F.when(~falsy(ex["sentence"]), F.array(one(F.lit("sentence"), ex["sentence"])).cast(kind)).otherwise(F.array().cast(kind)),
        F.transform(F.coalesce(ex["options"], F.array()), lambda o, i: one(at("options", i, ".text"), o["text"])).cast(kind),
        pairs.cast(kind),
        listed("accept").cast(kind),
        blanks.cast(kind),
        listed("tiles").cast(kind),
    )


def containment(cards: DataFrame, quotes: DataFrame, keys: list[str]) -> DataFrame:
    """card_id, exercise_id, hits: which exercises contain a card; from cards (keys, card_id, text), quotes (keys, exercise_id, quote).

    The equal keys (a lesson's path) make it a hash join with a residual test.
    """
    some = cards.filter(~falsy(F.col("text")))
    hit = F.col("quote").contains(F.col("text"))
    on = [some[k].eqNullSafe(quotes[k]) for k in keys] + [hit]
    other = quotes.select(*[quotes[k] for k in keys], "exercise_id", "quote")
    return some.join(other, on, "inner").groupBy(*[some[k] for k in keys], "card_id", "exercise_id").agg(F.count("*").alias("hits"))


#: Words in a row by which a card is looked for.
RUN = 4


#: Bits of the table that keeps the runs that no card has out of the join.
RUN_BITS, PART_BITS = 1 << 24, 1 << 15
_BASE, _M1, _M2 = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n - 1 of an odd base modulo 2^64, and of its inverse."""
    of = lambda base: np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)], dtype=np.uint64)
    return of(_BASE), of(pow(_BASE, -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


_BYTE = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_BASE))


def runs_of_words(said: bytes, lengths: list[int]) -> np.ndarray:
    """Hashes of all runs of so many words (what stands between blanks) of a text in UTF-8, each once."""
    raw = np.frombuffer(said, np.uint8)
    up, down = _powers(1 << (len(raw) + 1).bit_length())
    sums = np.r_[np.uint64(0), np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64)]
    blanks = np.flatnonzero(raw == 32)
    start, end = np.r_[0, blanks + 1], np.r_[blanks, len(raw)]
    out = [np.zeros(0, np.uint64)]
    for n in lengths:
        first = start[: max(0, len(start) - n + 1)]
        out.append(_mix((sums[end[n - 1 :]] - sums[first]) * down[first] + np.uint64(n)))
    return np.unique(np.concatenate(out))


def keys_of(rows: DataFrame, key: str, text: str, runs: Callable[[bytes], np.ndarray]) -> DataFrame:
    """(key column, key) for the hashes that ``runs`` finds in each text. A task holds those of one batch of texts at most HITS of them at a time."""
    kind = rows.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = lambda ids, at, found: pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(at, [len(f) for f in found]).astype(np.int64))), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], [key, "key"])
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at, found, held = [], [], 0
            for i in range(len(texts)):
                if texts[i].is_valid and len(one := runs(texts[i].as_buffer().to_pybytes())):
                    at.append(i)
                    found.append(one)
                    held += len(one)
                if held >= HITS:
                    yield told(ids, at, found)
                    at, found, held = [], [], 0
            yield told(ids, at, found)

    return rows.select(key, text).mapInArrow(work, f"{key} {kind}, key long")


def run_bits(wanted: DataFrame) -> np.ndarray:
    """A bit for each key by its low bits, as bytes on the driver: of a fixed size however many keys there are."""
    at = F.pmod("key", F.lit(RUN_BITS)) + 1
    parts = wanted.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()  # RUN_BITS / PART_BITS at most
    whole = np.zeros(RUN_BITS // 8, np.uint8)
    for r in parts:
        whole[(r["part"] - 1) * PART_BITS // 8 : r["part"] * PART_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return whole


def keyed_containment(cards: DataFrame, quotes: DataFrame) -> DataFrame:
    """containment without keys for cards and quotes of any number, by an index of words in a row.

    All words (between blanks) of a card but its first and last, which may be parts of words, stand in
    a quote that contains it. Of its runs of RUN of these words (or all of them, if fewer) the one that the
    fewest exercises have finds the candidates, and only these are tested. A card of one or two words
    has no such run: automata find these.
    """
    words = lambda text: F.split(text, " ")
    inner = F.slice(words(F.col("text")), 2, F.greatest(F.size(words(F.col("text"))) - 2, F.lit(0)))
    every = cards.filter(~falsy(F.col("text"))).withColumn("inner", inner).withColumn("n", F.least(F.size("inner"), F.lit(RUN)))
    counts = {r["n"]: (r["cards"], r["bytes"]) for r in every.groupBy("n").agg(F.count("*").alias("cards"), F.sum(F.octet_length("text")).alias("bytes")).collect()}  # RUN + 1 rows at most
    short = contained_short(every.filter("n = 0").select("card_id", "text"), quotes, *counts.get(0, (0, 0)))
    some, lengths = every.filter("n > 0"), sorted(set(counts) - {0})
    if not lengths:
        return short

    def of_card(text: bytes) -> np.ndarray:
        inner = text.split(b" ")[1:-1]
        return runs_of_words(b" ".join(inner), [min(len(inner), RUN)])

    wanted = keys_of(some, "card_id", "text", of_card)
    bits = quotes.sparkSession.sparkContext.broadcast(run_bits(wanted))

    def of_quote(text: bytes) -> np.ndarray:
        keys = runs_of_words(text, lengths)
        at = keys & np.uint64(RUN_BITS - 1)
        return keys[(bits.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]

    found = keys_of(quotes, "exercise_id", "quote", of_quote).join(wanted.select("key").distinct(), "key").distinct()
    rarest = wanted.join(found.groupBy("key").agg(F.count("*").alias("n")), "key", "left").groupBy("card_id").agg(F.min_by("key", F.coalesce("n", F.lit(0))).alias("key"))
    pairs = rarest.join(found, "key").select("card_id", "exercise_id").distinct()
    tested = pairs.join(cards.select("card_id", "text"), "card_id").join(quotes.select("exercise_id", "quote"), "exercise_id").filter(F.col("quote").contains(F.col("text")))
    return tested.groupBy("card_id", "exercise_id").agg(F.count("*").alias("hits")).unionByName(short)


#: Cards and bytes of cards that one automaton holds.
SLICE_CARDS, SLICE_BYTES = 50_000, 1 << 20
#: Hits that a task holds at a time.
HITS = 100_000


def contained_short(cards: DataFrame, quotes: DataFrame, n_cards: int, n_bytes: int) -> DataFrame:
    """card_id, exercise_id, hits of cards by automata: slices of the cards, of bounded size, are looked for all at once as each quote goes by.

    Quotes are not shuffled, and no pair is made that is not a hit; each slice is a pass over the
    quotes. ``n_cards`` and ``n_bytes`` are those of all cards.
    """
    slices = max(1, -(-n_cards // SLICE_CARDS), -(-n_bytes // SLICE_BYTES))
    spark = cards.sparkSession
    texts = cards.select("text").distinct()
    kind = quotes.schema["exercise_id"].dataType.simpleString()
    hits = spark.createDataFrame([], f"text string, exercise_id {kind}")
    for one in range(slices if n_cards else 0):
        sliced = texts.filter(F.pmod(F.xxhash64("text"), F.lit(slices)) == one).collect()  # SLICE_CARDS in expectation
        held = spark.sparkContext.broadcast([r["text"] for r in sliced])

        def found(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for text in held.value:
                automaton.add_word(text, text)
            automaton.make_automaton()
            for batch in batches:
                rows, said = [], []
                told = lambda batch, said, rows: pa.RecordBatch.from_arrays([pa.array(said, pa.string()), batch.column("exercise_id").take(pa.array(rows, pa.int64()))], ["text", "exercise_id"])
                for i, quote in enumerate(batch.column("quote")):
                    if held.value and (text := quote.as_py()):
                        inside = {text for _, text in automaton.iter(text)}
                        rows += [i] * len(inside)
                        said += inside
                    if len(rows) >= HITS:
                        yield told(batch, said, rows)
                        rows, said = [], []
                yield told(batch, said, rows)

        hits = hits.unionByName(quotes.select("exercise_id", "quote").mapInArrow(found, hits.schema))
    # hits of one exercise meet before they are counted: a task that reads quotes has hardly two of a kind, and would hold all of its own
    of_cards = cards.select("card_id", "text").join(hits, "text").repartition("exercise_id")
    return of_cards.groupBy("card_id", "exercise_id").agg(F.count("*").alias("hits"))


def verdicts(cards: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """keys, card_id, verdict (suggest, ambiguous or none), exercises, exercise_id (of the only one) for each card."""
    per = hits.groupBy(*keys, "card_id").agg(F.count("*").alias("exercises"), F.min("exercise_id").alias("exercise_id"))
    verdict = F.when(F.col("exercises").isNull(), "none").when(F.col("exercises") == 1, "suggest").otherwise("ambiguous")
    joined = cards.select(*keys, "card_id").join(per, [*keys, "card_id"], "left")
    return joined.select(*keys, "card_id", verdict.alias("verdict"), F.coalesce("exercises", F.lit(0)).cast("long").alias("exercises"), F.when(F.col("exercises") == 1, F.col("exercise_id")).alias("exercise_id"))


def suggest(lessons: DataFrame) -> DataFrame:
    """Suggestions and manual reviews of each unused card; from rows (path, lesson).

    path, ord, card_id, suggestion_id, exercise_id, evidence (field, card_side, matched_text,
    quote), reason, candidates. Row-local: a lesson's cards meet its own exercises only.
    """
    cards = F.expr("coalesce(lesson.cards, array())")
    exercises = F.filter(F.transform(F.coalesce("lesson.steps", F.array()), lambda s: s["exercise"]), lambda e: e.isNotNull())
    sides = lambda c: F.array(F.struct(F.lit("front").alias("card_side"), c["front"].alias("matched_text")), F.struct(F.lit("back").alias("card_side"), c["back"].alias("matched_text")))

    def evidence(card: Column, ex: Column) -> Column:
        found = F.flatten(
            F.transform(
                text_fields(ex),
                lambda f: F.transform(
                    F.filter(sides(card), lambda s: ~falsy(s["matched_text"]) & F.coalesce(f["quote"].contains(s["matched_text"]), F.lit(False))),
                    lambda s: F.struct(f["field"].alias("field"), s["card_side"].alias("card_side"), s["matched_text"].alias("matched_text"), f["quote"].alias("quote")),
                ),
            )
        )
        return found

    rows = lessons.select("path", F.posexplode(unused_cards(F.col("lesson"))).alias("ord", "card_id"), cards.alias("cards"), exercises.alias("exercises"))
    rows = computed(rows, card=F.element_at(F.filter("cards", lambda c: c["id"] == F.col("card_id")), -1))
    found = F.transform("exercises", lambda e: F.struct(e["id"].alias("exercise_id"), evidence(F.col("card"), e).alias("evidence")))
    rows = computed(rows, found=F.filter(found, lambda f: F.size(f["evidence"]) > 0))
    n = F.size("found")
    only = F.col("found")[0]
    return rows.select(
        "path",
        "ord",
        "card_id",
        F.when(n == 1, F.concat("card_id", F.lit(":"), only["exercise_id"])).alias("suggestion_id"),
        F.when(n == 1, only["exercise_id"]).alias("exercise_id"),
        F.when(n == 1, only["evidence"]).alias("evidence"),
        F.when(n == 0, F.lit(NO_MATCH)).when(n > 1, F.concat(F.lit("ambiguous: verbatim match in "), n.cast("string"), F.lit(" exercises - pick one manually"))).alias("reason"),
        F.when(n > 1, F.transform("found", lambda f: f["exercise_id"])).alias("candidates"),
    )


def wiring_edits(lesson: Column, added: Column) -> Column:
    """What wiring changes in the raw text, from the array ``added`` of (exercise_id, card_id): an edit for each exercise that gets cards."""

    def one(s: Column, i: Column) -> Column:
        ex = s["exercise"]
        new = F.transform(F.filter(added, lambda a: a["exercise_id"] == ex["id"]), lambda a: a["card_id"])
        return F.when(ex.isNotNull() & (F.size(new) > 0), edit(i, F.struct(F.concat(array_of(ex["card_ids"]), new).alias("card_ids"))))

    return F.array_compact(F.transform(F.coalesce(lesson["steps"], F.array()), one))


def apply_suggestions(lessons: DataFrame, suggestions: DataFrame, accepted: DataFrame) -> DataFrame:
    """Lessons with the accepted suggestions (path, ord, suggestion_id) wired in; from accepted (suggestion_id)."""
    some = suggestions.filter("suggestion_id IS NOT NULL").join(accepted, "suggestion_id", "left_semi")
    added = some.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("ord", "exercise_id", "card_id"))).alias("added"))

    def step(s: Column) -> Column:
        ex = s["exercise"]
        new = F.transform(F.filter("added", lambda a: a["exercise_id"] == ex["id"]), lambda a: a["card_id"])
        wired = s.withField("exercise", ex.withField("card_ids", F.concat(array_of(ex["card_ids"]), new)))
        return F.when(ex.isNotNull() & (F.size(new) > 0), wired).otherwise(s)

    done = F.when(F.col("added").isNull(), F.col("lesson")).otherwise(F.col("lesson").withField("steps", F.transform("lesson.steps", step)))
    return lessons.join(added, "path", "left").withColumn("lesson", done).withColumn("wired", F.when(F.col("added").isNull(), 0).otherwise(F.size("added"))).drop("added")


def rewired(lessons: DataFrame, suggestions: DataFrame, accepted: DataFrame) -> DataFrame:
    """path, raw of the lessons (path, raw, lesson) that accepted suggestions wire, all else as it was written."""
    some = suggestions.filter("suggestion_id IS NOT NULL").join(accepted, "suggestion_id", "left_semi")
    added = some.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("ord", "exercise_id", "card_id"))).alias("added"))
    rows = lessons.select("path", "raw", "lesson").join(added, "path")
    return rewritten(rows, wiring_edits(F.col("lesson"), F.col("added"))).drop("added")


def unmatched(accepted: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Accepted ids that no suggestion has: an error of the caller."""
    return accepted.join(suggestions.select("suggestion_id"), "suggestion_id", "left_anti")
