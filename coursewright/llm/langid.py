"""Language identification by compression: the language whose zstandard dictionary makes a text smallest.

A dictionary is raw content: pieces of normalised text (lower case, every run of anything but
letters one blank) of a bounded sample of the language's documents, DICT_BYTES at most. The
sample is of distinct texts, and of distinct pieces from all over each of them. A text of any
length is compressed as a whole in blocks of BLOCK bytes at one level, so that the dictionary
counts throughout. Score: with bytes as code lengths, the share of the best language,
1 / sum(exp(-STEEP * (bytes - least))). A document whose margin over the second language is
narrow, less than MARGIN of its least size, is rejected: on held-out rows 99 of 100 texts of the
learned languages have margins over 0.1, random letters and other languages under 0.03.

Defined results: a null text or one without a letter is ``und``, score 0, rejected. A tie
goes to the language with more training rows, then the first by name, and is rejected. With one
language there is no margin to be narrow. A very long text is read whole, block by block. Rows that repeat
give rows that repeat; no rows, no rows; without training rows all is ``und``. Other
columns are kept out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursewright.llm.common import blocks, buffers, in_arrow, spare, texts_of

#: Bound of the sample: documents of a language in expectation, bytes of a dictionary, characters of a piece; and how
#: many times as many pieces are drawn, since many can be equal.
SAMPLE_DOCS, DICT_BYTES, PIECE, OVER = 800, 65536, 512, 4
BLOCK, LEVEL = 2048, 5
STEEP, MARGIN = 0.5, 0.03
UNDETERMINED = "und"


def normalised(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " "))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[tuple[str, bytes]]:
    """(lang, dictionary) of each non-null lang, the most frequent first.

    Texts and their pieces are drawn by hashes of what they say, at rates from the numbers of different
    texts (estimated to a few percent) and of their bytes, so that equal ones count once, however
    many there are, and ids don't matter. What comes to the driver is bounded by languages times DICT_BYTES.
    """
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    rows = known.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("text").alias("texts")).collect()  # a row a language
    counts, texts = ({r["lang"]: r[c] for r in rows} for c in ("n", "texts"))
    if not counts:
        return []
    draw = lambda *parts: F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / float(1 << 30)
    by_lang = lambda rates: F.element_at(F.create_map(*[x for lang, rate in rates.items() for x in (F.lit(lang), F.lit(min(1.0, rate)))]), F.col("lang"))
    some = known.filter(draw("text") < by_lang({lang: sample_docs / max(n, 1) for lang, n in texts.items()}))
    # a text that was drawn comes with all its copies, and is counted once
    each = some.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.max(F.octet_length("text")).alias("bytes"))
    sizes = {r["lang"]: r["bytes"] for r in each.groupBy("lang").agg(F.sum("bytes").alias("bytes")).collect()}
    if not any(sizes.values()):
        return []
    pieces = F.regexp_extract_all(normalised(F.col("text")), F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))
    rate = by_lang({lang: OVER * DICT_BYTES / max(n, 1) for lang, n in sizes.items()})
    drawn = some.filter(F.col("lang").isin(list(sizes))).select("lang", F.explode(F.filter(pieces, lambda p: draw(p, F.lit("piece")) < rate)).alias("piece")).distinct()
    before = Window.partitionBy("lang").orderBy(draw("piece", F.lit("place")), "piece")  # a few hundred rows
    fit = drawn.withColumn("end", F.sum(F.octet_length("piece") + 1).over(before)).filter((F.col("end") <= DICT_BYTES) | (F.col("end") == F.octet_length("piece") + 1))
    said = fit.groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("end", "piece"))), lambda p: p["piece"]), " ").alias("said")).collect()
    return [(r["lang"], r["said"].encode()) for r in sorted(said, key=lambda r: (-counts[r["lang"]], r["lang"])) if r["said"].strip()]


def compressors(dictionaries: list[tuple[str, bytes]]) -> list[zstandard.ZstdCompressor]:
    def one(data: bytes):
        params = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, dict_size=len(data), write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS
        )
        return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)

    return [one(data) for _, data in dictionaries]


def sizes(text: bytes, by: list[zstandard.ZstdCompressor]) -> list[int]:
    """Compressed bytes of a normalised text, for each dictionary."""
    parts = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
    return [sum(len(c.compress(p)) for p in parts) for c in by]


def decide(found: list[int], langs: list[str]) -> tuple[str, float, float]:
    """The best language, its score and its margin as a share of the least size (1 for a lone language)."""
    best = min(range(len(found)), key=lambda i: (found[i], i))
    rest = [n for i, n in enumerate(found) if i != best]
    score = 1 / (1 + float(np.exp(-STEEP * (np.array(rest, float) - found[best])).sum()))
    return langs[best], score, (min(rest) - found[best]) / found[best] if rest else 1.0


def predict(docs: DataFrame, dictionaries: list[tuple[str, bytes]], keep: list[str]) -> DataFrame:
    """The columns ``keep`` of all rows, with lang_pred, score, margin and rejected."""
    langs = [lang for lang, _ in dictionaries]
    (said,) = spare(keep, "said")
    rows = docs.select(*keep, normalised(F.col("text")).alias(said))
    fields = rows.schema.fields[:-1]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["lang_pred string", "score double", "margin double", "rejected boolean"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = compressors(dictionaries)
        for batch in blocks(batches, said):
            raw, offs = buffers(texts_of(batch.column(said)))
            whole, cuts = raw.tobytes(), offs.tolist()
            got = [
                decide(sizes(whole[a:b], by), langs) if langs and b > a else (UNDETERMINED, 0.0, 0.0)
                for a, b in zip(cuts[:-1], cuts[1:], strict=True)
            ]
            pred, score, margin = (list(x) for x in zip(*got, strict=True))
            own = [batch.column(f.name) for f in fields]
            names = [f.name for f in fields] + ["lang_pred", "score", "margin", "rejected"]
            yield pa.RecordBatch.from_arrays([*own, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array([m < MARGIN for m in margin], pa.bool_())], names)

    return in_arrow(rows, work, schema)


def accepted(docs: DataFrame, dictionaries: list[tuple[str, bytes]]) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns and no other."""
    langs, (said,) = [lang for lang, _ in dictionaries], spare(docs.columns, "said")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = compressors(dictionaries)
        for batch in blocks(batches, said):
            raw, offs = buffers(texts_of(batch.column(said)))
            whole, cuts = raw.tobytes(), offs.tolist()
            keep = [bool(langs) and b > a and decide(sizes(whole[a:b], by), langs)[2] >= MARGIN for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield batch.drop_columns([said]).filter(pa.array(keep, pa.bool_()))

    return in_arrow(docs.withColumn(said, normalised(F.col("text"))), work, docs.schema)


def held_out(docs: DataFrame, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(docs["doc_id"].cast("string")), F.lit(folds)) == fold, F.lit(False))


def query(docs: DataFrame) -> DataFrame:
    marked = docs.select("doc_id", "text", "lang", held_out(docs).alias("held_out"))
    return predict(marked, learn(marked.filter("NOT held_out")), ["doc_id", "held_out"])
