import random

import pytest
import regex
import zstandard
from pyspark.sql import functions as F

from coursewright.llm import langid
from coursewright.llm.common import documents


def test_held_out_accuracy(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    rows = langid.query(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    out = rows[rows.held_out]
    assert len(rows) == docs.count() and 0.15 < len(out) / len(rows) < 0.35
    assert (out.lang == out.lang_pred).mean() > 0.97
    assert rows.score.between(0, 1).all()
    assert out[out.lang == out.lang_pred].score.mean() > out[out.lang != out.lang_pred].score.mean()


def test_undetermined_and_rejected(spark, docs):
    dictionaries = langid.learn(docs)
    assert sorted(lang for lang, _ in dictionaries) == ["de", "en", "es", "fr"]
    assert all(len(d) <= langid.DICT_BYTES for _, d in dictionaries)
    rows = spark.createDataFrame([(1, None), (2, "12 %% 34"), (3, "zq"), (4, docs.filter("lang = 'fr' AND n_chars > 500").first().text)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(rows, dictionaries, ["doc_id"]).collect()}
    assert [got[i].lang_pred for i in (1, 2)] == ["und", "und"] and got[1].score == 0.0
    assert got[3].rejected and not got[4].rejected and got[4].lang_pred == "fr"
    assert [r.doc_id for r in langid.accepted(rows, dictionaries).collect()] == [4]


def test_decision_counts_bytes():
    assert langid.decide([10, 8, 9], ["a", "b", "c"])[0::2] == ("b", 1 / 8)
    assert langid.decide([8, 8], ["a", "b"]) == ("a", 0.5, 0.0)
    assert langid.decide([8], ["a"]) == ("a", 1.0, 1.0)


def plain_size(text: str, dictionary: bytes) -> int:
    """Frames of plain zstandard over blocks of the normalised text, without their magic numbers."""
    said = regex.sub(r"[^\p{L}]+", " ", text.lower()).strip().encode()
    kind = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    total = 0
    for i in range(0, len(said), langid.BLOCK):
        params = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, dict_size=len(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
        total += len(zstandard.ZstdCompressor(dict_data=kind, compression_params=params).compress(said[i : i + langid.BLOCK])) - 4
    return total


def test_query_is_that_of_plain_zstandard(spark, docs):
    train = docs.select("doc_id", "text", "lang", langid.held_out(docs).alias("held_out")).filter("NOT held_out")
    dictionaries = langid.learn(train)
    got = {r.doc_id: r for r in langid.query(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        by = {lang: plain_size(r.text, data) for lang, data in dictionaries}
        least = min(by.values())
        if not least:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        assert got[r.doc_id].lang_pred == next(lang for lang, n in by.items() if n == least)
        assert got[r.doc_id].score == pytest.approx(1 / sum(2.718281828459045 ** (-langid.STEEP * (n - least)) for n in by.values()))


def test_narrow_margins_are_rejected_and_clean_texts_kept(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    odd = [" ".join(word() for _ in range(n)) for n in (20, 100, 400, 1000) for _ in range(10)]
    odd += ["questo e un testo scritto in lingua italiana che parla di molte cose diverse come il tempo e la natura", "dit is een nederlandse tekst over het weer en de natuur", "это русский текст о погоде и природе"]
    dictionaries = langid.learn(docs.filter(~langid.held_out(docs)))
    junk = langid.predict(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), dictionaries, ["doc_id"])
    assert junk.filter("rejected").count() > 0.9 * len(odd)
    clean = docs.filter(langid.held_out(docs) & F.col("lang").isNotNull() & (F.col("n_chars") > 40))
    told = langid.predict(clean, dictionaries, ["doc_id", "lang"]).toPandas()
    assert told.rejected.mean() < 0.01 and (told.lang == told.lang_pred).mean() > 0.99


def test_the_sample_is_of_distinct_pieces_from_whole_texts(spark):
    long = " ".join(f"wort{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(12_000))
    rows = [(None, long, "de")] + [(1, "immer der gleiche satz", "de")] * 500 + [(2, "one two three four", "en")]
    dictionaries = dict(langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_docs=1000))
    assert 0.7 * langid.DICT_BYTES < len(dictionaries["de"]) <= langid.DICT_BYTES and dictionaries["de"].count(b"immer der gleiche satz") <= 1
    words = [w for w in long.split() if w.encode() in dictionaries["de"]]
    assert long.index(words[-1]) > 0.9 * len(long)


@pytest.mark.parametrize("copies", [2_000, 200_000])
def test_copies_of_a_text_do_not_unlearn_a_language(spark, copies):
    random = random_words(7)
    texts = [" ".join(random() for _ in range(400)) for _ in range(500)]
    docs = spark.createDataFrame([(i, t, "de") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for hot in (texts[0], " ".join(random() for _ in range(900))):  # one that was there, and one more
        with_copies = docs.unionAll(spark.range(copies).select(F.col("id") + 1000, F.lit(hot), F.lit("de")))
        (plain,), (repeated,) = langid.learn(docs), langid.learn(with_copies)
        assert abs(len(plain[1]) - len(repeated[1])) <= 0.1 * len(plain[1])
        words = [set(d.decode().split()) for d in (plain[1], repeated[1])]
        assert len(words[0] & words[1]) > 0.7 * len(words[0])


def random_words(seed: int):
    dice = random.Random(seed)
    parts = ["un", "ver", "ge", "lich", "keit", "schaft", "haus", "berg", "wald", "zeit", "tag", "licht", "en", "er"]
    return lambda: "".join(dice.choices(parts, k=dice.randint(1, 5)))
