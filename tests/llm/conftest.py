import pytest

from coursewright.llm.common import documents

SF = "/root/testdata/sf0.001"

#: Columns that operators use inside, as columns of the input.
CLASHES = ["size", "score", "node", "shard", "slot", "key", "row", "text_a", "bucket", "rejected", "said", "bits", "stays", "runs", "passes", "whole", "id", "__key", "__row", "__text", "Size_"]


@pytest.fixture(scope="session")
def docs(spark):
    return documents(spark, SF).cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, and clashing columns."""
    long = " ".join(f"word{i % 997} thing{i % 13}" for i in range(30_000))
    rows = [
        (1, "eins zwei drei vier fünf sechs sieben acht", "de", "a"),
        (1, "eins zwei drei vier fünf sechs sieben acht", "de", "a"),
        (2, "eins zwei drei vier fünf sechs sieben acht", "de", None),
        (3, None, None, None),
        (None, None, "en", "b"),
        (None, "one two three", "en", "b"),
        (4, "", "en", "b"),
        (5, " \t\n", "en", ""),
        (6, long, "en", "a"),
        (7, "👍 !!! 123", "en", "a"),
        (8, "the cat sat on the mat and the dog lay by the door", "en", "b"),
        (8, "a different text with the same id as another one here", "en", "b"),
    ]
    more = ", ".join(f"{c} string" for c in CLASHES)
    filled = [(*r, len(r[1]) if r[1] is not None else None, *["x"] * len(CLASHES)) for r in rows]
    return spark.createDataFrame(filled, f"doc_id long, text string, lang string, source string, n_chars long, {more}").repartition(3).cache()
