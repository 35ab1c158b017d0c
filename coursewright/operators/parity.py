"""Release parity: version tags without a release page or without a published version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = r"\Av([0-9]+\.[0-9]+\.[0-9]+)\z"
#: Versions that were never published and stay so.
KNOWN_GAPS = ["0.1.0", "0.3.0", "0.10.0"]


def release_gaps(tags: DataFrame, pages: DataFrame, versions: DataFrame, gaps: list[str] = KNOWN_GAPS) -> DataFrame:
    """tag, missing ('page' or 'version'); from tags (tag), pages (tag), versions (version). Tags of another shape are left out."""
    shaped = tags.filter(F.col("tag").rlike(VERSION)).withColumn("version", F.regexp_extract("tag", VERSION, 1))
    no_page = shaped.join(pages.select("tag"), "tag", "left_anti").select("tag", F.lit("page").alias("missing"))
    unpublished = shaped.filter(~F.col("version").isin(gaps)).join(versions.select("version"), "version", "left_anti")
    return no_page.unionByName(unpublished.select("tag", F.lit("version").alias("missing")))
