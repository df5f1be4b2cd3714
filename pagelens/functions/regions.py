"""The regions that pages are written for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DEFAULT = "id"
# Code, label, html language, locale, how words are told apart, years added to the calendar.
REGIONS = [
    ("id", "Indonesia", "id", "id_ID", "spaced", 0),
    ("th", "Thailand", "th", "th_TH", "unspaced", 543),
]


def region_codes() -> list[str]:
    return [r[0] for r in REGIONS]


def regions(spark: SparkSession) -> DataFrame:
    """code, label, html_lang, og_locale, word_mode, year_offset: one row for each region."""
    return spark.createDataFrame(REGIONS, "code string, label string, html_lang string, og_locale string, word_mode string, year_offset int")
