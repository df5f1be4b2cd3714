"""Dates as regions write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names and year offsets by region.
MONTHS = {
    "id": ["Januari", "Februari", "Maret", "April", "Mei", "Juni", "Juli", "Agustus", "September", "Oktober", "November", "Desember"],
    "th": ["มกราคม", "กุมภาพันธ์", "มีนาคม", "เมษายน", "พฤษภาคม", "มิถุนายน", "กรกฎาคม", "สิงหาคม", "กันยายน", "ตุลาคม", "พฤศจิกายน", "ธันวาคม"],
}
YEAR_OFFSET = {"id": 0, "th": 543}


def localized_date(moment: Column, region: str) -> Column:
    months = F.array(*map(F.lit, MONTHS[region]))
    return F.concat_ws(" ", F.day(moment).cast("string"), F.element_at(months, F.month(moment)), (F.year(moment) + YEAR_OFFSET[region]).cast("string"))


def iso_date(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd")


def spread_dates(today: Column, count: int, step: int = 3) -> Column:
    """today, and every ``step`` days before it."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.date_sub(today, i * step)) if count > 0 else F.array().cast("array<date>")
