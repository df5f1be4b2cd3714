"""Windows over time: sliding counts, session gaps; batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sliding_count(rows: DataFrame, key: str, ts: str, seconds: int, name: str) -> DataFrame:
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(micros).rangeBetween(-seconds * 1_000_000, 0)
    return rows.withColumn(name, F.count("*").over(w))


def sessions(rows: DataFrame, key: str, order: list[str], ts: str, gap_seconds: int) -> DataFrame:
    """Adds session: numbered from 1, a new one after a longer gap."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.lag(ts).over(w)
    fresh = before.isNull() | (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(before.cast("timestamp")) > gap_seconds * 1_000_000)
    marked = rows.withColumn("_new", F.when(fresh, 1).otherwise(0))
    return marked.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def stalls(rows: DataFrame, key: str, ts: str, limit_seconds: float) -> DataFrame:
    """The longest silence of each key, and whether it passes the limit."""
    before = F.lag(ts).over(Window.partitionBy(key).orderBy(ts))
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1e6
    return rows.withColumn("_g", gap).groupBy(key).agg(F.coalesce(F.max("_g"), F.lit(0.0)).alias("longest")).withColumn("stalled", F.col("longest") > limit_seconds)


def progress_points(rows: DataFrame, key: str, count: str, ts: str, every: int = 100, seconds: int = 20) -> DataFrame:
    """Rows at which progress is told: the first of each ``every`` items or ``seconds``."""
    w = Window.partitionBy(key).orderBy(count)
    bucket = F.struct(F.floor(F.col(count) / every).alias("n"), F.floor(F.unix_timestamp(ts) / seconds).alias("t"))
    before = F.lag(bucket).over(w)
    return rows.withColumn("_b", before.isNull() | (before != bucket)).where("_b").drop("_b")


def session_stream(events: DataFrame, key: str, ts: str, gap: str, delay: str) -> DataFrame:
    """Streaming twin of sessions, closed by the watermark."""
    return events.withWatermark(ts, delay).groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("events"))


def latest_status_stream(events: DataFrame, key: str) -> DataFrame:
    return events.groupBy(key).agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("ts"))


def polls(rows: DataFrame, key: str, ts: str, every: int = 3) -> DataFrame:
    """key, polls: looks at a fixed interval, from the first row of the key until the last is seen."""
    span = F.unix_timestamp(F.max(ts)) - F.unix_timestamp(F.min(ts))
    return rows.groupBy(key).agg((F.floor(span / every) + 1).cast("long").alias("polls"))
