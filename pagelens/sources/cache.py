"""A result cache with a time to live: one row for each key, the last writer's.

The cache is a table of versions in buckets of the key's hash. Writing rewrites the
buckets of the keys that are written and leaves out what has expired there, so rows don't
pile up, and readers see a version whole while it happens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_folder
from .snapshots import Snapshots

PLACE = ["region", "provider"]
#: Rows that a new cache has in a bucket, and a task in its memory.
HELD = 1 << 18


def spread(rows: DataFrame, path: str, *by: str) -> DataFrame:
    """The rows dealt by columns to as many tasks as the cache has buckets, so that a task's share stays the same when the cache is made for more rows."""
    return rows.repartition(Snapshots(rows.sparkSession, path).manifest()["n"], *by)


def still_valid(fetched_at: Column, now: Column, ttl_hours: float) -> Column:
    """Not older than the limit; an unreadable time is never valid."""
    return F.coalesce(fetched_at.try_cast("timestamp") >= now - F.make_dt_interval(hours=F.lit(int(ttl_hours)), secs=F.lit(round((ttl_hours % 1) * 3600, 6))), F.lit(False))


def read_cache(spark: SparkSession, path: str, now: Column, ttl_hours: float) -> DataFrame:
    """The rows that are still valid."""
    return Snapshots(spark, path).read().where(still_valid(F.col("fetched_at"), now, ttl_hours))


def write_cache(payloads: DataFrame, path: str, keys: list[str], now: Column | None = None, ttl_hours: float = 24.0, buckets: int | None = None) -> None:
    """Rows take the place of those with their keys, region and provider; of several with one key the latest stays. With ``now``, expired rows of the same buckets go.

    payloads: keys, region, provider, fetched_at, and more. buckets: of a new cache, 16 at least and one for each HELD payloads if it isn't said.
    """
    every = [*keys, *PLACE]
    rest = [c for c in payloads.columns if c not in every]
    table = Snapshots(payloads.sparkSession, path)
    if not table.versions():
        table.create(payloads.limit(0), every, buckets or max(16, -(-payloads.count() // HELD)))
    last = spread(payloads, path, *every).groupBy(*every).agg(F.max_by(F.struct(*rest), "fetched_at").alias("_x"), F.first(F.struct(*rest)).alias("_y"))
    rows = last.select(*every, F.coalesce("_x", "_y").alias("_x")).select(*every, "_x.*").select(*payloads.columns)

    def combine(old: DataFrame, new: DataFrame) -> DataFrame:
        kept = old if now is None else old.where(still_valid(F.col("fetched_at"), now, ttl_hours))
        return spread(kept, path, *every).join(new.select(*every), every, "left_anti").unionByName(new)

    table.merge(rows, combine)


def lookup(requests: DataFrame, cached: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Hits and misses."""
    return requests.join(cached, keys), requests.join(cached, keys, "left_anti")


def search(requests: DataFrame, path: str, source: DataFrame, keys: list[str], now: Column, ttl_hours: float) -> DataFrame:
    """requests with payload: from the cache where it is fresh, else from the source, whose rows then take the expired ones' place.

    requests: keys, region, provider. source: keys, payload. What is fetched is written
    to a folder of this call's own first, so that the source is asked once.
    """
    spark = requests.sparkSession
    cached = read_cache(spark, path, now, ttl_hours).select(*keys, *PLACE, "payload", "fetched_at")
    every = [*keys, *PLACE]
    hits, misses = lookup(spread(requests.select(*every), path, *every), spread(cached, path, *every), every)
    stamp = F.date_format(now, "yyyy-MM-dd HH:mm:ss")
    found = spread(misses.distinct(), path, *keys).join(spread(source.select(*keys, "payload"), path, *keys), keys)
    fetched = found.select(*every, "payload", stamp.alias("fetched_at"))
    fresh = f"{shared_folder(spark)}/fetched"
    fetched.write.parquet(fresh)
    fetched = spark.read.schema(fetched.schema).parquet(fresh)
    write_cache(fetched, path, keys, now, ttl_hours)
    return hits.unionByName(misses.join(spread(fetched, path, *every), every))
