"""Progress events of jobs into a log and a table of each job's latest status, from a stream.

Every micro-batch writes its rows to a folder named by the batch's number, which a
replayed batch overwrites, and merges its latest statuses into a table of versions, whose
manifest remembers the last batch that was applied. So a batch that runs twice, in part
or whole, leaves what it leaves when it runs once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshots import Snapshots


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key: an aggregate, combined before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_x")).select(key, "_x.*")


def sink(path: str, key: str, order: list[str], buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends to {path}/log and keeps {path}/status."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = f"{path}/log/batch={number}"
        batch.write.mode("overwrite").parquet(at)
        rows = spark.read.schema(batch.schema).parquet(at)
        status = Snapshots(spark, f"{path}/status")
        if not status.versions():
            status.create(rows.limit(0), [key], buckets)
        status.merge(latest(rows, key, order), lambda old, new: latest(old.unionByName(new), key, order), applied={"batch": number})

    return write


def follow(events: DataFrame, path: str, key: str, order: list[str], checkpoint: str, buckets: int = 16):
    """Takes what is there now; the query that does."""
    writer = events.writeStream.foreachBatch(sink(path, key, order, buckets)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/log")


def status(spark: SparkSession, path: str) -> DataFrame:
    return Snapshots(spark, f"{path}/status").read()
