"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def workers_find_us(spark: SparkSession) -> None:
    """Python workers import this package from where the driver did, whatever folder they start in (a cluster gets it by --py-files)."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(":")
    if _ROOT not in paths:
        env["PYTHONPATH"] = ":".join([_ROOT, *filter(None, paths)])


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a local master without that setting gets a temporary one."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[[^\]]*\])?$", sc.master):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="pagelens-")
        sc.setCheckpointDir(root)
    folder = f"{root.rstrip('/')}/pagelens-files-{uuid.uuid4().hex}"
    # A lazily returned result may read it as long as the driver runs.
    atexit.register(_delete, spark, folder)
    return folder


def _delete(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session has ended before the interpreter
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def pinned(rows: DataFrame, name: str) -> DataFrame:
    """The rows written to a new shared folder and read again: for results that several parts of a plan use."""
    at = f"{shared_folder(rows.sparkSession)}/{name}"
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def in_order(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """The rows with their place _n (from 0) in the order, and their number. Each task numbers its own range; only the ranges' sizes are summed."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # Written, since the ranges are drawn anew whenever they are worked out.
    placed = pinned(ranged.withColumn("_at", F.monotonically_increasing_id()), "in-order")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_p")).count().orderBy("_p").collect()  # a row for each partition
    begins, total = [], 0
    for r in sizes:
        begins.append((r["_p"], total))
        total += r["count"]
    offsets = rows.sparkSession.createDataFrame(begins, "_p long, _before long")
    numbered = placed.join(F.broadcast(offsets), part == F.col("_p"))
    return numbered.select(*rows.columns, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias("_n")), total
