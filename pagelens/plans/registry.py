"""Where queries and their SQL twins meet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers fn(load) under its name, where load(name) reads a table."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda name: table(spark, sf_dir, name))

        run.__doc__ = fn.__doc__
        QUERIES[fn.__name__] = run
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def streamed(load, name: str) -> DataFrame:
    """The table as a stream of its files."""
    at = load(name)
    folder = at.inputFiles()[0].rpartition(f"/{name}.parquet")[0]
    # As a pattern, the path may be a file or a folder of files.
    return at.sparkSession.readStream.schema(at.schema).parquet(f"{folder}/[{name[0]}]{name[1:]}.parquet")
