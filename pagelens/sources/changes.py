"""What changes in a table of versions, as a stream: spark.readStream.format("snapshot_changes").load(path).

A poll is a trigger. Each one looks for the latest version; where there is a newer one it
reads the buckets that were written since, as they stood at both versions, a task for each,
and gives the rows that are new or have other values. A poll that finds nothing new reads
one folder's names. If the version of the last poll was vacuumed, all rows come again;
rows that were deleted are not told.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .shared import workers_find_us

NAME = "snapshot_changes"


class Store:
    """The manifests of a table, read without Spark."""

    def __init__(self, path: str):
        self.fs, self.root = fs.FileSystem.from_uri(path.rstrip("/"))

    def latest(self) -> int:
        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/versions", allow_not_found=True))
        return max((int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json")), default=0)

    def manifest(self, version: int) -> dict:
        with self.fs.open_input_stream(f"{self.root}/versions/{version:09d}.json") as f:
            return json.loads(f.read())

    def rows(self, folder: str | None, schema: pa.Schema) -> pa.Table:
        if folder is None:
            return schema.empty_table()
        files = [f.path for f in self.fs.get_file_info(fs.FileSelector(f"{self.root}/{folder}")) if f.base_name.endswith(".parquet")]
        return pa.concat_tables([pq.ParquetFile(self.fs.open_input_file(f)).read().select(schema.names).cast(schema) for f in files] or [schema.empty_table()])


class Bucket(InputPartition):
    def __init__(self, before: str | None, after: str | None, version: int):
        super().__init__(0)
        self.before, self.after, self.version = before, after, version


class ChangesReader(DataSourceStreamReader):
    def __init__(self, path: str, schema: T.StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.path, self.schema = path, to_arrow_schema(schema)

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        return {"version": Store(self.path).latest()}

    def partitions(self, start: dict, end: dict) -> list[Bucket]:
        a, z, store = start["version"], end["version"], Store(self.path)
        if a == z:
            return []
        try:
            before = store.manifest(a)["buckets"] if a else {}
        except FileNotFoundError:  # vacuumed since the last poll, so nothing is known of what was seen
            before = {}
        after = store.manifest(z)["buckets"]
        # A bucket that was written has another folder.
        return [Bucket(before.get(b), after.get(b), z) for b in sorted({*before, *after}) if before.get(b) != after.get(b)]

    def read(self, partition: Bucket) -> Iterator[pa.RecordBatch]:
        store = Store(self.path)
        plain = pa.schema([f for f in self.schema if f.name != "_version"])
        old = {tuple(r.values()) for r in store.rows(partition.before, plain).to_pylist()}
        for batch in store.rows(partition.after, plain).to_batches(max_chunksize=10_000):
            fresh = [r | {"_version": partition.version} for r in batch.to_pylist() if tuple(r.values()) not in old]
            if fresh:
                yield pa.RecordBatch.from_pylist(fresh, schema=self.schema)

    def commit(self, end: dict) -> None:
        pass


class SnapshotChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        store = Store(self.options["path"])
        return T.StructType.fromJson(store.manifest(store.latest())["schema"]).add("_version", "long")

    def streamReader(self, schema: T.StructType) -> ChangesReader:
        return ChangesReader(self.options["path"], schema)


def changes(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows and _version, the one they were seen at, as a stream; the values of a row can be told apart (no maps or arrays)."""
    workers_find_us(spark)
    spark.dataSource.register(SnapshotChanges)
    return spark.readStream.format(NAME).load(path)
