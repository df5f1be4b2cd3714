"""A row store of whole versions: Parquet buckets of the key's hash, and one manifest a version.

A change reads the buckets it touches, writes their new contents to a folder of its own
and commits by creating the manifest of the next number, which only one writer can. A
manifest names the folder of every bucket, so a reader sees one version whole, whatever
is written meanwhile, and a commit costs the touched buckets alone.

Who finds the number taken looks at what was committed since the version they had read:
where the buckets are others, the manifest is put on top of the newer one; where they
meet, the change is worked out again from the newer version (``retries`` times, then
``Conflict``). Rows get ids by ranges: every partition counts its rows, and the next free
id stands in the manifest.

The number of buckets is set when a table is made: some hundred MB of rows each. The
manifest is as long as that number.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import in_order


class Conflict(RuntimeError):
    """Others changed the same buckets, as often as the change was tried."""


class _Files:
    """Small files of a shared folder, by Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.local = self.fs.getUri().getScheme() == "file"
        self.text = lambda p: spark.read.text(p, wholetext=True).first()[0]

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def write_new(self, path: str, text: str) -> bool:
        """Creates the whole file, or gives False if there is one: two can't both succeed."""
        draft = f"{path}.{uuid.uuid4().hex}.draft"
        out = self.fs.create(self.path(draft), False)
        out.write(text.encode())
        out.close()
        try:
            if not self.local:
                return self.fs.rename(self.path(draft), self.path(path))  # refused where the target exists
            os.link(urlparse(draft).path, urlparse(path).path)
            return True
        except FileExistsError:
            return False
        finally:
            self.delete(draft)


class Snapshots:
    """A table of versions under a path, by key."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root = spark, path.rstrip("/")
        self.files = _Files(spark, path)

    # -- reading --------------------------------------------------------------

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(f"{self.root}/versions") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        version = self.versions()[-1] if version is None else version
        return json.loads(self.files.text(f"{self.root}/versions/{version:09d}.json"))

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version))

    def _rows(self, m: dict, buckets: list[int] | None = None) -> DataFrame:
        paths = [p for b, p in m["buckets"].items() if buckets is None or int(b) in buckets]
        schema = T.StructType.fromJson(m["schema"])
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{p}" for p in paths)) if paths else self.spark.createDataFrame([], schema)

    # -- committing -----------------------------------------------------------

    def create(self, rows: DataFrame, key: list[str], buckets: int = 16, next_id: int = 1) -> None:
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])  # later rows may hold nulls
        m = {"version": 0, "key": key, "n": buckets, "schema": schema.jsonValue(), "buckets": {}, "wrote": [], "next_id": next_id, "applied": {}}
        m |= {"buckets": self._write(rows, m), "version": 1}
        if not self._claim(m):
            raise Conflict(f"{self.root} has versions already")

    def _bucket(self, m: dict) -> Column:
        return F.pmod(F.xxhash64(*m["key"]), F.lit(m["n"])).cast("int")

    def _write(self, rows: DataFrame, m: dict) -> dict[str, str]:
        """The folder of each bucket that has rows."""
        at = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_b", self._bucket(m)).repartition(m["n"], "_b").write.partitionBy("_b").parquet(f"{self.root}/{at}")
        return {n.removeprefix("_b="): f"{at}/{n}" for n in self.files.names(f"{self.root}/{at}") if n.startswith("_b=")}

    def _claim(self, m: dict) -> bool:
        return self.files.write_new(f"{self.root}/versions/{m['version']:09d}.json", json.dumps(m))

    def change(self, touched: Callable[[dict], list[int]], work: Callable[[DataFrame, dict], DataFrame], retries: int = 5, takes_ids: int = 0, applied: dict | None = None) -> int:
        """Replaces the touched buckets by work(their rows, manifest); the version committed. Both are called again after a conflict."""
        for _ in range(retries + 1):
            base = self.manifest()
            if applied and any(base["applied"].get(k, -1) >= v for k, v in applied.items()):
                return base["version"]
            wrote = touched(base)
            if not wrote and not takes_ids:
                return base["version"]
            folders = self._write(work(self._rows(base, wrote), base), base)
            on = base
            while True:
                kept = {b: p for b, p in on["buckets"].items() if int(b) not in wrote}
                new = on | {"version": on["version"] + 1, "buckets": kept | folders, "wrote": wrote, "next_id": on["next_id"] + takes_ids, "applied": on["applied"] | (applied or {})}
                if self._claim(new):
                    return new["version"]
                since = [self.manifest(v) for v in self.versions() if v > on["version"]]
                met = any(set(x["wrote"]) & set(wrote) or takes_ids and x["next_id"] != on["next_id"] or applied and x["applied"] != on["applied"] for x in since)
                if met:
                    break
                on = since[-1]
            for p in {p.rpartition("/")[0] for p in folders.values()}:
                self.files.delete(f"{self.root}/{p}")
        raise Conflict(f"gave up after {retries + 1} tries")

    def _of(self, rows: DataFrame) -> Callable[[dict], list[int]]:
        return lambda m: sorted(r[0] for r in rows.select(self._bucket(m)).distinct().collect())

    # -- changes --------------------------------------------------------------

    def merge(self, rows: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], applied: dict | None = None) -> int:
        """Touched buckets become combine(old rows, rows). applied: names and numbers, such as a stream's batch; what was applied already changes nothing."""
        return self.change(self._of(rows), lambda old, _: combine(old, rows).select(*old.columns), applied=applied)

    def upsert(self, rows: DataFrame) -> int:
        """Rows take the place of those with their key. rows: one for each key."""
        key = self.manifest()["key"]
        return self.merge(rows, lambda old, new: old.join(new.select(*key), key, "left_anti").unionByName(new))

    def delete(self, keys: DataFrame) -> int:
        key = self.manifest()["key"]
        return self.merge(keys.select(*key), lambda old, gone: old.join(gone.distinct(), key, "left_anti"))

    def update(self, where: Column, changes: dict[str, Column]) -> int:
        """Sets columns of the rows that fit; an error if none does."""

        def touched(m: dict) -> list[int]:
            found = self._of(self._rows(m).where(where))(m)
            if not found:
                raise LookupError("no row to update")
            return found

        def work(old: DataFrame, _: dict) -> DataFrame:
            return old.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in changes.items()})

        return self.change(touched, work)

    def insert(self, rows: DataFrame, id_column: str, order: list[str]) -> int:
        """New rows with the next free ids, ascending in the order; no task numbers more than its own partition."""
        placed, total = in_order(rows, order)
        numbered = lambda m: placed.withColumn(id_column, F.col("_n") + m["next_id"]).drop("_n")
        return self.change(lambda m: self._of(numbered(m))(m), lambda old, m: old.unionByName(numbered(m)), takes_ids=total)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes all but the last versions, and the folders that only they named; how many versions went. Drafts of running writers stay."""
        every = self.versions()
        gone, kept = every[:-keep], every[-keep:]
        used = {p for v in kept for p in self.manifest(v)["buckets"].values()}
        unused = {p for v in gone for p in self.manifest(v)["buckets"].values()} - used
        for v in gone:
            self.files.delete(f"{self.root}/versions/{v:09d}.json")
        for p in unused:
            self.files.delete(f"{self.root}/{p}")
        return len(gone)
