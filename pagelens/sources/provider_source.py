"""Stored provider replies as a data source: spark.read.format("provider_replies").load(path).

Replies lie under provider=/region=/bucket= folders as lines of JSON, where the bucket is
the keyword's hash. Filters that compare provider, region or keyword with values are taken
over by the source: folders that can't hold an answer aren't opened, and of the files
that are, other keywords' lines aren't parsed. Results come as rows in the reply's order.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from .shared import workers_find_us

NAME = "provider_replies"
SCHEMA = "keyword string, provider string, region string, ord int, url string, title string, snippet string"
# The field of a provider's reply that holds its results.
FIELDS = {"serper": "organic", "google_cse": "items"}
BUCKETS = 64
#: Bytes of files that a task reads.
TASK_BYTES = 64 << 20
BATCH_ROWS = 10_000


def bucket_of(keyword: str, buckets: int) -> int:
    return zlib.crc32(keyword.encode()) % buckets


def write_replies(replies: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """replies: keyword, provider, region, reply (JSON text)."""
    bucket = F.pmod(F.crc32(F.encode("keyword", "UTF-8")), F.lit(buckets)).cast("int")
    rows = replies.select("provider", "region", bucket.alias("bucket"), F.to_json(F.struct("keyword", "reply")).alias("value"))
    rows.repartition("provider", "region", "bucket").write.partitionBy("provider", "region", "bucket").text(path)


@dataclass
class Files(InputPartition):
    """(path, provider, region) of the files of one task."""

    files: list[tuple[str, str, str]]

    def __post_init__(self) -> None:
        super().__init__(0)


class RepliesReader(DataSourceReader):
    def __init__(self, path: str, buckets: int):
        self.path, self.buckets = path, buckets
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in ("keyword", "provider", "region"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f.attribute[0]
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def _may_hold(self, parts: dict[str, str]) -> bool:
        ok = all(parts.get(n) in self.wanted[n] for n in ("provider", "region") if n in self.wanted)
        keywords = self.wanted.get("keyword")
        return ok and (keywords is None or int(parts["bucket"]) in {bucket_of(k, self.buckets) for k in keywords if k is not None})

    def partitions(self) -> list[Files]:
        store, root = fs.FileSystem.from_uri(self.path)
        found = []
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            parts = dict(x.split("=", 1) for x in info.path[len(root) :].split("/") if "=" in x)
            if info.is_file and not info.base_name.startswith(("_", ".")) and {"provider", "region", "bucket"} <= parts.keys() and self._may_hold(parts):
                found.append((info.size, (info.path, parts["provider"], parts["region"])))
        tasks, held = [], 0
        for size, f in sorted(found, key=lambda x: x[1]):
            if not tasks or held + size > TASK_BYTES:
                tasks.append(Files([]))
                held = 0
            tasks[-1].files.append(f)
            held += size
        return tasks or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int32() if t == "int" else pa.string()) for n, t in (x.split() for x in SCHEMA.split(", "))])
        store, _ = fs.FileSystem.from_uri(self.path)
        keywords = self.wanted.get("keyword")
        rows: list[tuple] = []
        for path, provider, region in partition.files:
            if provider not in FIELDS:
                raise ValueError(f"unknown provider {provider!r}; there are {', '.join(sorted(FIELDS))}")
            with store.open_input_stream(path) as stream:
                for line in _lines(stream):
                    one = json.loads(line)
                    if keywords is not None and one.get("keyword") not in keywords:
                        continue
                    for ord_, r in enumerate(_results(one.get("reply"), FIELDS[provider])):
                        rows.append((one.get("keyword"), provider, region, ord_, r.get("link") or r.get("url"), r.get("title"), r.get("snippet")))
                    if len(rows) >= BATCH_ROWS:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _lines(stream) -> Iterator[bytes]:
    rest = b""
    while chunk := stream.read(1 << 20):
        *whole, rest = (rest + chunk).split(b"\n")
        yield from whole
    if rest:
        yield rest


def _results(reply: str | None, field: str) -> list[dict]:
    """The results of a reply; one that can't be read, or is another thing, has none."""
    try:
        found = json.loads(reply or "{}")
    except ValueError:
        return []
    rows = found.get(field) if isinstance(found, dict) else None
    return [r for r in rows if isinstance(r, dict)] if isinstance(rows, list) else []


class ProviderReplies(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RepliesReader:
        path = self.options.get("path")
        if not path:
            raise ValueError("load(path) names the folder of the replies")
        return RepliesReader(path, int(self.options.get("buckets", BUCKETS)))


def register(spark: SparkSession) -> None:
    workers_find_us(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ProviderReplies)
