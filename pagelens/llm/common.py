"""What the operators share: reading tables, scratch tables, blocks of bytes, hashes.

Words are runs of anything but U+0020 and U+0009-U+000D. ``bytes.split`` and
``bytes.lower`` treat exactly these bytes as space and exactly A-Z as upper case,
and UTF-8 never reuses those bytes inside a longer character, so the Python side
works on raw UTF-8.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_col(text: Column) -> Column:
    """Array of the words of a text; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def terms_col(text: Column) -> Column:
    """As ``terms``, of a column; null has none."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def workers_find_us(spark: SparkSession) -> None:
    """Python workers import this package from where the driver did (a cluster gets it by --py-files)."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(":")
    if _ROOT not in paths:
        env["PYTHONPATH"] = ":".join([_ROOT, *filter(None, paths)])


# -- scratch tables -----------------------------------------------------------


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where that is unset, a local master gets a temporary folder; on a cluster executors
    would not see one, so there it is an error.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        root = sc.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[[^\]]*\])?$", sc.master):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="pagelens-")
        sc.setCheckpointDir(root)
    return root


def _fs_delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to the shared folder to cut lineage.

    ``put`` writes and rereads; ``drop`` deletes one early. What is left goes when
    the driver ends, since a lazily returned result may still read it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{scratch_root(spark).rstrip('/')}/pagelens-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self.close)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        schema = df.schema
        del df
        self.collect_garbage()
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _fs_delete(self.spark, t._scratch_path)

    def collect_garbage(self) -> None:
        """Lets Spark's cleaner delete the shuffle files of plans that are done.

        They go when the driver's JVM finds them unreachable, by default after up to 30
        minutes, and would stand beside the table that replaces them until then.
        """
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def close(self) -> None:
        try:
            _fs_delete(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session has ended before the interpreter
            pass


# -- rows of the caller ---------------------------------------------------------


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text, _k, _row: (doc_id, _k) names a row, _row holds all columns as they came.

    _k is 0 where a doc_id is unique, and a hash of the row and of its number among equal
    rows where it is not, so every evaluation gives the same names; equal rows are
    interchangeable. Columns that can't be hashed (maps, say) don't count. The struct keeps
    the caller's columns from clashing with any other.
    """
    kinds = (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.StringType, T.BooleanType, T.DoubleType, T.FloatType, T.DateType, T.TimestampType, T.BinaryType)
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if isinstance(f.dataType, kinds)]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct("*").alias("_row"), F.xxhash64(*hashed).alias("_h"))
    again = own.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_d"), F.lit(True).alias("_again"))
    zero = F.lit(0).cast("long")
    if again.isEmpty():
        return own.select("doc_id", "text", zero.alias("_k"), "_row")
    marked = own.join(again, F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    alone = marked.where("_again is null").select("doc_id", "text", zero.alias("_k"), "_row")
    nth = F.row_number().over(Window.partitionBy("doc_id", "_h").orderBy(F.length("text")))
    return alone.unionAll(marked.where("_again").select("doc_id", "text", F.xxhash64("_h", nth).alias("_k"), "_row"))


def running(sums: DataFrame, key: str, index: str, value: str, step: int = 4096) -> DataFrame:
    """key, index, before (sum of value at smaller indices of the key), all_of_key: in two steps, so that no task walks all indices of a hot key."""
    own = sums.select(F.col(key).alias("_s"), F.col(index).alias("_i"), F.floor(F.col(index) / step).alias("_g"), F.col(value).alias("_x"))
    groups = own.groupBy("_s", "_g").agg(F.sum("_x").alias("_x"))
    whole = Window.partitionBy("_s")
    groups = groups.select(F.col("_s").alias("_t"), F.col("_g").alias("_f"), (F.sum("_x").over(whole.orderBy("_g")) - F.col("_x")).alias("_before"), F.sum("_x").over(whole).alias("all_of_key"))
    inside = F.sum("_x").over(Window.partitionBy("_s", "_g").orderBy("_i")) - F.col("_x")
    both = own.withColumn("_in", inside).join(groups, F.col("_s").eqNullSafe(F.col("_t")) & (F.col("_g") == F.col("_f")))
    return both.select(F.col("_s").alias(key), F.col("_i").alias(index), (F.col("_before") + F.col("_in")).alias("before"), "all_of_key")


def with_fields(row: Column, schema: T.StructType, **new: Column) -> Column:
    """The struct with some of its fields replaced, where it has them, in their own types."""
    for name, value in new.items():
        for f in schema:
            if f.name == name:
                row = row.withField(f"`{name}`", value.cast(f.dataType))
    return row


# -- raw texts in Arrow batches -------------------------------------------------


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The column's texts as UTF-8; null is empty."""
    col = batch.column(batch.schema.get_field_index(name))
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    return [x or b"" for x in col.to_pylist()]


def ints(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


#: Keeps digits, letters (A-Z lowered) and all bytes of longer characters; every other byte becomes a space.
_TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    """The maximal runs of digits, letters and characters beyond ASCII, A-Z lowered."""
    return text.translate(_TERM_BYTES).split()


def thrifty(run):
    """run, whose worker gives free memory back at the end of a task: an idle worker would keep it beside the next stage's."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not glibc
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def in_blocks(items: list, size, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring items whose sizes add up to the limit, or one larger item."""
    lo, total = 0, 0
    for i, x in enumerate(items):
        n = size(x)
        if total and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(items):
        yield lo, len(items)


# -- hashes --------------------------------------------------------------------

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def byte_table() -> np.ndarray:
    """256 fixed pseudorandom 64-bit values."""
    return mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        m = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(m, base, dtype=U64)
            p[0] = 1
            _POWERS[key] = np.cumprod(p, dtype=U64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with span_hash(P, a, b) depending on data[a:b] alone."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_TABLE[data] * up, dtype=U64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[b] - prefix[a]) * down[a])


_TABLE = byte_table()
