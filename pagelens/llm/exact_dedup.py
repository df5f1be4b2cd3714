"""Exact dedup by an extendible-hash index on shared files.

Texts are equal when their bytes are, after lowering A-Z. A key is the first 64 bits
of a text's SHA-256.

1. ``blocks``: copies inside a block of a task are merged before anything is
   shuffled. Every row names its entry, the text itself is written once an entry.
2. ``directory``: the distinct keys are counted by their leading MAX_DEPTH bits. The
   directory starts with two buckets and doubles as long as a bucket holds more bytes
   than its capacity and more than one key; a slot of the directory is a prefix of the
   key, and a bucket that wasn't split fills several slots.
3. ``own``: entries are dealt by bucket, so each owner task reads whole ranges of
   keys, sorted by key. Entries of one key are compared byte by byte with the heads of
   its chains, and one that equals none begins a chain, so texts that collide stay apart.
4. The counts and the last row of each chain are grouped, and every row gets its
   chain's by its entry.

The directory has 2^MAX_DEPTH slots at most, 16 bytes each, whatever the input: the
capacity of a bucket grows with the input instead. A bucket is streamed, so its size
bounds no memory; a task holds one block, or the chain heads of one key. A text that a
third of all rows share reaches its owner once a block, and its rows meet the answer by
entry, which has a block's rows at most.

Defined results: a null text is empty; of equal texts the row with the largest doc_id
stays, a null doc_id comes before all others, and among rows that repeat a doc_id the
one with the largest hash of the row stays (of equal rows, any one); texts of any
length are compared whole; extra columns are not read by ``dedup`` and are returned as
they came by ``kept_documents``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ints, numbered, thrifty, utf8, workers_find_us

BLOCK_ROWS = 20_000
BLOCK_BYTES = 16 << 20
#: Bits of the key that the directory tells apart at most.
MAX_DEPTH = 20
#: Bytes of distinct texts in a bucket, or this share of all of them.
CAPACITY = 1 << 20
SHARE = 1 << 17

_ROWS = "doc_id long, _k long, digest binary, entry long, key long, text binary, n long, last_id long, last_k long"
_ENTRIES = "entry long, bucket int, key long, chain int, n long, last_id long, last_k long"


def first_bits(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def _after(doc_id: int | None, k: int) -> tuple:
    return doc_id is not None, doc_id or 0, k


def blocks(docs: DataFrame, key_of: Callable[[bytes], int] = first_bits) -> DataFrame:
    """A row for each row of docs with its entry; an entry's first row carries the text, the block's copies of it and the last of them."""
    workers_find_us(docs.sparkSession)
    schema = pa.schema([(f.split()[0], {"long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in _ROWS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        seen: dict[bytes, list] = {}
        rows: list[list] = []
        held = 0

        def flush() -> pa.RecordBatch:
            for copies in seen.values():
                copies[0][6] = len(copies)
                copies[0][7], copies[0][8] = max(((r[0], r[1]) for r in copies), key=lambda r: _after(*r))
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for b in batches:
            for d, k, t in zip(ints(b, "doc_id"), ints(b, "_k"), utf8(b, "text")):
                t = t.lower()
                if copies := seen.get(t):
                    head = copies[0]
                    copies.append(row := [d, k, head[2], head[3], None, None, None, None, None])
                else:
                    digest = hashlib.sha256(t).digest()
                    row = [d, k, digest, at, key_of(digest), t, None, None, None]
                    seen[t] = [row]
                    at += 1
                    held += len(t)
                rows.append(row)
                if len(rows) >= BLOCK_ROWS or held >= BLOCK_BYTES:
                    yield flush()
                    seen, rows, held = {}, [], 0
        if rows:
            yield flush()

    return docs.select("doc_id", "_k", "text").mapInArrow(thrifty(run), _ROWS)


def directory(entries: DataFrame, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """The bucket of each slot, and the directory's depth: a slot is a key's leading bits of that number."""
    keys = entries.groupBy("key").agg(F.max(F.octet_length("text")).alias("size"))
    slots = keys.groupBy(F.shiftrightunsigned("key", 64 - MAX_DEPTH).cast("int").alias("slot")).agg(F.count("*").alias("n"), F.sum("size").alias("size")).toPandas()
    n, size = np.zeros(1 << MAX_DEPTH, np.int64), np.zeros(1 << MAX_DEPTH, np.int64)
    n[slots["slot"]], size[slots["slot"]] = slots["n"], slots["size"]
    capacity = max(capacity, int(size.sum()) // SHARE)
    bucket, buckets = np.array([0, 1]), 2
    local = np.array([1, 1])
    for depth in range(1, MAX_DEPTH + 1):
        loads, keys_in = size.reshape(1 << depth, -1).sum(1), n.reshape(1 << depth, -1).sum(1)
        over = (local == depth) & (loads > capacity) & (keys_in > 1)
        if depth == MAX_DEPTH or not over.any():
            break
        bucket, local = np.repeat(bucket, 2), np.repeat(local, 2)
        split = np.repeat(over, 2)
        local[split] = depth + 1
        upper = np.flatnonzero(split)[1::2]  # of the two halves of a bucket one keeps its number
        bucket[upper] = buckets + np.arange(len(upper))
        buckets += len(upper)
    return bucket, depth


def own(entries: DataFrame, bucket: np.ndarray, depth: int) -> DataFrame:
    """The chain of each entry among those of its key."""
    spark = entries.sparkSession
    table = spark.createDataFrame(pa.table({"slot": pa.array(range(len(bucket)), pa.int32()), "bucket": pa.array(bucket, pa.int32())}))
    slot = F.shiftrightunsigned("key", 64 - depth).cast("int")
    dealt = entries.withColumn("slot", slot).join(F.broadcast(table), "slot").repartition("bucket").sortWithinPartitions("bucket", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heads = None, []
        for b in batches:
            chain = []
            for k, t in zip(ints(b, "key"), utf8(b, "text")):
                if k != key:
                    key, heads = k, []
                c = next((i for i, head in enumerate(heads) if head == t), len(heads))
                if c == len(heads):
                    heads.append(t)
                chain.append(c)
            take = lambda name: b.column(b.schema.get_field_index(name))
            yield pa.record_batch(
                [take("entry"), take("bucket"), take("key"), pa.array(chain, pa.int32()), take("n"), take("last_id"), take("last_k")],
                ["entry", "bucket", "key", "chain", "n", "last_id", "last_k"],
            )

    return dealt.select("entry", "bucket", "key", "text", "n", "last_id", "last_k").mapInArrow(thrifty(run), _ENTRIES)


def _answers(docs: DataFrame, key_of: Callable[[bytes], int], capacity: int) -> DataFrame:
    """doc_id, _k, digest, keep_id, keep_k, group_size: a row for each row of docs (doc_id, _k, text)."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.put(blocks(docs, key_of), "rows")
    entries = rows.where("text is not null").select("entry", "key", "text", "n", "last_id", "last_k")
    index = scratch.put(own(entries, *directory(entries, capacity)), "index")
    last = F.max(F.struct("last_id", "last_k")).alias("last")
    chains = index.groupBy("key", "chain").agg(F.sum("n").alias("group_size"), last)
    by_entry = index.select("entry", "key", "chain").join(chains, ["key", "chain"]).select("entry", "group_size", "last")
    found = rows.select("doc_id", "_k", "digest", "entry").join(by_entry, "entry")
    return found.select("doc_id", "_k", "digest", F.col("last.last_id").alias("keep_id"), F.col("last.last_k").alias("keep_k"), "group_size")


_KEPT = "doc_id <=> keep_id and _k = keep_k"


def dedup(docs: DataFrame, key_of: Callable[[bytes], int] = first_bits, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of docs."""
    found = _answers(numbered(docs).select("doc_id", "_k", "text"), key_of, capacity)
    return found.select("doc_id", "keep_id", "group_size", F.expr(_KEPT).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    own_rows = numbered(docs)
    stay = _answers(own_rows.select("doc_id", "_k", "text"), first_bits, CAPACITY).where(_KEPT).select(F.col("doc_id").alias("_d"), F.col("_k").alias("_r"))
    return own_rows.join(stay, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_k") == F.col("_r")), "left_semi").select("_row.*")
