"""Substring dedup by hashing the sentences of re-flowed paragraphs.

A text is split into units: a unit ends with white space after one of ``.!?``, at a
blank line, or with the text. A line end inside a sentence is white space like any
other, so a passage has the same units however it is wrapped, and units joined give
the text back. A unit is normalised (A-Z lowered, runs of white space joined,
trimmed) and digested to 128 bits; units without a word never count. Over all
documents the occurrence of lowest (doc_id, row, position) of each digest is the
first; every other one repeats it.

Repeats are removed in runs: neighbouring repeated units go if they hold RUN_WORDS
words or more together, so a passage goes whole, while a short sentence that happens
to be said elsewhere stays. A first occurrence is never removed. Removed spans have
code point offsets of the original text.

Defined results: a null text is empty and has no units; rows that repeat a doc_id
rank by a hash of the row (of equal rows one is first); rows of null doc_id rank
after all others, by that hash; texts of any length take time linear in
it; extra columns are not read; an empty table gives no rows.

The digest table holds one row for each digest and task before the shuffle, so a
unit that many documents share costs no more than a rare one, and its join with
the occurrences is one that adaptive execution can split.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ints, numbered, thrifty, workers_find_us

#: Words that a run of repeated units needs to be removed.
RUN_WORDS = 20
_BORDER = re.compile(r"[.!?][\x20\x09-\x0D]+|\n[\x20\x09\x0B-\x0D]*\n[\x20\x09-\x0D]*")


def split(text: str) -> list[tuple[int, int]]:
    """Start and end of each unit; together they are the text."""
    ends = [m.end() for m in _BORDER.finditer(text)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return list(zip([0, *ends], ends))


def _words(unit: str) -> list[bytes]:
    return unit.encode().lower().split()


def units(docs: DataFrame) -> DataFrame:
    """digest, doc_id, _k, pos of each unit with a word. docs: doc_id, _k, text."""
    workers_find_us(docs.sparkSession)
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["digest", "doc_id", "_k", "pos"])

        rows: list[tuple] = []
        for b in batches:
            for d, k, t in zip(ints(b, "doc_id"), ints(b, "_k"), ints(b, "text")):
                t = t or ""
                for pos, (a, z) in enumerate(split(t)):
                    if words := _words(t[a:z]):
                        rows.append((hashlib.blake2b(b" ".join(words), digest_size=16).digest(), d, k, pos))
                        if len(rows) >= 20_000:
                            yield flush()
                            rows = []
        if rows:
            yield flush()

    return docs.select("doc_id", "_k", "text").mapInArrow(thrifty(run), "digest binary, doc_id long, _k long, pos long")


def repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, _k, again array<long>: the positions of units that repeat an earlier one, of rows that have any."""
    found = scratch.put(units(docs), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_k", "pos")
    first = found.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    # Written, so that the join deals both sides afresh and a hot digest can be split.
    first = scratch.put(first, "first")
    later = found.join(first, "digest").where(rank != F.col("first"))
    again = scratch.put(later.groupBy("doc_id", "_k").agg(F.array_sort(F.collect_list("pos")).alias("again")), "again")
    scratch.drop(found, first)
    return again


def runs(sizes: list[int], again: set[int], least: int) -> list[tuple[int, int]]:
    """First and last unit of each run of repeated units with ``least`` words in all; units without words neither end nor begin one."""
    out, start, last, total = [], None, None, 0
    for i, n in enumerate([*sizes, 1]):
        if i in again:
            start = i if start is None else start
            last, total = i, total + n
        elif n and start is not None:
            if total >= least:
                out.append((start, last))
            start, total = None, 0
    return out


def dedup(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, text, kept_text, n_units, n_removed (units), removed array<struct<start, end>>: a row for each row of docs."""
    scratch = Scratch(docs.sparkSession)
    own = numbered(docs).select("doc_id", "_k", "text")
    again = repeats(own, scratch).select(F.col("doc_id").alias("_d"), F.col("_k").alias("_r"), "again")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, 500) for x in batches for i in range(0, x.num_rows, 500)):
            kept, n_units, n_removed, removed = [], [], [], []
            for t, gone in zip(ints(b, "text"), ints(b, "again")):
                t = t or ""
                at = split(t)
                found = runs([len(_words(t[a:z])) for a, z in at], set(gone), run_words) if gone else []
                spans = [(at[x][0], at[y][1]) for x, y in found]
                edges = [0, *(e for s in spans for e in s), len(t)]
                kept.append("".join(t[a:z] for a, z in zip(edges[::2], edges[1::2])))
                n_units.append(len(at))
                n_removed.append(sum(y - x + 1 for x, y in found))
                removed.append([{"start": a, "end": z} for a, z in spans])
            yield pa.record_batch(
                [pa.array(ints(b, "doc_id"), pa.int64()), pa.array(ints(b, "text"), pa.string()), pa.array(kept, pa.string()), pa.array(n_units, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, span)],
                ["doc_id", "text", "kept_text", "n_units", "n_removed", "removed"],
            )

    joined = own.join(again, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_k") == F.col("_r")), "left").select("doc_id", "text", "again")
    return joined.mapInArrow(thrifty(run), "doc_id long, text string, kept_text string, n_units long, n_removed long, removed array<struct<start:bigint,end:bigint>>")
