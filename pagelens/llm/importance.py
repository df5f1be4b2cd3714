"""Importance resampling toward a target distribution, over hashed n-grams.

Features are the runs of 1 to ``longest`` neighbouring words. In each block of a
partition the words get ids, the suffixes of the id sequence are sorted as far as
``longest`` words (prefix doubling), and neighbours' common prefixes give, for each
length, runs of equal n-grams: a run is hashed once, and its bucket is scattered back
to all its occurrences. A bucket's gain is the log ratio of its smoothed frequency in
the target and in the documents; a document's weight is the mean gain of its features,
and the weight plus Gumbel noise hashed from its doc_id is its score. The highest
scores are the draw, which is a draw without replacement in proportion to exp(weight).

What reaches the driver is one count and one gain for each bucket. Ranks come from a
histogram of the (integer) scores and a numbering inside each score, so nothing is
sorted in one task.

Defined results: a null or empty text has no words, weight 0 and no rank; texts of any
length are read whole; rows that repeat a doc_id share its noise and are drawn one by
one, by a hash of the row; a null doc_id has no noise: its score and rank are null and
it isn't among those the draw's size counts, though its words count; extra columns are
not read; an empty table gives no rows; without a target every gain is worked out from
zero counts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, in_blocks, ints, numbered, running, terms, thrifty, utf8, workers_find_us

BUCKETS = 10_000
LONGEST = 1
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
#: Bytes of text whose suffixes are sorted together.
BLOCK_BYTES = 8 << 20


def suffix_order(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their first ``depth`` ids; equal ones by position."""
    rank, span = ids, 1
    while span < depth:
        after = np.concatenate([rank[span:], np.zeros(min(span, len(rank)), rank.dtype)])
        rank = np.unique(rank * (rank.max(initial=0) + 1) + after, return_inverse=True)[1]
        span *= 2
    return np.argsort(rank, kind="stable")


def features(texts: list[bytes], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and bucket of every feature of the texts, and the number of words of each text."""
    number: dict[bytes, int] = {}
    flat: list[int] = []
    sizes = []
    for t in texts:
        words = terms(t)
        flat.extend([number.setdefault(w, len(number) + 1) for w in words])
        flat.append(0)  # ends a text
        sizes.append(len(words))
    ids, n_words = np.array(flat, np.int64), np.array(sizes, np.int64)
    word = [b"", *number]
    text = np.repeat(np.arange(len(texts)), n_words + 1)
    left = np.repeat(np.cumsum(n_words + 1) - 1, n_words + 1) - np.arange(len(ids))
    order = suffix_order(ids, longest)
    shared = np.zeros(len(ids), np.int64)  # words in common with the suffix before, as far as a text's end
    equal = np.ones(max(len(ids) - 1, 0), bool)
    for k in range(longest):
        a, b = order[:-1] + k, order[1:] + k
        equal &= (left[order[:-1]] > k) & (left[order[1:]] > k)
        equal &= ids[np.minimum(a, len(ids) - 1)] == ids[np.minimum(b, len(ids) - 1)]
        shared[1:] += equal
    of_text, of_bucket = [], []
    for k in range(1, longest + 1):
        whole = left[order] >= k
        at = order[whole]
        begins = shared[whole] < k
        heads = at[begins]
        if k == 1:
            grams = (word[i] for i in ids[heads].tolist())
        else:
            grams = (b" ".join(word[i] for i in flat[p : p + k]) for p in heads.tolist())
        bucket = np.fromiter((zlib.crc32(g) % buckets for g in grams), np.int64, len(heads))
        of_text.append(text[at])
        of_bucket.append(bucket[np.cumsum(begins) - 1])
    return np.concatenate(of_text), np.concatenate(of_bucket), n_words


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket, over the text column of all rows."""
    workers_find_us(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for b in batches:
            own = utf8(b, "text")
            for lo, hi in in_blocks(own, len, BLOCK_BYTES):
                counts += np.bincount(features(own[lo:hi], longest, buckets)[1], minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["bucket", "n"])

    found = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(thrifty(run), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed frequency in the target and in the source, floored."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, _k, n_words, n_features, weight. docs: doc_id, _k, text."""
    workers_find_us(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = utf8(b, "text")
            parts = []
            for lo, hi in in_blocks(own, len, BLOCK_BYTES):
                text, bucket, n_words = features(own[lo:hi], longest, len(gain))
                n = np.bincount(text, minlength=hi - lo)
                total = np.bincount(text, weights=gain[bucket], minlength=hi - lo).astype(np.int64)  # whole numbers below 2^53
                parts.append((n_words, n, np.where(n > 0, total // np.maximum(n, 1), 0)))
            cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 3
            yield pa.record_batch(
                [pa.array(ints(b, "doc_id"), pa.int64()), pa.array(ints(b, "_k"), pa.int64()), *(pa.array(c, pa.int64()) for c in cols)],
                ["doc_id", "_k", "n_words", "n_features", "weight"],
            )

    return docs.select("doc_id", "_k", "text").mapInArrow(thrifty(run), "doc_id long, _k long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def drawn(scored: DataFrame, percent: int, least_words: int, scratch: Scratch) -> DataFrame:
    """scored with a rank: the highest ``percent`` of the scores of rows with enough words, 1 first; null elsewhere."""
    counts = F.col("score").isNotNull() & (F.col("n_words") >= least_words)
    takes = percent * scored.where(counts).count() // 100
    levels = scored.where(counts).groupBy((-F.col("score")).alias("level")).count().withColumn("all", F.lit(0))
    levels = scratch.put(running(levels, "all", "level", "count", step=128).where(F.col("before") < takes).select((-F.col("level")).alias("_s"), "before"), "levels")
    lowest = levels.agg(F.min("_s")).first()[0]
    none = scored.withColumn("rank", F.lit(None).cast("long"))
    if lowest is None:
        return none
    high = counts & (F.col("score") >= lowest)
    nth = F.row_number().over(Window.partitionBy("score").orderBy("doc_id", "_k"))
    ranked = scored.where(high).join(levels, F.col("score") == F.col("_s")).withColumn("rank", F.col("before") + nth)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= takes, F.col("rank"))).select(none.columns)
    return ranked.unionAll(none.where(~F.coalesce(high, F.lit(False))))


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, _k, n_words, n_features, weight, score, rank: a row for each row of docs. target: text."""
    scratch = Scratch(docs.sparkSession)
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    own = weights(numbered(docs), gain, longest)
    scored = scratch.put(own.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    return drawn(scored, percent, least_words, scratch)


def drawn_documents(docs: DataFrame, target: DataFrame, **options: int) -> DataFrame:
    """The rows of docs that are drawn, with all their columns."""
    stay = resample(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias("_d"), F.col("_k").alias("_r"))
    return numbered(docs).join(stay, (F.col("doc_id") == F.col("_d")) & (F.col("_k") == F.col("_r")), "left_semi").select("_row.*")
