"""Ranked lexical search in three phases over term-partitioned postings (TPUT).

A document's score for an item sums weight x impact over the item's distinct terms.
Weights and impacts aren't negative, so a partial sum is a lower bound.

0. ``postings``: one pass over the texts gives the postings of the items' terms and the
   length of each document; with the corpus's counts they become impacts. Lists are
   written by ranges of (term, impact), highest first, so a frequent term's list spreads
   over many tasks.
1. ``list_heads``: the first k entries of every list. An item's partial sums over its
   heads give its first lower bound, the k-th highest; whole scores of the documents with
   the highest sums, looked up, give a better one, the floor.
2. ``candidates``: the first bound over the item's number of lists is one threshold for
   all its lists. Entries that reach it are fetched and dealt by document. A document's
   fetched entries are its lower bound; every list not seen adds at most the lesser of
   the threshold and the list's own highest entry. Documents whose upper bound is under
   the floor, or the k-th highest lower bound, can't be among the k best; a task applies
   the k-th of its own documents, which is no higher than that of all, before anything is
   sent. The threshold comes from the lower of both bounds, since what isn't seen then
   adds less, and the floor keeps what is sent from growing with the number of tasks.
3. ``exact``: the candidates' entries of all lists are looked up, and the k best of
   each item are ranked.

Items are handled in groups of LISTS lists (item, term) at most; a group's lists, its
terms' weights and a bound for each item are what is broadcast or sent to the driver.

Defined results: terms that no document holds count nothing; a null text (of a document
or an item) has no terms; items that share an item_id are one item, a null item_id is an
item of its own; rows that repeat a doc_id are documents of their own, a null doc_id
comes before all others; documents of equal scores come by doc_id, then by a hash of the
row; texts of any length are read whole; extra columns are not read; an empty table gives
no rows. An item without a matching document has no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, in_blocks, ints, numbered, terms, terms_col, thrifty, utf8, workers_find_us

BEST = 50
#: Lists (item, term) of a group of items.
LISTS = 500_000
#: Candidates that are broadcast, some 24 MB; more are joined.
CANDIDATES = 1_000_000
BLOCK_BYTES = 4 << 20
#: Cells of a block's table of sums, documents by items.
CELLS = 1 << 21
#: Times k documents of an item are looked up for its floor.
PROBES = 4
#: Candidates that a task holds back.
KEPT = 200_000


@dataclass
class Lists:
    """A group of items: for each list its item's number, its term's number and weight, ordered by term."""

    items: list
    words: list[bytes]
    item: np.ndarray
    term: np.ndarray
    weight: np.ndarray

    def starts(self) -> np.ndarray:
        """Where each term's lists begin."""
        return np.searchsorted(self.term, np.arange(len(self.words) + 1))


def item_lists(items: DataFrame) -> DataFrame:
    """item_id, term, each pair once."""
    return items.select("item_id", F.explode(F.array_distinct(terms_col(F.col("text").cast("string")))).alias("term")).distinct()


def _group(lists: DataFrame) -> Lists:
    rows = lists.collect()  # LISTS at most
    items = sorted({r.item_id for r in rows}, key=lambda x: (x is not None, x))
    words = sorted({r.term for r in rows})
    of_item, of_word = {x: i for i, x in enumerate(items)}, {x: i for i, x in enumerate(words)}
    pairs = sorted((of_word[r.term], of_item[r.item_id]) for r in rows)
    term, item = (np.array(c, np.int64) for c in zip(*pairs))
    return Lists(items, [w.encode() for w in words], item, term, np.zeros(len(pairs), np.int64))


def counted(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """doc_id, _k, size, term, tf: a row for each of the words in a document, and one of term -1 for each document with a term."""
    workers_find_us(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, width = known.value.get, len(known.value) + 1
        for b in batches:
            texts, doc_ids, ks = utf8(b, "text"), np.array(ints(b, "doc_id"), object), np.array(ints(b, "_k"), np.int64)
            for lo, hi in in_blocks(texts, len, BLOCK_BYTES):
                flat, sizes, hits = [], [], []
                for t in texts[lo:hi]:
                    found = terms(t)
                    own = [i for i in map(get, found) if i is not None]
                    sizes.append(len(found))
                    hits.append(len(own))
                    flat += own
                size = np.array(sizes, np.int64)
                doc = np.repeat(np.arange(hi - lo), hits)
                cell, tf = np.unique(doc * width + np.array(flat, np.int64), return_counts=True)
                there = np.flatnonzero(size)
                at = np.concatenate([there, cell // width])
                term = np.concatenate([np.full(len(there), -1), cell % width])
                tf = np.concatenate([size[there], tf])
                cols = [pa.array(doc_ids[lo:hi][at], pa.int64()), pa.array(ks[lo:hi][at]), pa.array(size[at]), pa.array(term, pa.int32()), pa.array(tf, pa.int64())]
                yield pa.record_batch(cols, ["doc_id", "_k", "size", "term", "tf"])

    return docs.select("doc_id", "_k", "text").mapInArrow(thrifty(run), "doc_id long, _k long, size long, term int, tf long")


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def postings(found: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """term, doc_id, _k, impact, in ranges of (term, impact), highest first. The divisions round down, and nothing is negative."""
    norm = f"(50 + (50 * size * {n_docs}L) div {n_terms}L)"
    lists = found.where("term >= 0").selectExpr("term", "doc_id", "_k", f"(1000000000 * tf) div (1000 * tf + 20 * {norm}) as impact")
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lists.repartitionByRange(parts, "term", F.desc("impact"), "doc_id").sortWithinPartitions("term", F.desc("impact"))


def list_heads(lists: DataFrame, k: int) -> DataFrame:
    """The first k entries of each list; tasks cut theirs to k before the shuffle."""
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact"), "doc_id", "_k"))
    return lists.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def kth(sums: DataFrame, k: int, value: str) -> DataFrame:
    """item, bound: the k-th highest value of each item that has so many."""
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc(value)))
    return sums.select("item", value).withColumn("_place", place).where(F.col("_place") <= k).where(F.col("_place") == k).select("item", F.col(value).alias("bound"))


def _by_item(rows: DataFrame, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for r in rows.collect():  # a row for each item of the group
        out[r.item] = r.bound
    return out


def candidates(lists: DataFrame, group: Lists, bound: np.ndarray, floor: np.ndarray, highest: np.ndarray, k: int) -> DataFrame:
    """item, doc_id, _k, low, high: the documents that may be among the k best of an item, by what their own task has seen."""
    n_items, starts = len(group.items), group.starts()
    own_lists = np.bincount(group.item, minlength=n_items)
    # An entry is fetched if entry * lists >= bound; any other is at most ``less``.
    less = np.maximum(bound - 1, 0) // np.maximum(own_lists, 1)
    cut = less[group.item] + 1
    least = -(-cut // np.maximum(group.weight, 1))  # impact that reaches the threshold of the list
    unseen = np.minimum(less[group.item], group.weight * highest[group.term])
    all_unseen = np.bincount(group.item, weights=unseen, minlength=n_items)
    lowest = np.full(len(group.words), np.iinfo(np.int64).max)
    np.minimum.at(lowest, group.term, np.where(group.weight > 0, least, np.iinfo(np.int64).max))
    spark = lists.sparkSession
    cuts = spark.createDataFrame(pa.table({"_t": pa.array(range(len(lowest)), pa.int32()), "_cut": pa.array(lowest)}))
    fetched = lists.join(F.broadcast(cuts), (F.col("term") == F.col("_t")) & (F.col("impact") >= F.col("_cut"))).select("doc_id", "_k", "term", "impact")
    shared = spark.sparkContext.broadcast((group.item, group.weight, least, unseen, starts, np.maximum(bound, floor), all_unseen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, weight, least, unseen, starts, floor, all_unseen = shared.value
        best = np.zeros((n_items, k), np.int64)  # the highest sums so far
        most = max(CELLS // max(n_items, 1), 1)
        kept: list[tuple] = []  # candidates that aren't sent yet, since later documents may rule them out
        n_kept = 0

        def still() -> tuple:
            cols = [np.concatenate(c) for c in zip(*kept)]
            may = cols[4] >= np.maximum(floor, best.min(axis=1))[cols[0]]
            return tuple(c[may] for c in cols)

        def batch(cols: tuple) -> pa.RecordBatch:
            i, doc_ids, ks, low, high = cols
            return pa.record_batch([pa.array(i, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(ks, pa.int64()), pa.array(low), pa.array(high)], ["item", "doc_id", "_k", "low", "high"])

        def sums(doc_ids: np.ndarray, ks: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n: int) -> tuple:
            times = starts[term + 1] - starts[term]
            at = np.repeat(np.arange(len(term)), times)
            one = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(starts[term], times)
            reach = impact[at] >= least[one]
            at, one = at[reach], one[reach]
            cell = doc[at] * n_items + item[one]
            low = np.bincount(cell, weights=impact[at] * weight[one], minlength=n * n_items)  # whole numbers below 2^53
            high = low + np.tile(all_unseen, n) - np.bincount(cell, weights=unseen[one], minlength=n * n_items)
            low, high = low.astype(np.int64).reshape(n, n_items), high.astype(np.int64).reshape(n, n_items)
            both = np.concatenate([best, low.T], axis=1)
            best[:] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            d, i = np.nonzero((low > 0) & (high >= np.maximum(floor, best.min(axis=1))))
            return i, doc_ids[d], ks[d], low[d, i], high[d, i]

        held: list[tuple] = []  # columns of the documents that aren't summed yet; a document's rows are neighbours
        for b in _then_none(batches):
            if b is not None:
                null = np.array(b.column(0).is_null())
                held.append((np.array(b.column(0).fill_null(0)), null, *(np.array(b.column(i)).astype(np.int64) for i in (1, 2, 3))))
            if not held:
                continue
            ids, null, ks, term, impact = (np.concatenate(c) for c in zip(*held))
            new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (null[1:] != null[:-1]) | (ks[1:] != ks[:-1])])
            first = np.flatnonzero(new)
            ends = np.append(first[1:], len(ids))
            whole = len(first) if b is None else len(first) - 1  # the last document may go on
            for lo in range(0, whole, most):
                hi = min(lo + most, whole)
                a, z = first[lo], ends[hi - 1]
                names = np.where(null[first[lo:hi]], None, ids[first[lo:hi]].astype(object))
                doc = np.repeat(np.arange(hi - lo), ends[lo:hi] - first[lo:hi])
                kept.append(sums(names, ks[first[lo:hi]], doc, term[a:z], impact[a:z], hi - lo))
                n_kept += len(kept[-1][0])
                if n_kept > KEPT:
                    kept[:] = [still()]
                    n_kept = len(kept[0][0])
                    if n_kept > KEPT // 2:
                        yield batch(kept.pop())
                        n_kept = 0
            rest = ends[whole - 1] if whole else 0
            held = [(ids[rest:], null[rest:], ks[rest:], term[rest:], impact[rest:])] if rest < len(ids) else []
        if kept:
            yield batch(still())

    dealt = fetched.repartition("doc_id", "_k").sortWithinPartitions("doc_id", "_k")
    return dealt.mapInArrow(thrifty(run), "item int, doc_id long, _k long, low long, high long")


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def exact(lists: DataFrame, chosen: DataFrame, group: Lists) -> DataFrame:
    """item, doc_id, _k, score: looked up in all lists, for the chosen pairs (item, doc_id, _k); pairs without an entry are left out."""
    of = _lists_frame(lists.sparkSession, group).where("weight > 0")
    pairs = chosen.select("item", F.col("doc_id").alias("_d"), F.col("_k").alias("_r"))
    pairs = F.broadcast(pairs) if chosen.count() <= CANDIDATES else pairs
    entries = lists.join(pairs, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_k") == F.col("_r")))
    entries = entries.join(F.broadcast(of), (F.col("item") == F.col("_i")) & (F.col("term") == F.col("_t")))
    return entries.groupBy("item", "doc_id", "_k").agg(F.sum(F.col("weight") * F.col("impact")).alias("score")).where("score > 0")


def _lists_frame(spark: SparkSession, group: Lists) -> DataFrame:
    return spark.createDataFrame(pa.table({"_i": pa.array(group.item, pa.int32()), "_t": pa.array(group.term, pa.int32()), "weight": pa.array(group.weight)}))


def best_of(rows: DataFrame, k: int, value: str) -> DataFrame:
    """The k rows of highest value of each item, with their rank; ties by doc_id, then by _k."""
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc(value), "doc_id", "_k"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def _search(docs: DataFrame, lists_of: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    spark = docs.sparkSession
    group = _group(lists_of)
    found = scratch.put(counted(docs, group.words), "counted")
    n_docs, n_terms = found.where("term = -1").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    df = np.zeros(len(group.words), np.int64)
    for r in found.where("term >= 0").groupBy("term").count().collect():  # a row for each term of the group
        df[r.term] = r["count"]
    group.weight = np.array([term_weight(n_docs, n) if n else 0 for n in df.tolist()], np.int64)[group.term]
    lists = scratch.put(postings(found, n_docs, max(n_terms, 1)), "postings")
    scratch.drop(found)
    heads = scratch.put(list_heads(lists, k), "heads")
    highest = np.zeros(len(group.words), np.int64)
    for r in heads.groupBy("term").agg(F.max("impact").alias("top")).collect():
        highest[r.term] = r.top
    of = _lists_frame(spark, group).withColumnRenamed("_i", "item")
    partial = heads.join(F.broadcast(of), F.col("term") == F.col("_t")).groupBy("item", "doc_id", "_k").agg(F.sum(F.col("weight") * F.col("impact")).alias("low"))
    known = scratch.put(best_of(partial, PROBES * k, "low"), "known")
    bound = _by_item(known.where(F.col("rank") == k).select("item", F.col("low").alias("bound")), len(group.items))
    floor = _by_item(kth(exact(lists, known, group), k, "score"), len(group.items))
    chosen = scratch.put(candidates(lists, group, bound, floor, highest, k), "candidates")
    bounds = kth(chosen, k, "low").select(F.col("item").alias("_i"), "bound")
    chosen = scratch.put(chosen.join(F.broadcast(bounds), F.col("item") == F.col("_i"), "left").where("bound is null or high >= bound"), "chosen")
    out = best_of(exact(lists, chosen, group), k, "score")
    names = spark.createDataFrame(pa.table({"_i": pa.array(range(len(group.items)), pa.int32()), "item_id": pa.array(group.items, pa.int64())}))
    return out.join(F.broadcast(names), F.col("item") == F.col("_i")).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = BEST, at_once: int = LISTS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item. items: item_id, text."""
    scratch = Scratch(docs.sparkSession)
    lists = scratch.put(item_lists(items.select(F.col("item_id").cast("long").alias("item_id"), "text")), "lists")
    groups = -(-lists.count() // at_once)
    own = numbered(docs).select("doc_id", "_k", "text")
    number = F.pmod(F.xxhash64("item_id"), F.lit(max(groups, 1)))
    out = None
    for g in range(groups):
        part = lists.where(number == g)
        if not part.isEmpty():
            found = _search(own, part, k, scratch)
            out = found if out is None else out.unionAll(found)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
