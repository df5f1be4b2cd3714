"""Mixing sources to target weights: multinomial counts for each output shard, blocks met by permuted index.

Each source's words, its documents in a fixed order, form one stream that is packed
into blocks of ``block_words``. A target of t words out of a source's s is t / s times
its blocks, in slots. The output is shards of ``shard_slots`` slots, and the source
counts of every shard are one multinomial draw; its chances are what each source still
owes. LOT shards share a quota and are drawn one after the other by one task, lots are
drawn independently, so the draw decides what a shard and a source take, while a
source's total differs from its target by the chance of one shard a lot: a standard
deviation of sqrt(lots * shard_slots * p) blocks for a source with the share p. A
source never gets more than twice its blocks; draws beyond that are drawn again among
the others.

Slot k of a source, counted over the shards, holds block perm(k mod blocks), where perm
is a pseudorandom permutation of the source's block numbers, a new one for each pass
k div blocks over the source. Blocks meet slots by an equality join on (source, block),
which gives the mix: the slots of each shard, in a pseudorandom order of their own,
with the word spans of documents that fill them. What a document gives to the mix is
counted from its slots.

The driver and every drawing task hold one row for each source (some 100 bytes, so a
million sources is the documented bound); documents, blocks, lots and slots stay tables.

Defined results: null text has size 0 and takes nothing; a null source is a source,
ordered last; an empty table, or one without words, gives no slots; rows that repeat a
doc_id, equal ones too, are separate documents; a document longer than a block spans
several; extra columns, whatever their names, stay as they are. Every draw is a
function of the seed, so reruns agree, and the order of rows or partitions has no
influence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Scratch, ints, mix, numbered, running, thrifty, utf8, with_fields, words_col, workers_find_us

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Documents that are laid out behind each other by one task.
CHUNK_DOCS = 256
BLOCK_WORDS, SHARD_SLOTS, LOT = 64, 512, 64


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Splits share * sum(sizes) by weight; a target stops at most * size, and the excess is reshared."""
    out = [0.0] * len(sizes)
    open_, left = [i for i, s in enumerate(sizes) if s > 0], share * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def _feistel(x: np.ndarray, half: int, keys: np.ndarray) -> np.ndarray:
    mask = U64((1 << half) - 1)
    a, b = x >> U64(half), x & mask
    for r in range(4):
        a, b = b, a ^ (mix(b ^ mix(keys + U64(r + 1))) & mask)
    return (a << U64(half)) | b


def permute(k: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """The place of each k under the permutation of 0..n-1 of its key: a Feistel network, walked until inside."""
    half = max(1, math.ceil(math.log2(max(n, 2)) / 2))
    out = _feistel(k.astype(U64), half, keys)
    while (far := np.flatnonzero(out >= U64(n))).size:
        out[far] = _feistel(out[far], half, keys[far])
    return out.astype(np.int64)


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, _k, source, size in words. docs: doc_id, text, _k, _row."""
    return docs.select("doc_id", "_k", F.col("_row.source").cast("string").alias("source"), F.size(words_col(F.col("text"))).cast("long").alias("size"))


def layout(sized: DataFrame) -> DataFrame:
    """Adds source_size and at, where each document begins in its source's stream.

    Documents are dealt to chunks by hash, so that a large source is many chunks; a
    chunk's place comes from the sums of those before it.
    """
    chunks = max(1, sized.count() // CHUNK_DOCS)
    own = sized.withColumn("_c", F.pmod(F.xxhash64("doc_id", "_k"), F.lit(chunks)))
    sums = running(own.groupBy("source", "_c").agg(F.sum("size").alias("_n")), "source", "_c", "_n").toDF("_s", "_d", "_before", "source_size")
    inside = Window.partitionBy("source", "_c").orderBy("doc_id", "_k").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    own = own.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_c") == F.col("_d")))
    return own.withColumn("at", F.col("_before") + F.col("_in")).drop("_s", "_c", "_d", "_in", "_before")


def plan(laid: DataFrame, weights: tuple = WEIGHTS) -> list[dict]:
    """The sources in order, with size and target: as many rows as there are sources."""
    rows = laid.groupBy("source").agg(F.sum("size").alias("n")).collect()
    rows = sorted(rows, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    got = targets([r["n"] for r in rows], [weights[i % len(weights)] for i in range(len(rows))])
    return [{"number": i, "source": r["source"], "size": r["n"], "target": t} for i, (r, t) in enumerate(zip(rows, got))]


def draw_shard(owed: np.ndarray, room: np.ndarray, slots: int, rng: np.random.Generator) -> np.ndarray:
    """Source counts of one shard: a multinomial draw by what each source owes; what finds no room is drawn again."""
    got = np.zeros(len(owed), np.int64)
    while (left := slots - int(got.sum())) > 0:
        free = room - got
        weight = np.where(free > 0, np.maximum(owed - got, 0), 0.0)
        if not weight.sum():
            weight = np.maximum(free, 0).astype(float)
            if not weight.any():
                break
        got += np.minimum(rng.multinomial(left, weight / weight.sum()), free)
    return got


def draws(spark, sources: list[dict], block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """number (of the source), lot, shard, in_lot (its slots in earlier shards of the lot), n, blocks."""
    workers_find_us(spark)
    blocks = np.array([-(-s["size"] // block_words) for s in sources], np.int64)
    need = np.array([s["target"] / s["size"] * b if b else 0.0 for s, b in zip(sources, blocks)])
    total = int(need.sum())
    shards = -(-total // shard_slots)
    lots = -(-shards // LOT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in (x for b in batches for x in ints(b, "id")):
            rng = np.random.default_rng([seed, lot])
            first, last = lot * LOT, min(lot * LOT + LOT, shards)
            begin, end = min(first * shard_slots, total), min(last * shard_slots, total)
            owed = need * ((end - begin) / total)
            room = MOST * blocks * end // total - MOST * blocks * begin // total
            taken = np.zeros(len(blocks), np.int64)
            out = []
            for shard in range(first, last):
                n = draw_shard(owed - taken, room - taken, min(shard_slots, total - shard * shard_slots), rng)
                some = np.flatnonzero(n)
                out.append(np.stack([some, np.full(len(some), lot), np.full(len(some), shard), taken[some], n[some], blocks[some]]))
                taken += n
            yield pa.record_batch([pa.array(x) for x in np.concatenate(out, axis=1)], ["number", "lot", "shard", "in_lot", "n", "blocks"])

    ids = spark.range(0, lots, 1, max(1, min(-(-lots // 8), 20_000)))
    return ids.mapInArrow(thrifty(run), "number long, lot long, shard long, in_lot long, n long, blocks long")


def slots(drawn: DataFrame, seed: int) -> DataFrame:
    """number, shard, k (the source's slots are counted over the shards), pass, block: the recipe of every output shard."""
    lots = drawn.groupBy("number", "lot").agg(F.sum("n").alias("n"))
    before = running(lots, "number", "lot", "n").select("number", "lot", "before")
    own = drawn.join(before, ["number", "lot"]).select("number", "shard", "n", "blocks", (F.col("before") + F.col("in_lot")).alias("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, 256) for x in batches for i in range(0, x.num_rows, 256)):
            number, shard, n, blocks, k = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("number", "shard", "n", "blocks", "k"))
            number, shard, blocks, start = (np.repeat(x, n) for x in (number, shard, blocks, k - (np.cumsum(n) - n)))
            k = start + np.arange(len(start))
            turn, block = k // blocks, np.empty(len(k), np.int64)
            keys = mix(turn.astype(U64) + U64(seed << 32) + (number.astype(U64) << U64(8)))
            for size in np.unique(blocks):
                own = np.flatnonzero(blocks == size)
                block[own] = permute(k[own] % size, int(size), keys[own])
            yield pa.record_batch([pa.array(x) for x in (number, shard, k, turn, block)], ["number", "shard", "k", "pass", "block"])

    return own.mapInArrow(thrifty(run), "number long, shard long, k long, pass long, block long")


def _deal(docs: DataFrame, weights: tuple, block_words: int, shard_slots: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The documents with their places and targets, and the mix. docs: numbered."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    laid = scratch.put(layout(scratch.put(sizes(docs), "sizes")), "laid")
    sources = plan(laid, weights)
    # As large as the number of sources: a literal map, never larger than the rows collected for it.
    about = spark.createDataFrame([(s["source"], s["number"], s["target"]) for s in sources], "_s string, number long, target double")
    laid = laid.join(about, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    first, last = F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words)
    spans = laid.where("size > 0").select("doc_id", "_k", "number", "source", "at", "size", F.explode(F.sequence(first, last)).alias("block"))
    start = F.greatest(F.col("block") * block_words, F.col("at"))
    end = F.least((F.col("block") + 1) * block_words, F.col("at") + F.col("size"))
    span = F.struct("at", "doc_id", "_k", (start - F.col("at")).alias("start"), (end - start).alias("length"))
    blocks = spans.select("number", "block", "source", span.alias("p")).groupBy("number", "block").agg(
        F.first("source").alias("source"), F.array_sort(F.collect_list("p")).alias("spans"), F.sum("p.length").alias("n_words")
    )
    # Written, so that the planner knows their sizes: a plan made of generated rows looks small.
    drawn = scratch.put(draws(spark, sources, block_words, shard_slots, seed), "drawn")
    own = scratch.put(slots(drawn, seed), "slots")
    # A shard holds shard_slots rows at most.
    order = Window.partitionBy("shard").orderBy(F.xxhash64("number", "k", F.lit(seed)), "number", "k")
    own = own.withColumn("slot", F.row_number().over(order).cast("long") - 1)
    mix_table = own.join(blocks, ["number", "block"]).select("shard", "slot", "number", "source", "pass", "block", "n_words", "spans")
    return laid, scratch.put(mix_table, "mix")


def mix_slots(docs: DataFrame, weights: tuple = WEIGHTS, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 7) -> DataFrame:
    """The mix: shard, slot, number (of the source), source, pass, block, n_words, spans array<struct<at, doc_id, _k, start, length>> (words of documents)."""
    return _deal(numbered(docs), weights, block_words, shard_slots, seed)[1]


def _given(mixed: DataFrame) -> DataFrame:
    """number, p<at, doc_id, _k>, pass, place (least shard and slot), piece<start, length>: a row for each span of a slot."""
    spans = mixed.select("number", "shard", "slot", "pass", F.explode("spans").alias("p"))
    return spans.select("number", "pass", F.struct("p.at", "p.doc_id", "p._k").alias("own"), F.struct("shard", "slot").alias("place"), F.struct("p.start", "p.length").alias("piece"))


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words that the mix takes from the document): a row for each row of docs."""
    laid, mixed = _deal(numbered(docs), weights, block_words, shard_slots, seed)
    taken = _given(mixed).groupBy("number", F.col("own.at").alias("at")).agg(F.sum("piece.length").alias("taken"))
    both = laid.where("size > 0").join(taken, ["number", "at"], "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    return both.unionAll(laid.where("size = 0").select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))


def mixed_documents(
    docs: DataFrame, weights: tuple = WEIGHTS, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 7, with_places: bool = False
) -> DataFrame:
    """The mix as documents: a row for each document and pass, with the text of the words that the pass takes.

    Rows are laid out by the shard and slot where the document's first block of that
    pass stands: a partition holds whole shards in the order of their slots (with_places:
    in columns shard, slot, too). They are dealt by shard and not by range, since drawing
    range borders would cut all texts twice. A document that the mix takes
    whole stays as it is, and one taken twice comes twice. Documents none of whose words
    are taken go. The original columns stay; n_chars follows the text, in its own type.
    """
    spark = docs.sparkSession
    workers_find_us(spark)
    own = numbered(docs)
    mixed = _deal(own, weights, block_words, shard_slots, seed)[1]
    pieces = _given(mixed).groupBy(F.col("own.doc_id").alias("_d"), F.col("own._k").alias("_v"), "pass").agg(F.array_sort(F.collect_list("piece")).alias("pieces"), F.min("place").alias("place"))
    joined = own.join(pieces, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_k") == F.col("_v"))).select("_row", "text", "pieces", "place")
    kept = joined.select("_row", "place", "pieces", "text").mapInArrow(thrifty(_cut), joined.select("_row", "place", F.lit("").alias("new")).schema)
    row = with_fields(F.col("_row"), docs.schema, text=F.col("new"), n_chars=F.length("new"))
    out = kept.select(row.alias("_row"), "place.shard", "place.slot").repartition("shard").sortWithinPartitions("shard", "slot")
    return out.select("_row.*", "shard", "slot") if with_places else out.select("_row.*")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the pieces; a run that begins or ends the document keeps the space around it."""
    import re

    word = re.compile(rb"[^\x20\x09-\x0D]+")
    for b in batches:
        texts = []
        for t, pieces in zip(utf8(b, "text"), ints(b, "pieces")):
            runs: list[list[int]] = []
            for x in pieces:
                if runs and runs[-1][1] == x["start"]:
                    runs[-1][1] += x["length"]
                else:
                    runs.append([x["start"], x["start"] + x["length"]])
            at = [m.span() for m in word.finditer(t)]
            texts.append(b"\n".join(t[0 if a == 0 else at[a][0] : len(t) if z == len(at) else at[z - 1][1]] for a, z in runs))
        yield pa.record_batch([*(b.column(b.schema.get_field_index(c)) for c in ("_row", "place")), pa.array([t.decode() for t in texts], pa.string())], ["_row", "place", "new"])
