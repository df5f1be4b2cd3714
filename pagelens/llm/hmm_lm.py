"""A hidden Markov language model: training by Baum-Welch over partitions, scoring by the scaled forward recursion.

States emit word classes, and a class emits its words by smoothed counts:

    P(text) = sum over state paths of prod P(state | state before) P(class | state) P(word | class)

The VOCABULARY most frequent words (ties by a hash of the word) are classes of their
own if training has LEAST of each, the end of the text is one, and every other word
belongs to one of TAIL classes by crc32. VOCABULARY is what bounds the model: states
times classes numbers are what a Baum-Welch round sums, sends to the driver and hands
to every task (1.6 MB at the default), however large the corpus. Words beyond it share the states' preference of
their class and differ by their own counts, which stay a distributed table and meet the
texts in an equality join. The README has what the vocabulary does to held-out scores.

Each Baum-Welch round reads all training tokens and sums expected counts across
partitions. Texts train and are scored whole: a text longer than SEGMENT tokens is cut
only for speed, the product of its segments' step matrices gives the exact forward and
backward vectors at every seam, and moves across seams count like any other.

Defined results: null text is empty and scores its end alone; a null doc_id counts
as the text ""; rows that repeat a doc_id, or a row, are separate texts; a text of any
length is one sequence; extra columns are not read; without training rows all counts
are 0, base_score is that of an unknown token in an empty vocabulary, and the classes
are uniform; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, in_blocks, ints, thrifty, utf8, workers_find_us

STATES = 4
ROUNDS = 3
VOCABULARY, TAIL = 50_000, 512
#: Training occurrences that a word needs for a class of its own: fewer can't tell its states.
LEAST = 8
SEGMENT = 512
_AT_ONCE = 1 << 19  # tokens that are worked on together
END = b""  # no word is empty


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


# -- counts ----------------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c over the training texts; the end of a text is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for b in batches:
            for t in utf8(b, "text"):
                counts.update(t.lower().split())
                counts[END] += 1
                if len(counts) > 300_000:
                    yield flush()
        if counts:
            yield flush()

    own = docs.where(~held_out(F.col("doc_id"))).select("text")
    return own.mapInArrow(thrifty(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def nth_smallest(values: DataFrame, n: int) -> int | None:
    """The n-th smallest (or else the largest) of the long column x, by histograms of 4,096 rows; the values must span less than 2^63."""
    lo, hi, size = values.agg(F.min("x"), F.max("x"), F.count("x")).first()
    if size <= n:
        return hi
    while lo < hi:
        width = -(-(hi - lo + 1) // 4096)
        inside = values.where(F.col("x").between(lo, hi)).select(F.expr(f"(x - {lo}L) div {width}L").alias("k"))
        for r in sorted(inside.groupBy("k").count().collect()):
            if r["count"] >= n:
                lo, hi = lo + r["k"] * width, min(hi, lo + (r["k"] + 1) * width - 1)
                break
            n -= r["count"]
    return lo


@dataclass
class Vocabulary:
    """Of bounded size: the words of their own class, most frequent first, with their counts, and sums by tail class."""

    own: dict[bytes, int]
    own_count: list[int]
    ends: int
    total: int
    distinct: int
    tail_total: list[int]
    tail_distinct: list[int]

    @classmethod
    def of(cls, counts: DataFrame, size: int = VOCABULARY, least_count: int = LEAST) -> Vocabulary:
        words = counts.where((F.length("word") > 0) & (F.col("c") >= least_count))
        least = nth_smallest(words.select((-F.col("c")).alias("x")), size)
        top: list[tuple[bytes, int]] = []
        if least is not None:
            tie = F.shiftright(F.xxhash64("word"), 2)
            above, level = words.where(F.col("c") > -least), words.where(F.col("c") == -least)
            room = size - above.count()
            last = nth_smallest(level.select(tie.alias("x")), room)
            got = above.unionAll(level.where(tie <= last)).toArrow()
            top = sorted(zip(got["word"].to_pylist(), got["c"].to_pylist()), key=lambda x: (-x[1], x[0]))
        rows = counts.groupBy((F.crc32("word") % TAIL).alias("k"), (F.length("word") == 0).alias("end")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
        total, distinct, ends = [0] * TAIL, [0] * TAIL, 0
        for r in rows:
            if r["end"]:
                ends = r["c"]
            else:
                total[r["k"]] += r["c"]
                distinct[r["k"]] += r["v"]
        everything = (sum(total) + ends, sum(distinct) + (ends > 0))
        for w, c in top:
            total[crc32(w) % TAIL] -= c
            distinct[crc32(w) % TAIL] -= 1
        return cls({w: i for i, (w, _) in enumerate(top)}, [c for _, c in top], ends, *everything, total, distinct)

    def class_of(self, word: bytes) -> int:
        """The words' own classes, the end, the tail."""
        k = self.own.get(word)
        return k if k is not None else len(self.own) + (1 + crc32(word) % TAIL if word else 0)

    def prior(self) -> np.ndarray:
        n = np.array([*self.own_count, self.ends, *self.tail_total], float) + 0.5
        return n / n.sum()


# -- Baum-Welch --------------------------------------------------------------------


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # states x classes

    @classmethod
    def initial(cls, prior: np.ndarray, states: int, seed: int = 5) -> Hmm:
        rng = np.random.default_rng(seed)
        emit = prior * (0.25 + rng.random((states, len(prior))))
        move = np.full((states, states), 0.2 / max(states - 1, 1))
        np.fill_diagonal(move, 0.8 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))

    @classmethod
    def from_counts(cls, start, move, emit, prior: np.ndarray) -> Hmm:
        norm = lambda x: x / x.sum(-1, keepdims=True)
        # Half a count for each class, dealt by the corpus' shares, as base scores add half a count for each word.
        return cls(norm(start + 0.1), norm(move + 0.1), norm(emit + 0.5 * len(prior) * prior))


class _Cut:
    """Sequences cut to segments of SEGMENT tokens at most, longest segments first."""

    def __init__(self, lengths: np.ndarray, segment: int):
        n = -(-lengths // segment)
        text = np.repeat(np.arange(len(lengths)), n)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        size = np.minimum(segment, lengths[text] - nth * segment)
        order = np.argsort(-size, kind="stable")
        self.text, self.nth, self.size = text[order], nth[order], size[order]
        self.at = (np.cumsum(lengths) - lengths)[self.text] + self.nth * segment
        self.several = n[self.text] > 1
        self.parts = int(n.max(initial=0))

    def blocks(self, which: np.ndarray) -> Iterator[np.ndarray]:
        """The segments named, in blocks that bound the memory a step takes."""
        for a, z in in_blocks(which.tolist(), lambda i: int(self.size[i]), _AT_ONCE):
            yield which[a:z]

    def alive(self, own: np.ndarray) -> np.ndarray:
        """How many of the segments reach each step."""
        return len(own) - np.searchsorted(self.size[own][::-1], np.arange(self.size[own[0]] if len(own) else 0), "right")


def _seams(hmm: Hmm, emit: np.ndarray, flat: np.ndarray, cut: _Cut) -> tuple[np.ndarray, np.ndarray]:
    """Per segment the forward vector before it and the backward vector at its last token, up to scale."""
    k = len(hmm.start)
    before, after = np.full((len(cut.size), k), 1 / k), np.ones((len(cut.size), k))
    if not cut.several.any():
        return before, after
    steps = np.zeros((len(cut.size), k, k))
    for own in cut.blocks(np.flatnonzero(cut.several)):
        m = np.broadcast_to(np.eye(k), (len(own), k, k)).copy()
        first = cut.nth[own] == 0
        for t, n in enumerate(cut.alive(own)):
            e = emit[flat[cut.at[own[:n]] + t]][:, None, :]
            step = (m[:n].reshape(-1, k) @ hmm.move).reshape(-1, k, k)
            if t == 0:
                step[first[:n]] = hmm.start
            m[:n] = step * e
            if t % 16 == 15:
                m[:n] /= m[:n].sum((1, 2), keepdims=True)
        steps[own] = m / m.sum((1, 2), keepdims=True)
    where = [np.flatnonzero(cut.several & (cut.nth == i)) for i in range(cut.parts)]
    a = np.full((int(cut.text.max()) + 1, k), 1 / k)
    for own in where:
        before[own] = a[cut.text[own]]
        x = np.einsum("ni,nij->nj", before[own], steps[own])
        a[cut.text[own]] = x / x.sum(1, keepdims=True)
    a[:] = 1
    for own in reversed(where):
        after[own] = a[cut.text[own]]
        x = np.einsum("nij,nj->ni", steps[own], after[own])
        a[cut.text[own]] = x / x.sum(1, keepdims=True)
    return before, after


def _forward(hmm: Hmm, emit: np.ndarray, flat: np.ndarray, cut: _Cut, own: np.ndarray, before: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The scaled forward vectors of the segments that reach each step, and their scales."""
    a = np.where((cut.nth[own] == 0)[:, None], hmm.start, before[own] @ hmm.move)
    for t, n in enumerate(cut.alive(own)):
        a = (a if t == 0 else a[:n] @ hmm.move) * emit[flat[cut.at[own[:n]] + t]]
        s = a.sum(1, keepdims=True)
        a = a / s
        yield a, s


def forward(hmm: Hmm, flat: np.ndarray, lengths: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """log10 of the likelihood of each class sequence, by the scaled recursion over the whole of it."""
    emit, cut = np.ascontiguousarray(hmm.emit.T), _Cut(lengths, segment)
    before, _ = _seams(hmm, emit, flat, cut)
    out = np.zeros(len(lengths))
    for own in cut.blocks(np.arange(len(cut.size))):
        score = np.zeros(len(own))
        for _, s in _forward(hmm, emit, flat, cut, own, before):
            score[: len(s)] += np.log10(s[:, 0])
        np.add.at(out, cut.text[own], score)
    return out


def expected(hmm: Hmm, flat: np.ndarray, lengths: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, moves and emissions."""
    k, n_classes = hmm.emit.shape
    emit, cut = np.ascontiguousarray(hmm.emit.T), _Cut(lengths, segment)
    before, after = _seams(hmm, emit, flat, cut)
    start, move, counts = np.zeros(k), np.zeros((k, k)), np.zeros((k, n_classes))
    for own in cut.blocks(np.arange(len(cut.size))):
        alphas, scales = zip(*_forward(hmm, emit, flat, cut, own, before))
        gammas, seen = [], []
        back = np.zeros((0, k))
        for t in range(len(alphas) - 1, -1, -1):
            n = len(alphas[t])
            beta = after[own[:n]]
            beta = beta / (alphas[t] * beta).sum(1, keepdims=True)
            if len(back):
                beta[: len(back)] = back @ hmm.move.T
                move += alphas[t][: len(back)].T @ back
            g = alphas[t] * beta
            c = flat[cut.at[own[:n]] + t]
            gammas.append(g)
            seen.append(c)
            back = emit[c] * beta / scales[t]
            if t == 0:
                first = cut.nth[own] == 0
                start += g[first].sum(0)
                move += before[own[~first]].T @ back[~first]
        g, c = np.concatenate(gammas), np.concatenate(seen)
        counts += np.stack([np.bincount(c, g[:, i], n_classes) for i in range(k)])
    return start, move * hmm.move, counts


def train(tokens: DataFrame, prior: np.ndarray, states: int, rounds: int) -> Hmm:
    """Baum-Welch: every round's expected counts are summed by entry across partitions."""
    hmm = Hmm.initial(prior, states)
    own = tokens.where("not held_out").select("classes")
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], hmm: Hmm = hmm) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                classes = ints(b, "classes")
                for lo, hi in in_blocks(classes, len, 2 * _AT_ONCE):
                    flat, lengths = _sequences(classes[lo:hi])
                    x = np.concatenate([p.ravel() for p in expected(hmm, flat, lengths)])
                    total = x if total is None else total + x
            if total is not None:
                at = np.flatnonzero(total)
                yield pa.record_batch([pa.array(at), pa.array(total[at])], ["i", "x"])

        rows = own.mapInArrow(thrifty(run), "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()  # as many as the model has numbers
        x = np.zeros(states + states**2 + states * len(prior))
        x[rows["i"].to_numpy()] = rows["x"].to_numpy()
        hmm = Hmm.from_counts(x[:states], x[states : states + states**2].reshape(states, states), x[states + states**2 :].reshape(states, -1), prior)
    return hmm


def _sequences(classes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(classes), np.uint16), np.array([len(c) // 2 for c in classes], np.int64)


# -- scoring -----------------------------------------------------------------------


def classified(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Per text: sums over the words of own classes, the class sequence, and the other words with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as many words as the vocabulary has
    schema = "doc_id long, held_out boolean, n_tokens long, known long, own_log double, tail_norm double, classes binary, rare array<binary>, rare_n array<int>"
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = shared.value
        own, n_own = voc.own, len(voc.own)
        logs = [math.log10(c + 0.5) for c in voc.own_count]
        norm = [math.log10(n + 0.5 * (v + 1)) for n, v in zip(voc.tail_total, voc.tail_distinct)]
        for b in (x.slice(i, 1000) for x in batches for i in range(0, x.num_rows, 1000)):
            rows = []
            for t in utf8(b, "text"):
                words = t.lower().split()
                of: dict[bytes, int] = {END: n_own}
                known, own_log, tail = (1 if voc.ends else 0), math.log10(voc.ends + 0.5), 0.0
                rare, rare_n = [], []
                for w, n in Counter(words).items():
                    k = own.get(w)
                    if k is None:
                        k = crc32(w) % TAIL
                        tail += n * norm[k]
                        of[w] = n_own + 1 + k
                        rare.append(w)
                        rare_n.append(n)
                    else:
                        of[w] = k
                        own_log += n * logs[k]
                        known += n
                words.append(END)
                seq = np.fromiter(map(of.__getitem__, words), np.uint16, len(words)).tobytes()
                rows.append((len(words), known, own_log, tail, seq, rare, rare_n))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32())]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.record_batch([*[b.column(b.schema.get_field_index(c)) for c in ("doc_id", "held_out")], *cols], names)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(thrifty(run), schema)


def score(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, vocabulary: int = VOCABULARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each row of docs."""
    if vocabulary + 1 + TAIL >= 1 << 16:
        raise ValueError("classes are written as 16 bits")
    spark = docs.sparkSession
    workers_find_us(spark)
    scratch = Scratch(spark)
    counts = scratch.put(word_counts(docs), "counts")
    voc = Vocabulary.of(counts, vocabulary)
    # Written once, so the number names the row from here on.
    tokens = scratch.put(classified(docs, voc).withColumn("row", F.monotonically_increasing_id()), "tokens")
    hmm = train(tokens, voc.prior(), states, rounds)

    rare = tokens.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.rare_n").alias("n"))
    rare = rare.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rare = rare.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 0.5)).alias("rare_log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            classes = ints(b, "classes")
            got = np.zeros(len(classes))
            for lo, hi in in_blocks(classes, len, 2 * _AT_ONCE):
                got[lo:hi] = forward(hmm, *_sequences(classes[lo:hi]))
            keep = [c for c in b.schema.names if c != "classes"]
            yield pa.record_batch([*[b.column(b.schema.get_field_index(c)) for c in keep], pa.array(got)], [*keep, "hmm"])

    plain = tokens.select("row", "doc_id", "held_out", "n_tokens", "known", "own_log", "tail_norm", "classes")
    scored = plain.mapInArrow(thrifty(run), "row long, doc_id long, held_out boolean, n_tokens long, known long, own_log double, tail_norm double, hmm double")
    out = scored.join(rare, "row", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    norm = math.log10(voc.total + 0.5 * (voc.distinct + 1))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(voc.total).cast("long").alias("train_tokens"),
        (F.col("own_log") + rare_log - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("hmm") + rare_log - F.col("tail_norm")).alias("score"),
    )
