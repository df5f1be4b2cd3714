"""Rows of token sets against a block of query sets that a task holds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Tokens of rows that are looked up at once, meetings of them with queries, and tokens of queries that are compared at once; each at least those of one row or pair.
TOKENS, MEETINGS, COMPARED = 1 << 19, 1 << 21, 1 << 20
#: Of the tokens that a similar pair shares at least, one in so many has to be met before the pair is compared.
SHARE = 8
#: Steps in which a list's order by what is left of a query is kept.
STEPS = 16


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over key, tokens: key, size and the tokens as bytes, which are read in one piece. Empty sets are left out."""
    for batch in batches:
        for i, j in _cuts(np.diff(batch.column(1).offsets.to_numpy()), TOKENS):
            sets = batch.column(1).slice(i, j - i)
            sizes = np.diff(sets.offsets.to_numpy())
            ends = pa.py_buffer(np.cumsum(np.r_[0, sizes]).astype(np.int32) * 8)
            tokens = pa.Array.from_buffers(pa.binary(), j - i, [None, ends, pa.py_buffer(sets.flatten().to_numpy())])
            out = pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sizes), tokens], ["_k", "_n", "_t"])
            yield out.filter(pa.array(sizes > 0))


def _opened(sets: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of packed sets, one set after the other, and the sets' sizes."""
    if not len(sets):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.frombuffer(sets.buffers()[1], np.int32)[sets.offset : sets.offset + len(sets) + 1]
    return np.frombuffer(sets.buffers()[2], np.uint8)[at[0] : at[-1]].view(np.int64), np.diff(at).astype(np.int64) // 8


class Block:
    """Query sets by size, with their tokens from the rarest in the block on, and for each token the list of the queries that have it.

    ``lists`` has token and then place of the token in the query, less the part of the query's size that a
    similar row of the same size needn't share: for a row, the queries that have the token early enough come first.
    """

    def __init__(self, ids: pa.Array, sets: pa.BinaryArray, threshold: float):
        values, sizes = _opened(sets)
        order = np.argsort(sizes, kind="stable")
        self.ids, self.sizes, self.part = ids.take(pa.array(order)), sizes[order], threshold / (1 + threshold)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.tokens, token, held = np.unique(values, return_inverse=True, return_counts=True)
        rank = np.empty(len(held), np.int32)
        rank[np.argsort(held, kind="stable")] = np.arange(len(held), dtype=np.int32)
        self.rank = rank
        # Hashes are even, so their first bits lead to few tokens.
        self.shift = 64 - min(max(len(held).bit_length() + 1, 2), 22)
        self.first = np.searchsorted(self.tokens, (np.arange(1 << (64 - self.shift)) - (1 << (63 - self.shift))) << self.shift).astype(np.int32)
        self.first = np.r_[self.first, np.int32(len(held))]

        both = np.sort(np.repeat(place, sizes) << 32 | rank[token])
        query, of = (both >> 32).astype(np.int32), both & 0xFFFFFFFF
        self.sets, self.starts = of.astype(np.int32), np.cumsum(self.sizes) - self.sizes
        at = np.arange(len(of)) - self.starts[query]
        lists = of << 32 | self._step(at - (1 - self.part) * self.sizes[query])
        order = np.argsort(lists, kind="stable")
        self.lists, self.query = lists[order], query[order]
        self.begins = np.searchsorted(self.lists, np.arange(len(held) + 1) << 32)

    @staticmethod
    def _step(x: np.ndarray) -> np.ndarray:
        return np.floor(x * STEPS).astype(np.int64) + (1 << 31)

    def ranks(self, values: np.ndarray) -> np.ndarray:
        """The tokens' ranks, -1 for those that no query has."""
        bucket = (values >> self.shift) + (1 << (63 - self.shift))
        at, end = self.first[bucket], self.first[bucket + 1]
        out = np.full(len(values), -1, np.int32)
        left = np.flatnonzero(at < end)
        at, end, values = at[left], end[left], values[left]
        while len(left):
            hit = self.tokens[at] == values
            out[left[hit]] = self.rank[at[hit]]
            at = at + 1
            more = ~hit & (at < end)
            left, at, end, values = left[more], at[more], end[more], values[more]
        return out


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all spans, one span after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


def _cuts(loads: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Spans of neighbours with loads of some ``most`` in all."""
    part = np.cumsum(loads) // most
    at = [0, *np.flatnonzero(part[1:] != part[:-1]) + 1, len(loads)]
    return zip(at[:-1], at[1:])


def _meet(block: Block, values: np.ndarray, sizes: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, query and similarity of some rows' pairs.

    Sets of n and m tokens are similar if they share o, threshold / (1 + threshold) * (n + m), at least. With the tokens of
    both in one order, the first l of those are among the first n - o + l of the one and m - o + l of the other. So the rarest
    tokens are looked up, and pairs that meet l times there are compared; the others can't be similar.
    """
    row = np.repeat(np.arange(len(sizes)), sizes)
    rank = block.ranks(values)
    known = rank >= 0
    both = np.sort(row[known] << 32 | rank[known])
    row, rank = both >> 32, both & 0xFFFFFFFF
    own = np.bincount(row, minlength=len(sizes))
    begin = np.cumsum(own) - own

    least = np.ceil(block.part * (sizes + np.maximum(sizes * threshold, block.sizes[0])) - 1e-6).astype(np.int64)
    meets = np.maximum(least // SHARE, 1)
    # Tokens that no query has are the rarest.
    early = np.arange(len(row)) - begin[row] < (own - least + meets)[row]
    e_row, e_rank = row[early], rank[early]
    lo = block.begins[e_rank]
    length = np.searchsorted(block.lists, e_rank << 32 | block._step(meets - 1 - block.part * sizes + 1e-3)[e_row], "right") - lo
    some = length > 0
    e_row, lo, length = e_row[some], lo[some], length[some]

    at = np.searchsorted(e_row, np.arange(len(sizes) + 1))
    mark = np.zeros(len(block.tokens), bool)
    for i, j in _cuts(np.bincount(e_row, length, len(sizes)).astype(np.int64), MEETINGS):
        mine = slice(at[i], at[j])
        if at[i] == at[j]:
            continue
        pair = np.sort(np.repeat(e_row[mine] << 32, length[mine]) | block.query[_spans(lo[mine], length[mine])])
        new = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        met = np.diff(np.r_[new, len(pair)])
        pair = pair[new]
        pair = pair[met >= meets[pair >> 32]]
        a, q = pair >> 32, pair & 0xFFFFFFFF
        n, shared = block.sizes[q], np.empty(len(pair), np.int64)
        for r, (k, l) in ((r, (u + k, u + l)) for r, u, v in _runs(a) for k, l in _cuts(n[u:v], COMPARED)):
            own_tokens = rank[begin[r] : begin[r] + own[r]]
            mark[own_tokens] = True
            shared[k:l] = np.add.reduceat(mark[block.sets[_spans(block.starts[q[k:l]], n[k:l])]], np.cumsum(n[k:l]) - n[k:l], dtype=np.int64)
            mark[own_tokens] = False
        similarity = shared / (sizes[a] + n - shared)
        good = similarity >= threshold
        yield a[good], q[good], similarity[good]


def _runs(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Value, start and end of each run of equal values."""
    at = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, np.int64)
    return zip(x[at].tolist(), at.tolist(), np.r_[at[1:], len(x)].tolist())


def searcher(held, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over key, packed tokens: a, b, similarity of the rows with the queries of a broadcast block. A set isn't compared with its own key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = held.value
        for batch in batches:
            for i, j in _cuts(_opened(batch.column(1))[1], TOKENS):
                ids = batch.column(0).slice(i, j - i)
                for a, q, similarity in _meet(block, *_opened(batch.column(1).slice(i, j - i)), threshold):
                    out = pa.RecordBatch.from_arrays([block.ids.take(pa.array(q)), ids.take(pa.array(a)), pa.array(similarity)], ["a", "b", "similarity"])
                    yield out.filter(pa.compute.not_equal(out.column(0), out.column(1)))

    return run
