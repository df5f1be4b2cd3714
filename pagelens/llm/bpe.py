"""Byte-level BPE: a rank queue over a hierarchical bitmap, for many pre-tokens at once.

All distinct pre-tokens of a block lie behind each other in one doubly linked list
of parts, with no pair across their borders. Every adjacent pair that is a token
sits in the bucket of its rank, as the position of its left part. A bitmap of
several levels marks the non-empty buckets; the lowest set bit, found from the top
level down, is the next rank to merge, for all pre-tokens together. Entries whose
pair has changed since they were queued are stale and are skipped. When a merge
makes a pair of lower rank, the rest of that pre-token's bucket waits. A pre-token
of n bytes costs about n steps, however long it is.

Pre-tokens are split by the published pattern, evaluated on character classes
(letter, number, white space, other); ``PATTERN`` states it, and another one raises.

Defined results: a null text is the empty text, which has no ids. Special tokens
don't exist here; their strings are ordinary text. Rows are independent: repeated
ids give repeated rows, and a null doc_id stays null. Texts of any length are encoded
whole; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import U64, in_blocks, ints, prefix_hash, span_hash, thrifty, utf8, workers_find_us

# Fixed value: the pattern that the split below evaluates.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ONE = [ord(c) for c in "stmd"]
_TWO = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]

_BITS = 6
_MASK = (1 << _BITS) - 1
#: Bytes of text whose pre-tokens are merged together.
BLOCK = 8 << 20
#: Bytes of text that are split, or put together, at a time.
PART = 1 << 20
OTHER, LETTER, NUMBER, SPACE = range(4)


class RankQueue:
    """Arrays of positions by rank; pops the lowest rank."""

    def __init__(self, n_ranks: int):
        self.levels: list[dict[int, int]] = []
        n = max(2, n_ranks)
        while n > 1:
            self.levels.append({})
            n = (n + _MASK) >> _BITS
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        at = rank
        for level in self.levels:
            word, bit = at >> _BITS, 1 << (at & _MASK)
            old = level.get(word, 0)
            level[word] = old | bit
            if old:  # the levels above have it
                break
            at = word

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Pushes the positions whose rank isn't -1."""
        if len(ranks) <= 4:
            for k, r in enumerate(ranks.tolist()):
                if r >= 0:
                    self.push(r, positions[k : k + 1])
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        edges = [0, *cut.tolist(), len(ranks)]
        for a, b, r in zip(edges, edges[1:], ranks[edges[:-1]].tolist()):
            if r >= 0:
                self.push(r, positions[a:b])

    def pop(self) -> tuple[int, list[np.ndarray]] | None:
        if not self.levels[-1].get(0, 0):
            return None
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            at = (at << _BITS) | ((word & -word).bit_length() - 1)
        rank = at
        for level in self.levels:
            word, bit = at >> _BITS, 1 << (at & _MASK)
            left = level[word] & ~bit
            if left:
                level[word] = left
                break
            del level[word]
            at = word
        return rank, self.buckets.pop(rank)


def _classes() -> np.ndarray:
    """The class of each code point, as the regex library has it."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            if b - a == len(m[0]) - 1:
                out[a : b + 1] = kind
            else:
                out[[ord(c) for c in m[0]]] = kind
    return out


class Bpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.n_ranks = n = max(ranks.values()) + 1
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append((a << 32) | b)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.pair_keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.array(values, np.int32)[order], -1)
        two = np.arange(256)
        self.byte_pairs = self.lookup(np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256)).reshape(len(two), 256)
        by_id = {i: b for b, i in ranks.items()}
        tokens = [by_id.get(i, b"") for i in range(n)]
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.at = np.cumsum(self.size) - self.size
        # Decimal text of each id with a comma, and its length.
        self.digits = np.array([list(f"{i},".ljust(8).encode()) for i in range(n)], np.uint8)
        self.n_digits = np.array([len(f"{i},") for i in range(n)], np.int64)
        self.kinds = _classes()

    @classmethod
    def load(cls, path: str) -> Bpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the joined pair, or -1."""
        key = (left.astype(np.int64) << 32) | right
        i = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[i] == key, self.pair_ranks[i], np.int32(-1))

    # -- splitting ---------------------------------------------------------------

    def split(self, text: bytes, starts: np.ndarray) -> np.ndarray:
        """Byte offsets where pre-tokens begin. starts: of the documents within the text; none is split across."""
        if not text:
            return np.zeros(0, np.int64)
        raw = np.frombuffer(text, np.uint8)
        point = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((raw & 0xC0) != 0x80)  # byte offset of each code point
        n = len(point)
        kind = self.kinds[point]
        doc = np.zeros(n + 1, bool)
        inside = starts[starts < len(raw)]
        doc[np.searchsorted(at, inside)] = True
        doc[0] = doc[n] = True
        run = doc[:-1].copy()
        run[1:] |= kind[1:] != kind[:-1]
        begin = run.copy()
        space = kind == SPACE
        # A space run gives its last character to what follows it in the document.
        last = np.zeros(n, bool)
        last[:-1] = space[:-1] & ~space[1:] & ~doc[1:-1]
        begin |= last
        after = np.zeros(n, bool)
        after[1:] = last[:-1] & (point[:-1] == 32)
        begin &= ~after
        # A lone apostrophe that begins a token takes a contraction's letters.
        quote = np.flatnonzero((point == 39) & run & begin)
        quote = quote[(quote + 1 < n)]
        quote = quote[(kind[quote + 1] == LETTER) & ~doc[quote + 1]]
        if len(quote):
            one = np.isin(point[quote + 1], _ONE)
            second = np.where((quote + 2 < n) & ~doc[np.minimum(quote + 2, n)], point[np.minimum(quote + 2, n - 1)], 0)
            two = np.zeros(len(quote), bool)
            for a, b in _TWO:
                two |= (point[quote + 1] == a) & (second == b)
            begin[quote[one | two] + 1] = False
            for which, step in ((one, 2), (two, 3)):
                rest = quote[which] + step
                rest = rest[(rest < n)]
                begin[rest] = True
        return at[begin]

    # -- merging -----------------------------------------------------------------

    def merge(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pre-tokens that begin at starts in data, behind each other, and how many each has."""
        n = len(data)
        ids = self.byte_id[data]
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        before[starts] = -1
        after[starts[1:] - 1] = n
        ranks = np.full(n + 1, -1, np.int32)
        ranks[: n - 1] = self.byte_pairs[data[:-1], data[1:]]
        ranks[starts[1:] - 1] = -1
        ranks[n - 1] = -1
        queue = RankQueue(self.n_ranks)
        some = np.flatnonzero(ranks[:n] >= 0)
        queue.push_all(ranks[some], some)
        dead = np.zeros(n, bool)
        while (found := queue.pop()) is not None:
            rank, bucket = found
            pos = bucket[0] if len(bucket) == 1 else np.concatenate(bucket)
            pos = pos[ranks[pos] == rank]
            if len(pos) > 1 and (len(bucket) > 1 or (pos[1:] <= pos[:-1]).any()):
                pos = np.unique(pos)
            if not len(pos):
                continue
            second = after[pos]
            if len(pos) > 1 and (touch := second[:-1] == pos[1:]).any():
                # Of pairs that share a part, every other one from the left.
                k = np.arange(len(pos))
                first = np.where(np.concatenate([[True], ~touch]), k, 0)
                odd = (k - np.maximum.accumulate(first)) & 1 == 1
                pos, second = pos[~odd], second[~odd]
            third = after[second]
            left = before[pos]
            # What a merge makes at either side, before the next one to the right.
            beside = np.zeros(len(pos), bool)
            beside[1:] = third[:-1] == pos[1:]
            m = np.full(len(pos), rank, np.int32)
            to_left = np.where(left >= 0, self.lookup(np.where(beside, rank, ids[left]), m), -1)
            open_right = third < n
            to_right = np.where(open_right, self.lookup(m, ids[np.where(open_right, third, 0)]), -1)
            low = ((to_left >= 0) & (to_left < rank)) | ((to_right >= 0) & (to_right < rank))
            if low.any() and len(pos) > 1:
                word = np.searchsorted(starts, pos, "right")
                seen = np.cumsum(low)
                before_word = np.zeros(len(pos), np.int64)
                head = np.concatenate([[True], word[1:] != word[:-1]])
                base = np.where(head, seen - low, 0)
                before_word = np.maximum.accumulate(base)
                keep = (seen - low - before_word) == 0
                if not keep.all():
                    queue.push(rank, pos[~keep])
                    pos, second, third, open_right = (x[keep] for x in (pos, second, third, open_right))
            ids[pos] = rank
            ranks[second] = -1
            dead[second] = True
            after[pos] = third
            before[third[open_right]] = pos[open_right]
            left = before[pos]
            left = left[left >= 0]
            changed = np.concatenate([left, pos])
            nxt = after[changed]
            ok = nxt < n
            new = np.where(ok, self.lookup(ids[changed], ids[np.where(ok, nxt, 0)]), np.int32(-1))
            ranks[changed] = new
            queue.push_all(new, changed)
        alive = ~dead
        return ids[alive], np.add.reduceat(alive, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)

    def encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        parts = []  # of up to PART bytes: documents, offsets, pre-tokens' hashes
        for lo, hi in in_blocks(texts, len, PART):
            text = b"".join(texts[lo:hi])
            sizes = np.array([len(t) for t in texts[lo:hi]], np.int64)
            doc = np.cumsum(sizes) - sizes
            begin = self.split(text, doc[sizes > 0])
            end = np.append(begin[1:], len(text)) if len(begin) else begin
            data = np.frombuffer(text, np.uint8)
            key = span_hash(prefix_hash(data), begin, end) + (end - begin).astype(U64) if len(begin) else np.zeros(0, U64)
            own, first, back = np.unique(key, return_index=True, return_inverse=True)
            take = _ragged(begin[first], (end - begin)[first])
            parts.append((doc, begin, own, back.astype(np.int32), data[take], (end - begin)[first]))
        if not parts:
            return []
        keys = np.concatenate([p[2] for p in parts])
        _, first, which = np.unique(keys, return_index=True, return_inverse=True)
        if not len(keys):
            return [np.zeros(0, np.int32) for _ in texts]
        size = np.concatenate([p[5] for p in parts])
        data = np.concatenate([p[4] for p in parts])
        at = np.cumsum(size) - size
        data, size = data[_ragged(at[first], size[first])], size[first]
        ids, count = self.merge(data, np.cumsum(size) - size)
        at = np.cumsum(count) - count
        out, done = [], 0
        for doc, begin, own, back, _, _ in parts:
            token = which[done : done + len(own)][back]
            done += len(own)
            got = ids[_ragged(at[token], count[token])]
            upto = np.concatenate([[0], np.cumsum(count[token])])
            cut = upto[np.searchsorted(begin, np.append(doc, np.iinfo(np.int64).max))]
            out += [got[a:b] for a, b in zip(cut, cut[1:])]
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        return [ids for ids, _ in self.both_ways(texts)]

    def both_ways(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, bytes]]:
        """The ids of each text, and what they decode to."""
        for t, ids in zip(texts, self.encode_all(texts)):
            back = self.decode(ids)
            if back != t:  # two pre-tokens met in a 64-bit hash
                ids = self.plain(t)
                back = self.decode(ids)
            yield ids, back

    def plain(self, text: bytes) -> np.ndarray:
        begin = self.split(text, np.zeros(1, np.int64))
        return self.merge(np.frombuffer(text, np.uint8), begin)[0] if len(begin) else np.zeros(0, np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.flat[_ragged(self.at[ids], self.size[ids])].tobytes()

    def decimal(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        rows = self.digits[ids]
        return rows[np.arange(8) < self.n_digits[ids][:, None]][:-1].tobytes()


def _ragged(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """at[0], at[0]+1, ... size[0] of them, then those of at[1], and so on."""
    total = int(size.sum())
    step = np.ones(total, np.int64)
    keep = size > 0
    at, size = at[keep], size[keep]
    if not total:
        return step
    head = np.cumsum(size) - size
    step[head] = at
    step[head[1:]] -= at[:-1] + size[:-1] - 1
    return np.cumsum(step)


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """One per worker and vocabulary."""
    if path not in _LOADED:
        _LOADED[path] = Bpe.load(path)
    return _LOADED[path]


def _blocks(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[list, list[bytes], Bpe]]:
    bpe = loaded(path)
    keys: list = []
    texts: list[bytes] = []
    total = 0
    for b in batches:
        got = utf8(b, "text")
        for lo, hi in in_blocks(got, len, BLOCK):
            size = sum(map(len, got[lo:hi]))
            if texts and total + size > BLOCK:
                yield keys, texts, bpe
                keys, texts, total = [], [], 0
            keys += ints(b, "doc_id")[lo:hi]
            texts += got[lo:hi]
            total += size
    if texts:
        yield keys, texts, bpe


def _check(pattern: str) -> None:
    if pattern != PATTERN:
        raise ValueError(f"the split evaluates {PATTERN!r} only")


def tokenize(docs: DataFrame, path: str, pattern: str = PATTERN) -> DataFrame:
    """doc_id, ids array<int>: the general form."""
    _check(pattern)
    workers_find_us(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts, bpe in _blocks(batches, path):
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(bpe.encode(texts), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(thrifty(run), "doc_id long, ids array<int>")


def detokenize(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, bytes binary; null ids give null."""
    workers_find_us(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            out = [None if x is None else bpe.decode(np.array(x, np.int64)) for x in ints(b, "ids")]
            yield pa.record_batch([pa.array(ints(b, "doc_id"), pa.int64()), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(thrifty(run), "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str = PATTERN, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids): encodes, decodes the ids, and digests both, in one pass."""
    _check(pattern)
    workers_find_us(docs.sparkSession)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts, bpe in _blocks(batches, path):
            n, own, decoded, all_ids = [], [], [], []
            for ids, back in bpe.both_ways(texts):
                n.append(len(ids))
                own.append(hashlib.sha256(bpe.decimal(ids)).hexdigest())
                decoded.append(hashlib.sha256(back).hexdigest())
                if with_ids:
                    all_ids.append(ids)
            columns = [pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(own, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
            yield pa.record_batch(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(thrifty(run), schema)
