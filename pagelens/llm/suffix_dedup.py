"""Exact substring dedup over bytes with difference-cover suffix arrays.

Removed is each byte covered by a string of LENGTH bytes that also starts in a
document of smaller id. Three steps:

1. Every LENGTH-byte window names an anchor: its K-gram of least hash. Equal
   windows name equal K-grams, so a window can only repeat if its anchor occurs in
   a second document. Anchors are counted across all documents (packed, by hash
   range), and windows whose anchor is in one document alone are done: nothing is
   lost. This is what keeps suffix sorting affordable; it drops no match.
2. What is left are stretches of text around shared anchors. They are dealt by
   anchor, so all equal windows meet in one partition, and each partition sorts its
   suffixes by the difference-cover algorithm (period 3): the sampled triples are
   sorted and named, the names' string is sorted by recursion, the other suffixes
   are sorted by first symbol and sampled rank, and both are merged. Suffixes that
   are neighbours and share LENGTH bytes are one string; its least document stays.
   Partitions sort independently: no order of all suffixes is built (see README).
3. The spans come together by document, are united, and are cut from the text.

Between 1 and 2, runs of such stretches are cut into chunks at anchors of certain
hashes. Of equal chunks, which copies are full of, all but those of the least
document go as a whole, first inside a task and then by digest.

Sizes: the number of anchor buckets and of sort partitions follows the bytes that
are there; a task holds one bucket, one partition's stretches, and sorts SORTED bytes
at a time. Hot strings: equal chunks collapse inside a task, so a text that a third of
all documents hold costs a row for each block. An anchor with over HOT occurrences is
dealt window by window, by the window's own hash, so that the surroundings of a common
passage spread over all partitions, and equal windows collapse inside a task, too.
HOT only says how strings are dealt; results are the same at any value (tested).

Defined results: a null text is empty; rows that repeat a doc_id, equal ones too, are
separate and never remove each other's bytes; a row of null doc_id keeps all bytes
and removes none elsewhere; texts shorter than LENGTH stay; a text of any length is
worked on in pieces that overlap; an empty table gives no rows; extra columns, whatever
their names, stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, in_blocks, ints, mix, numbered, prefix_hash, span_hash, thrifty, utf8, with_fields, workers_find_us

LENGTH = 50
K = 20
HOT = 8192
_SPAN = LENGTH - K + 1  # K-grams of a window
CUT = 8
_PART = 1 << 18  # window starts that are hashed at a time; a dozen arrays of eight bytes each hang on it
_LOW = U64((1 << 22) - 1)
#: Bytes of text whose anchors are counted together before the shuffle (a byte of text takes some ten of them
#: while that goes on), and of chunks that are held; bytes for each bucket of anchors, bytes of stretches
#: that are dealt to one partition, and those that it sorts at a time.
COUNTED, BLOCK, BUCKET, PARTITION, SORTED = 4 << 20, 8 << 20, 4 << 20, 16 << 20, 1 << 19


# -- anchors -------------------------------------------------------------------


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """hash, text, lo, hi, at: for each run of windows lo..hi (positions in data) that name the K-gram at ``at``."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (U64, np.int64, np.int64, np.int64, np.int64))
    at = np.arange(len(data) - K + 1)
    x = span_hash(prefix_hash(data), at, at + K)
    y = (x & ~_LOW) | at.astype(U64)
    width = 1
    while 2 * width <= _SPAN:
        y = np.minimum(y[:-width], y[width:])
        width *= 2
    if width < _SPAN:
        y = np.minimum(y[: n], y[_SPAN - width : _SPAN - width + n])
    least = (y & _LOW).astype(np.int64)
    size = ends - starts
    text = np.repeat(np.arange(len(starts)), size)[:n]
    ok = np.flatnonzero(np.arange(n) + LENGTH <= ends[text])
    least = least[ok]
    head = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (ok[1:] != ok[:-1] + 1)])) if len(ok) else ok
    lo = ok[head]
    hi = ok[np.append(head[1:], len(ok)) - 1] if len(ok) else ok
    return x[least[head]], text[lo], lo, hi, least[head]


def _anchors_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hash, index of the text, code (lo << 12 | hi - lo << 6 | at - lo) of all texts."""
    pieces = []  # a long text comes in pieces that overlap by LENGTH - 1
    for i, t in enumerate(texts):
        for lo in range(0, max(len(t) - LENGTH + 1, 0), _PART):
            pieces.append((i, lo, t[lo : lo + _PART + LENGTH - 1] if len(t) > _PART else t))
    out = []
    for a, z in in_blocks(pieces, lambda p: len(p[2]), _PART):
        part = pieces[a:z]
        size = np.array([len(p[2]) for p in part], np.int64)
        end = np.cumsum(size)
        h, text, lo, hi, at = anchors(np.frombuffer(b"".join(p[2] for p in part), np.uint8), end - size, end)
        own = np.array([p[0] for p in part], np.int64)[text]
        base = lo - (end - size)[text] + np.array([p[1] for p in part], np.int64)[text]
        out.append((h, own, (base << 12) | ((hi - lo) << 6) | (at - lo)))
    if not out:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _planes(x: np.ndarray) -> bytes:
    """Bytes by significance, which compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplane(b: bytes, dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(dtype).ravel()


def _groups(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by hash, and where its groups begin."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    return order, np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)


def packed_anchors(docs: DataFrame, bits: int) -> DataFrame:
    """bucket, settled, h, doc, k, code: anchors of a block of documents by the first ``bits`` of their hash.

    An anchor that the block has in two documents is settled: its occurrences pass by
    under any bucket, and its own bucket gets two witnesses, whose code is minus the
    number of occurrences.
    """
    shift = U64(64 - bits)

    def rows(keys, texts) -> Iterator[pa.RecordBatch]:
        h, own, code = _anchors_of(texts)
        if not len(h):
            return
        doc = np.array([k[0] for k in keys], np.int64)[own]
        row = np.array([k[1] for k in keys], np.int64)[own]
        order, head = _groups(h)
        h, doc, row, code = h[order], doc[order], row[order], code[order]
        least, most = np.minimum.reduceat(doc, head), np.maximum.reduceat(doc, head)
        count = np.diff(np.append(head, len(h)))
        two = least < most
        settled = np.repeat(two, count)
        w = np.flatnonzero(two)
        none = np.zeros(len(w), np.int64)
        open_h = np.concatenate([h[~settled], h[head[w]], h[head[w]]])
        open_doc = np.concatenate([doc[~settled], least[w], most[w]])
        open_row = np.concatenate([row[~settled], none, none])
        # The first witness carries the count, so that counts add up.
        open_code = np.concatenate([code[~settled], -count[w], np.full(len(w), -1 << 62)])
        bucket = (open_h >> shift).astype(np.int64)
        order = np.lexsort((open_doc, bucket))
        bucket = bucket[order]
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        out = []
        for a, z in zip(cut, np.append(cut[1:], len(bucket))):
            i = order[a:z]
            out.append((int(bucket[a]), False, *(_planes(x[i]) for x in (open_h, open_doc, open_row, open_code))))
        h, doc, row, code = h[settled], doc[settled], row[settled], code[settled]
        for k, a in enumerate(range(0, len(h), 512)):
            s = slice(a, a + 512)
            b = int(mix(np.array([U64(doc[a]) + U64(k)], U64))[0] >> shift)
            out.append((b, True, *(_planes(x[s]) for x in (h, doc, row, code))))
        kinds = [pa.int64(), pa.bool_(), *[pa.binary()] * 4]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["bucket", "settled", "h", "doc", "k", "code"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, total = [], [], 0
        for b in (x.slice(i, 1000) for x in batches for i in range(0, x.num_rows, 1000)):
            for key, t in zip(zip(ints(b, "doc_id"), ints(b, "_k")), utf8(b, "text")):
                if key[0] is None or len(t) < LENGTH:
                    continue
                if texts and total + len(t) > COUNTED:
                    yield from rows(keys, texts)
                    keys, texts, total = [], [], 0
                keys.append(key)
                texts.append(t)
                total += len(t)
        if texts:
            yield from rows(keys, texts)

    return docs.select("doc_id", "_k", "text").mapInArrow(thrifty(run), "bucket long, settled boolean, h binary, doc binary, k binary, code binary")


def shared_anchors(packed: DataFrame) -> DataFrame:
    """h, doc_id, _k, code of anchors in two documents or more; a null doc_id marks an anchor with over HOT occurrences.

    Rows come by bucket, and one bucket at a time is held.
    """
    names = ["h", "doc_id", "_k", "code"]

    def counted(parts: list) -> Iterator[pa.RecordBatch]:
        h, doc, row, code = (np.concatenate(x) for x in zip(*parts))
        order, head = _groups(h)
        h, doc, row, code = h[order], doc[order], row[order], code[order]
        shared = np.minimum.reduceat(doc, head) < np.maximum.reduceat(doc, head)
        each = np.where(code >= 0, 1, np.where(code == -1 << 62, 0, -code))
        hot = head[shared & (np.add.reduceat(each, head) > HOT)]
        ok = np.repeat(shared, np.diff(np.append(head, len(h)))) & (code >= 0)
        yield pa.record_batch([pa.array(x[ok]) for x in (h.view(np.int64), doc, row, code)], names)
        if len(hot):
            zero = pa.array(np.zeros(len(hot), np.int64))
            yield pa.record_batch([pa.array(h[hot].view(np.int64)), pa.nulls(len(hot), pa.int64()), zero, zero], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        at = None
        for b in batches:
            for bucket, settled, *cols in zip(*(ints(b, c) for c in ("bucket", "settled", "h", "doc", "k", "code"))):
                got = tuple(_unplane(c, t) for c, t in zip(cols, (U64, np.int64, np.int64, np.int64)))
                if settled:
                    yield pa.record_batch([pa.array(x.view(np.int64)) for x in got], names)
                    continue
                if bucket != at and held:
                    yield from counted(held)
                    held = []
                at = bucket
                held.append(got)
        if held:
            yield from counted(held)

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(thrifty(run), "h long, doc_id long, _k long, code long")


# -- chunks and stretches --------------------------------------------------------


def chunks(docs: DataFrame) -> DataFrame:
    """digest, doc_id, _k, lo, size, chunk, hot: text around runs of windows with shared anchors.

    A run is cut after anchors whose hash is divisible by CUT, so equal runs give
    equal chunks. Of equal chunks in a block, those of the least document go on;
    the others are settled, with a null digest.
    """
    names = ["digest", "doc_id", "_k", "lo", "size", "chunk", "hot"]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]

    def flush(held: dict, settled: list) -> Iterator[pa.RecordBatch]:
        rows = [(key, d, k, lo, len(c), c, hot) for key, (d, c, hot, where) in held.items() for k, lo in where] + settled
        for a in range(0, len(rows), 20_000):
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 20_000]), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        settled: list = []
        n = 0
        for b in (x.slice(i, 1000) for x in batches for i in range(0, x.num_rows, 1000)):
            col = b.column(b.schema.get_field_index("found"))
            flat = col.flatten()
            code, cut = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("code", "cut"))
            hot = np.asarray(flat.field("hot").is_valid())
            h = flat.field("hot").fill_null(0).to_numpy(zero_copy_only=False)
            edges = col.offsets.to_numpy()
            edges = edges - edges[0]
            doc = np.repeat(np.arange(len(col)), np.diff(edges))
            order = np.lexsort((code, doc))
            code, cut, h, hot, doc = code[order], cut[order], h[order], hot[order], doc[order]
            lo = code >> 12
            hi = lo + (code >> 6 & 63)
            new = np.ones(len(lo), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] != hi[:-1] + 1) | cut[:-1]
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(lo)) - 1
            any_hot = np.add.reduceat(hot, first) > 0 if len(first) else first
            ids, ks, texts = ints(b, "doc_id"), ints(b, "_k"), utf8(b, "text")
            for i, z, at, start, end, warm in zip(first.tolist(), last.tolist(), doc[first].tolist(), lo[first].tolist(), hi[last].tolist(), any_hot.tolist()):
                d, k, c = ids[at], ks[at], texts[at][start : end + LENGTH]
                key = hashlib.blake2b(c, digest_size=16).digest()
                was = held.get(key)
                if was is None or d < was[0]:
                    if was is not None:
                        settled += [(None, was[0], x, y, len(c), None, None) for x, y in was[3]]
                    held[key] = (d, c, np.unique(h[i : z + 1][hot[i : z + 1]]) if warm else [], [(k, start)])
                    n += len(c)
                elif was[0] == d:
                    was[3].append((k, start))
                else:
                    settled.append((None, d, k, start, len(c), None, None))
            if n > BLOCK or len(settled) > 200_000:
                yield from flush(held, settled)
                held, settled, n = {}, [], 0
        yield from flush(held, settled)

    return docs.mapInArrow(thrifty(run), "digest binary, doc_id long, _k long, lo long, size long, chunk binary, hot array<long>")


def stretches(found: DataFrame) -> DataFrame:
    """key, doc_id, _k, lo, size, stretch: of each chunk, the text of the windows of each anchor, keyed by the anchor.

    Windows of a hot anchor come one by one, keyed by themselves. Of equal ones in a
    block those of the least document go on, and the others are settled: their key and
    stretch are null. So a window that very many documents hold is a row or two for each block.
    """
    names = ["key", "doc_id", "_k", "lo", "size", "stretch"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def batch(rows: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    def flush(warm: dict, settled: list) -> Iterator[pa.RecordBatch]:
        rows = [(int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little", signed=True), d, k, lo, LENGTH, w) for w, (d, at) in warm.items() for k, lo in at]
        rows += settled
        for a in range(0, len(rows), 20_000):
            yield batch(rows[a : a + 20_000])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        warm: dict[bytes, tuple[int, list]] = {}
        settled: list = []
        for b in (x.slice(i, 2000) for x in batches for i in range(0, x.num_rows, 2000)):
            ids, ks, base, texts, hots = (ints(b, c) for c in ("doc_id", "_k", "lo", "chunk", "hot"))
            for a, z in in_blocks(texts, len, _PART):
                h, own, code = _anchors_of(texts[a:z])
                own += a
                keys, lo = h.view(np.int64), code >> 12
                hi = lo + (code >> 6 & 63)
                is_hot = np.zeros(len(h), bool)
                for i in range(a, z):
                    if hots[i]:
                        mine = np.flatnonzero(own == i)
                        is_hot[mine] = np.isin(keys[mine], hots[i])
                # Those of plain anchors at once: they are slices of the chunks laid end to end.
                plain = np.flatnonzero(~is_hot)
                flat = pa.py_buffer(b"".join(texts[a:z]))
                begin = np.cumsum([0, *map(len, texts[a:z])])[own[plain] - a] + lo[plain]
                size = hi[plain] - lo[plain] + LENGTH
                data = np.frombuffer(flat, np.uint8)
                out = np.concatenate([[0], np.cumsum(size)])
                for x in range(0, len(plain), 20_000):
                    y = min(x + 20_000, len(plain))
                    n = int(out[y] - out[x])
                    at = np.repeat(begin[x:y] - (out[x:y] - out[x]), size[x:y]) + np.arange(n)
                    column = pa.BinaryArray.from_buffers(pa.binary(), y - x, [None, pa.py_buffer((out[x : y + 1] - out[x]).astype(np.int32)), pa.py_buffer(data[at].tobytes())])
                    i = plain[x:y]
                    of = own[i]
                    yield pa.record_batch(
                        [pa.array(keys[i]), pa.array(np.array(ids, np.int64)[of]), pa.array(np.array(ks, np.int64)[of]), pa.array(np.array(base, np.int64)[of] + lo[i]), pa.array(size[x:y]), column], names
                    )
                for i in np.flatnonzero(is_hot).tolist():
                    o = int(own[i])
                    t, d, k = texts[o], ids[o], ks[o]
                    for s in range(int(lo[i]), int(hi[i]) + 1):
                        w, place = t[s : s + LENGTH], (k, base[o] + s)
                        was = warm.get(w)
                        if was is None or d < was[0]:
                            if was is not None:
                                settled += [(None, was[0], x, y, LENGTH, None) for x, y in was[1]]
                            warm[w] = (d, [place])
                        elif was[0] == d:
                            was[1].append(place)
                        else:
                            settled.append((None, d, *place, LENGTH, None))
                if len(warm) + len(settled) > 200_000:
                    yield from flush(warm, settled)
                    warm, settled = {}, []
        yield from flush(warm, settled)

    return found.select("doc_id", "_k", "lo", "chunk", "hot").mapInArrow(thrifty(run), "key long, doc_id long, _k long, lo long, size long, stretch binary")


# -- suffix arrays ---------------------------------------------------------------


def _order3(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of triples, and for each place in it whether it differs from the one before."""
    top = int(max(a.max(initial=0), b.max(initial=0), c.max(initial=0)))
    if top < 1 << 21:
        key = (a << 42) | (b << 21) | c
        order = np.argsort(key, kind="stable")
        s = key[order]
        return order, np.concatenate([[True], s[1:] != s[:-1]])
    order = np.lexsort((c, b, a))
    x, y, z = a[order], b[order], c[order]
    return order, np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])])


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The order of the suffixes of s (symbols from 1), by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    padded = np.concatenate([s, np.zeros(4, np.int64)])
    # Sort the sampled triples and name them.
    one = np.arange(1, n + (n % 3 == 1), 3)
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    order, new = _order3(padded[sample], padded[sample + 1], padded[sample + 2])
    name = np.zeros(len(sample), np.int64)
    name[order] = np.cumsum(new)
    rank = np.zeros(n + 4, np.int64)
    if new.all():
        sorted_sample = sample[order]
    else:  # recurse on the names
        sorted_sample = sample[suffix_array(name)]
    rank[sorted_sample] = np.arange(1, len(sample) + 1)
    sorted_sample = sorted_sample[sorted_sample < n]
    # Sort the remaining suffixes by symbol and sampled rank, then merge.
    rest = np.arange(0, n, 3)
    zero = np.zeros(1, np.int64)
    order, _ = _order3(zero.repeat(len(rest)), padded[rest], rank[rest + 1])
    rest = rest[order]
    first, second = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    big = len(sample) + 2
    by_one = lambda i: padded[i] * big + rank[i + 1]
    if int(s.max()) < 1 << 21 and big < 1 << 21:
        by_two = lambda i: (padded[i] * (1 << 21) + padded[i + 1]) * (1 << 21) + rank[i + 2]
        below = np.searchsorted(by_two(second), by_two(rest))
    else:  # name the pairs of symbols first
        i = np.concatenate([second, rest])
        _, pair = np.unique(padded[i] * (int(s.max()) + 1) + padded[i + 1], return_inverse=True)
        key = pair * big + rank[i + 2]
        below = np.searchsorted(key[: len(second)], key[len(second) :])
    place = np.arange(len(rest)) + np.searchsorted(by_one(first), by_one(rest)) + below
    out = np.empty(n, np.int64)
    free = np.ones(n, bool)
    free[place] = False
    out[place] = rest
    out[free] = sorted_sample
    return out


def repeated(texts: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, first, last: runs of window starts whose LENGTH bytes also start in a text of smaller doc."""
    data = np.frombuffer(b"\0".join(texts) + bytes(8), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size + 1) - size - 1
    n = int(start[-1] + size[-1] + 1)
    # Each text ends in a symbol of its own, so no match runs past it.
    symbols = data[:n].astype(np.int64) + len(texts) + 1
    symbols[start + size] = np.arange(1, len(texts) + 1)
    text = np.repeat(np.arange(len(texts)), size + 1)
    order = suffix_array(symbols)
    order = order[order + LENGTH <= (start + size)[text[order]]]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Compare adjacent prefixes, eight bytes at a time.
    eight = np.ndarray((len(data) - 7,), "<u8", buffer=data.tobytes(), strides=(1,))
    same = np.ones(len(order) - 1, bool)
    for off in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        at = np.flatnonzero(same)
        same[at] = eight[order[at] + off] == eight[order[at + 1] + off]
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    doc = docs[text[order]]
    least = np.repeat(np.minimum.reduceat(doc, head), np.diff(np.append(head, len(order))))
    gone = np.sort(order[doc > least])
    if not len(gone):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.concatenate([[True], (gone[1:] != gone[:-1] + 1) | (text[gone[1:]] != text[gone[:-1]])])
    a = gone[cut]
    z = gone[np.append(np.flatnonzero(cut)[1:], len(gone)) - 1]
    own = text[a]
    return own, a - start[own], z - start[own]


def spans(open_: DataFrame, partitions: int) -> DataFrame:
    """doc_id, _k, start, end: byte spans of stretches that repeat one of a smaller document.

    A partition sorts its stretches by key and works on whole keys, SORTED bytes at a time.
    """

    def sort(key: np.ndarray, doc: np.ndarray, k: np.ndarray, lo: np.ndarray, stretch: pa.Array) -> pa.RecordBatch:
        # Equal stretches are sorted once, as one of their least document.
        once = stretch.dictionary_encode()
        which, texts = once.indices.to_numpy(), once.dictionary.to_pylist()
        least = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(least, which, doc)
        size = np.array([len(t) for t in texts], np.int64)
        # A key with one stretch alone has nothing to compare it with.
        of = np.empty(len(texts), np.int64)
        of[which] = key
        _, group, n = np.unique(of, return_inverse=True, return_counts=True)
        several = np.flatnonzero(n[group] > 1)
        i, a, z = repeated([texts[x] for x in several.tolist()], least[several]) if len(several) else (np.zeros(0, np.int64),) * 3
        i = several[i]
        whole = np.flatnonzero(doc > least[which])
        first = np.flatnonzero(doc == least[which])
        # The runs of each text that a smaller document has, for every occurrence in its own.
        begin, end = np.searchsorted(i, which[first], "left"), np.searchsorted(i, which[first], "right")
        each = np.repeat(first, end - begin)
        run_ = np.repeat(begin - np.concatenate([[0], np.cumsum(end - begin)[:-1]]), end - begin) + np.arange(len(each)) if len(first) else each
        rows = np.concatenate([whole, each])
        start = np.concatenate([lo[whole], lo[each] + a[run_]])
        stop = np.concatenate([lo[whole] + size[which[whole]], lo[each] + z[run_] + LENGTH])
        return pa.record_batch([pa.array(doc[rows]), pa.array(k[rows]), pa.array(start), pa.array(stop)], ["doc_id", "_k", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(b.schema.get_field_index(c)) for c in ("key", "doc_id", "_k", "lo", "size", "stretch")] for b in batches]
        if not parts:
            return
        *numbers, texts = (pa.chunked_array(list(x)) for x in zip(*parts))
        del parts
        key, doc, k, lo, size = (x.to_numpy() for x in numbers)
        order = np.argsort(key, kind="stable")
        ends = np.append(np.flatnonzero(np.diff(key[order])) + 1, len(order))
        total = np.concatenate([[0], np.cumsum(size[order])])[ends]
        a = done = 0
        while a < len(order):
            z = int(ends[max(np.searchsorted(total, done + SORTED, "right") - 1, np.searchsorted(ends, a, "right"))])
            i = order[a:z]
            yield sort(key[i], doc[i], k[i], lo[i], texts.take(pa.array(i)).combine_chunks())
            a, done = z, int(total[np.searchsorted(ends, z)])

    return open_.repartition(partitions, "key").mapInArrow(thrifty(run), "doc_id long, _k long, start long, end long")


# -- the operator ------------------------------------------------------------------


def removals(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, _k, gone array<struct<start, end>>: byte spans of the rows that lose any. docs: doc_id, _k, text."""
    workers_find_us(docs.sparkSession)
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(10, (n_bytes // BUCKET).bit_length()), 24)
    shared = scratch.put(shared_anchors(packed_anchors(docs, bits)), "shared")
    hot = scratch.put(shared.where("doc_id is null").select("h").distinct(), "hot").withColumn("hot", F.lit(True))
    own = shared.where("doc_id is not null").join(hot, "h", "left")
    own = own.select("doc_id", "_k", F.struct("code", (F.col("h").bitwiseAND(CUT - 1) == 0).alias("cut"), F.when(F.col("hot"), F.col("h")).alias("hot")).alias("x"))
    found = own.groupBy("doc_id", "_k").agg(F.collect_list("x").alias("found"))
    pieces = scratch.put(chunks(docs.join(found, ["doc_id", "_k"])), "chunks")
    scratch.drop(shared)
    # Of equal chunks, only those of the least document need comparing with others.
    open_ = pieces.where("digest is not null")
    least = scratch.put(open_.groupBy("digest").agg(F.min("doc_id").alias("least")), "least")
    firsts = scratch.put(open_.join(least, "digest").where("doc_id = least").drop("digest", "least"), "firsts")
    whole = open_.select("digest", "doc_id", "_k", "lo", "size").join(least, "digest").where("doc_id > least").select("doc_id", "_k", "lo", "size")
    whole = scratch.put(whole.unionAll(pieces.where("digest is null").select("doc_id", "_k", "lo", "size")), "whole")
    scratch.drop(pieces, least)
    cut = scratch.put(stretches(firsts), "stretches")
    scratch.drop(firsts)
    size = cut.where("key is not null").agg(F.sum("size")).first()[0] or 0
    gone = spans(cut.where("key is not null"), max(1, -(-size // PARTITION)))
    settled = whole.unionAll(cut.where("key is null").select("doc_id", "_k", "lo", "size"))
    gone = gone.unionAll(settled.select("doc_id", "_k", F.col("lo").alias("start"), (F.col("lo") + F.col("size")).alias("end")))
    gone = gone.groupBy("doc_id", "_k").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("gone"))
    gone = scratch.put(gone, "gone")
    scratch.drop(cut, whole)
    return gone


def _united(spans_: list[dict] | None) -> list[list[int]]:
    out: list[list[int]] = []
    for s in spans_ or []:
        if out and s["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["end"])
        else:
            out.append([s["start"], s["end"]])
    return out


def _rest(t: bytes, cut: list[list[int]]) -> bytes:
    parts, at = [], 0
    for a, z in cut:
        parts.append(t[at:a])
        at = z
    return b"".join([*parts, t[at:]])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept binary, removed array<struct<start, end>>: a row for each row of docs."""
    scratch = Scratch(docs.sparkSession)
    docs = numbered(docs).select("doc_id", "_k", "text")
    gone = removals(docs, scratch)

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, 500) for x in batches for i in range(0, x.num_rows, 500)):
            text = pc.fill_null(b.column(b.schema.get_field_index("text")).cast(pa.binary()), b"")
            kept, cuts = _without(text, b)
            removed = pa.array([[{"start": a, "end": z} for a, z in cut] for cut in cuts], span)
            lost = pa.array([sum(z - a for a, z in cut) for cut in cuts], pa.int64())
            yield pa.record_batch(
                [b.column(b.schema.get_field_index("doc_id")), pc.binary_length(text).cast(pa.int64()), lost, pa.array(list(map(len, cuts)), pa.int64()), kept, removed], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "removed"]
            )

    joined = docs.join(gone, ["doc_id", "_k"], "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(thrifty(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, removed array<struct<start:bigint,end:bigint>>")


def _without(text: pa.Array, b: pa.RecordBatch) -> tuple[pa.Array, list[list[list[int]]]]:
    """The texts (as bytes) without their spans, and the united spans; texts without any pass as they are."""
    gone = b.column(b.schema.get_field_index("gone"))
    cuts: list[list[list[int]]] = [[] for _ in range(len(gone))]
    some = np.flatnonzero(np.asarray(gone.is_valid()))
    new = []
    for i in some.tolist():
        cuts[i] = _united(gone[i].as_py())
        new.append(_rest(text[i].as_py(), cuts[i]))
    return (pc.replace_with_mask(text, gone.is_valid(), pa.array(new, text.type)) if new else text), cuts


def dedup_documents(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes cut from text; bytes that no longer form a character go, n_chars follows in its own type, other columns stay as they are."""
    scratch = Scratch(docs.sparkSession)
    own = numbered(docs)
    gone = removals(own.select("doc_id", "_k", "text"), scratch)
    marked = own.join(gone, ["doc_id", "_k"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, 500) for x in batches for i in range(0, x.num_rows, 500)):
            text = b.column(b.schema.get_field_index("text"))
            kept, cuts = _without(text.cast(pa.binary()), b)
            some = [i for i, cut in enumerate(cuts) if cut]
            new = pa.array([kept[i].as_py().decode(errors="ignore") for i in some], text.type)
            mask = b.column(b.schema.get_field_index("gone")).is_valid()
            yield pa.record_batch([b.column(b.schema.get_field_index("_row")), mask, pc.replace_with_mask(text, mask, new) if some else text], ["_row", "cut", "new"])

    out = marked.select("_row", "text", "gone").mapInArrow(thrifty(run), marked.select("_row", F.lit(True).alias("cut"), F.col("text").alias("new")).schema)
    changed = with_fields(F.col("_row"), docs.schema, text=F.col("new"), n_chars=F.length("new"))
    return out.select(F.when(F.col("cut"), changed).otherwise(F.col("_row")).alias("_row")).select("_row.*")
