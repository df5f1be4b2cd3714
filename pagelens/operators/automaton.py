"""Which of many entries a text contains, in one pass over the text.

The entries' UTF-8 bytes become an automaton: a trie whose missing edges are filled along
the failure links, kept as one flat table of next states (states x byte classes), with an
output and an output link for each state. Texts are cut into pieces that overlap by the
longest entry, and all pieces of a batch take their steps together, so a step is a few
array operations whatever the number of entries. UTF-8 has no character inside another's
bytes, so a match of bytes is a match of characters.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import workers_find_us

#: Bytes of the entries of one automaton, and cells of its table (four bytes each); more entries make more automata.
ENTRY_BYTES = 1 << 20
CELLS = 1 << 26
PIECE = 1024
BATCH_BYTES = 4 << 20


class Automaton:
    def __init__(self, entries: list[bytes]):
        """entries: distinct, none of them empty."""
        self.longest = max(map(len, entries), default=0)
        used = sorted({b for e in entries for b in e})
        self.classes = np.zeros(256, np.int64)
        self.classes[used] = np.arange(1, len(used) + 1)
        children: list[dict[int, int]] = [{}]
        out = [-1]
        for i, e in enumerate(entries):
            at = 0
            for c in self.classes[list(e)].tolist():
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    out.append(-1)
                at = children[at][c]
            out[at] = i
        self.next = np.zeros((len(children), len(used) + 1), np.int32)
        fail = [0] * len(children)
        link = [0] * len(children)
        queue = deque([0])
        while queue:
            at = queue.popleft()
            row = self.next[at]
            if at:
                row[:] = self.next[fail[at]]
            for c, child in children[at].items():
                fail[child] = int(row[c]) if at else 0
                link[child] = fail[child] if out[fail[child]] >= 0 else link[fail[child]]
                row[c] = child
                queue.append(child)
        self.out, self.link = np.array(out, np.int64), np.array(link, np.int64)
        self.tells = (self.out >= 0) | (self.link > 0)

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of texts and of the entries that they contain, each pair once, in order."""
        empty = np.zeros(0, np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        if not self.longest or not len(data):
            return empty, empty
        length = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(length) - length
        pieces = -(-length // PIECE)
        text = np.repeat(np.arange(len(texts)), pieces)
        number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.maximum(number * PIECE - (self.longest - 1), 0)
        size = np.minimum((number + 1) * PIECE, length[text]) - start
        order = np.argsort(-size, kind="stable")
        text, size, at = text[order], size[order], (begin[text] + start)[order]
        active = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
        state = np.zeros(len(size), np.int64)
        classes = self.classes[data]
        width = self.next.shape[1]
        flat = self.next.reshape(-1)
        found: list[np.ndarray] = []
        for i, n in enumerate(active.tolist()):
            own = flat[state[:n] * width + classes[at[:n] + i]]
            state[:n] = own
            hit = np.flatnonzero(self.tells[own])
            if len(hit):
                found.append(text[hit] * len(self.out) + own[hit])
        if not found:
            return empty, empty
        pairs = np.unique(np.concatenate(found))
        text, state = pairs // len(self.out), pairs % len(self.out)
        all_texts, all_entries = [], []
        while len(state):
            own = self.out[state]
            all_texts.append(text[own >= 0])
            all_entries.append(own[own >= 0])
            state = self.link[state]
            text, state = text[state > 0], state[state > 0]
        n = int(self.out.max()) + 1
        pairs = np.unique(np.concatenate(all_texts) * n + np.concatenate(all_entries))
        return pairs // n, pairs % n


def groups_of(entries: list[str]) -> Iterator[list[str]]:
    """Entries of one automaton each."""
    own, size = [], 0
    most = min(ENTRY_BYTES, CELLS // 257)
    for e in entries:
        n = len(e.encode())
        if own and size + n > most:
            yield own
            own, size = [], 0
        own.append(e)
        size += n
    if own:
        yield own


def add_found(rows: DataFrame, text: str, entries: DataFrame, name: str = "found") -> DataFrame:
    """rows with an array of the entries (first column, strings) that the text contains, in their order; null and empty entries are found nowhere.

    A dictionary of entries goes to every task, in automata of a bounded size, and every
    automaton reads the texts once.
    """
    spark = rows.sparkSession
    workers_find_us(spark)
    column = entries.columns[0]
    every = sorted(r[0] for r in entries.where(F.length(column) > 0).select(column).distinct().toLocalIterator())
    out = rows.withColumn(name, F.array().cast("array<string>"))
    for own in groups_of(every):
        out = _one(out, text, spark.sparkContext.broadcast(own), name)
    return out.withColumn(name, F.array_sort(name)) if len(every) else out


_BUILT: dict[str, Automaton] = {}


def _one(rows: DataFrame, text: str, own, name: str) -> DataFrame:
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A worker that lives on builds the automaton of a broadcast once.
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = Automaton([e.encode() for e in own.value])
        automaton = _BUILT[key]
        for b in batches:
            at = b.schema.get_field_index(name)
            texts = [x or b"" for x in b.column(b.schema.get_field_index(text)).cast(pa.large_binary()).to_pylist()]
            found = [list(x or []) for x in b.column(at).to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, held = lo, 0
                while hi < len(texts) and (hi == lo or held + len(texts[hi]) <= BATCH_BYTES):
                    held += len(texts[hi])
                    hi += 1
                for t, e in zip(*(x.tolist() for x in automaton.find(texts[lo:hi]))):
                    found[lo + t].append(own.value[e])
                lo = hi
            columns = [pa.array(found, pa.list_(pa.string())) if i == at else b.column(i) for i in range(b.num_columns)]
            yield pa.record_batch(columns, b.schema.names)

    return rows.mapInArrow(run, rows.schema)
