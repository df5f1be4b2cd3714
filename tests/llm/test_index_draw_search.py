"""Exact dedup, importance resampling and ranked search on awkward rows, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagelens.llm import exact_dedup, importance, search
from pagelens.llm.common import terms

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return (t or "").translate(LOWER)


def first(*names):
    """Sorts by the first of the row's fields, a null before all others."""
    return lambda r: tuple((r[n] is not None, r[n] or 0) for n in names)


# -- 11 exact dedup -------------------------------------------------------------------


def brute_exact(rows):
    """rows: (doc_id, text). doc_id, keep_id, group_size, digest of every row, and the kept ids by digest."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[low(t)].append(d)
    last = {t: max(ds, key=lambda d: (d is not None, d or 0)) for t, ds in groups.items()}
    every = Counter((d, last[low(t)], len(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for d, t in rows)
    return every, Counter((last[t], hashlib.sha256(t.encode()).hexdigest()) for t in groups)


def check_exact(df, rows):
    got = df.collect()
    every, kept = brute_exact(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == every
    assert Counter((r.doc_id, r.text_sha256) for r in got if r.kept) == kept


@pytest.mark.parametrize("narrow", [False, True])
def test_exact(docs, narrow, monkeypatch):
    """With whole keys, and with keys of two bits, so that nearly all texts collide."""
    monkeypatch.setattr(exact_dedup, "BLOCK_ROWS", 4)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    key_of = (lambda digest: ((digest[0] >> 6) << 62) - (1 << 63)) if narrow else exact_dedup.first_bits
    check_exact(exact_dedup.dedup(docs, key_of, capacity=200), rows)


def test_exact_hot_group_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BLOCK_ROWS", 50)
    rows = [(i, "The HOT text" if i % 3 else f"text {i % 700}") for i in range(6000)]
    check_exact(exact_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), capacity=64), rows)


def test_exact_empty_and_extra_columns(docs, empty):
    assert exact_dedup.dedup(empty).count() == 0 and exact_dedup.kept_documents(empty).count() == 0
    stay = exact_dedup.kept_documents(docs)
    assert stay.columns == docs.columns
    _, kept = brute_exact([(r.doc_id, r.text) for r in docs.collect()])
    assert Counter((r.doc_id, hashlib.sha256(low(r.text).encode()).hexdigest()) for r in stay.collect()) == kept
    left = Counter(map(str, stay.collect())) - Counter(map(str, docs.collect()))
    assert not left


def test_directory_doubles_only_where_it_must(spark):
    """Slots lead to the right buckets, no splittable bucket is over its capacity, and buckets are whole ranges of keys."""
    rng = random.Random(3)
    keys = [rng.getrandbits(64) - (1 << 63) for _ in range(500)] + [(5 << 60) + i for i in range(300)]
    rows = [(k, "x" * rng.randint(1, 40)) for k in keys]
    bucket, depth = exact_dedup.directory(spark.createDataFrame(rows, "key long, text string"), capacity=900)
    assert len(bucket) == 1 << depth
    load, held = Counter(), defaultdict(set)
    for k, t in rows:
        b = bucket[(k & (1 << 64) - 1) >> (64 - depth)]
        load[b] += len(t)
        held[b].add(k)
    # Keys that agree in all bits of the directory stay in one bucket.
    assert all(load[b] <= 900 or len({(k & (1 << 64) - 1) >> (64 - exact_dedup.MAX_DEPTH) for k in ks}) == 1 for b, ks in held.items())
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    assert len(starts) == len(set(bucket.tolist()))


# -- 12 importance resampling -----------------------------------------------------------


def brute_features(text, longest, buckets):
    w = TERM.findall(low(text))
    grams = [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
    return [zlib.crc32(g.encode()) % buckets for g in grams], len(w)


def brute_draw(rows, target, longest, buckets, percent, least):
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(brute_features(x, longest, buckets)[0])
    for x in target:
        t.update(brute_features(x, longest, buckets)[0])
    ss, tt = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in range(buckets)}
    out = []
    for d, x in rows:
        own, n_words = brute_features(x, longest, buckets)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"2024:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((d, len(own), weight, score, n_words))
    ranked = sorted((r for r in out if r[3] is not None and r[4] >= least), key=lambda r: (-r[3], r[0]))
    takes = percent * len(ranked) // 100
    return Counter(r[:4] for r in out), [(r[3], r[0]) for r in ranked[:takes]]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_importance(spark, docs, longest, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK_BYTES", 3000)
    target = spark.createDataFrame([("alpha1 beta2 gamma3 delta4",), (None,), ("",), ("epsilon5 Alpha1 beta2",)], "text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    every, ranked = brute_draw(rows, [r.text for r in target.collect()], longest, 500, 40, 20)
    got = importance.resample(docs, target, longest=longest, buckets=500, percent=40).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == every
    drawn = sorted((r for r in got if r.rank is not None), key=lambda r: r.rank)
    assert [r.rank for r in drawn] == list(range(1, len(ranked) + 1))
    assert [(r.score, r.doc_id) for r in drawn] == ranked


def test_importance_edges(spark, docs, empty):
    target = spark.createDataFrame([("alpha1",)], "text string")
    assert importance.resample(empty, target).count() == 0
    assert importance.resample(docs, target.limit(0)).count() == docs.count()
    all_of = importance.drawn_documents(docs, target, percent=100)
    assert all_of.columns == docs.columns
    assert all(r.doc_id is not None and len(TERM.findall(low(r.text))) >= 20 for r in all_of.collect())
    assert importance.drawn_documents(docs, target, percent=0).count() == 0


def test_runs_of_equal_ngrams_are_neighbours():
    """The order sorts by the first words, and what it shares with its neighbour is the common prefix."""
    rng = random.Random(1)
    ids = np.array([rng.randint(0, 3) for _ in range(400)])
    for depth in (1, 2, 3, 5):
        order = importance.suffix_order(ids, depth)
        heads = [(*ids[p : p + depth], *[0] * depth)[:depth] for p in order]
        assert heads == sorted(heads) and sorted(order) == list(range(400))


# -- 13 ranked search --------------------------------------------------------------------


def brute_search(rows, items, k):
    docs = [(d, Counter(TERM.findall(low(t)))) for d, t in rows]
    docs = [(d, c) for d, c in docs if c]
    n_docs, all_terms = len(docs), sum(c.total() for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for w, n in df.items()}
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(TERM.findall(low(t)))
    out = {}
    for i, words in asked.items():
        scores = []
        for d, c in docs:
            m = 50 + 50 * c.total() * n_docs // all_terms
            s = sum(weight[w] * (1000000000 * c[w] // (1000 * c[w] + 20 * m)) for w in words if w in c)
            if s > 0:
                scores.append((-s, d is not None, d or 0))
        if scores:
            out[i] = [(d if there else None, -s) for s, there, d in sorted(scores)[:k]]
    return out


def check_search(df, rows, items, k):
    got = defaultdict(dict)
    for r in df.collect():
        assert r["rank"] not in got[r.item_id]
        got[r.item_id][r["rank"]] = (r.doc_id, r.score)
    want = brute_search(rows, items, k)
    assert {i: [x[n] for n in sorted(x)] for i, x in got.items()} == want
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in got.values())


@pytest.mark.parametrize("at_once", [7, 500_000])
def test_search_awkward(spark, docs, at_once):
    items = [(1, "alpha1 beta2 gamma3 nowhere"), (2, None), (3, ""), (4, "日本語のテキスト one"), (None, "One TWO"), (5, "alpha1"), (5, "delta4 ab"), (6, "nothing known here at allx")]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_search(search.search(docs, spark.createDataFrame(items, "item_id int, text string"), k=5, at_once=at_once), rows, items, 5)


@pytest.mark.parametrize("seed", [1, 2])
def test_search_random(spark, seed, monkeypatch):
    """Frequent and rare terms, copies that tie, and blocks of few documents."""
    monkeypatch.setattr(search, "CELLS", 40)
    monkeypatch.setattr(search, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(search, "KEPT", 20 if seed == 2 else 200_000)
    monkeypatch.setattr(search, "CANDIDATES", 10 if seed == 2 else 1_000_000)
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    odds = [1 / (i + 1) for i in range(300)]
    texts = [" ".join(rng.choices(words, odds, k=rng.choice([3, 20, 200]))) for _ in range(300)]
    rows = list(enumerate(texts + texts[:80] + [texts[0]] * 60))
    items = [(i, " ".join(rng.choices(words, odds if i % 2 else None, k=rng.randint(1, 30)))) for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check_search(search.search(docs, spark.createDataFrame(items, "item_id long, text string"), k=10), rows, items, 10)


def test_search_empty(spark, docs, empty):
    items = spark.createDataFrame([(1, "alpha1")], "item_id long, text string")
    assert search.search(empty, items).count() == 0
    none = search.search(docs, items.limit(0))
    assert none.columns == ["item_id", "rank", "doc_id", "score"] and none.count() == 0


def test_terms():
    for t in ("", "Ab9-c_d É日本 ×x\x7f\x00y", "İK ſ"):
        assert [w.decode() for w in terms(t.encode())] == TERM.findall(low(t))
