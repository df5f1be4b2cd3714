"""Near duplicates by one-permutation MinHash.

A document's set holds the 64-bit hashes of its distinct 5-word shingles. One hash
deals them to BINS bins and orders them in each; the least of a bin is its value.
An empty bin borrows from the first non-empty one in its own fixed random order of
bins (optimal densification). ROWS bins make a band. Documents with equal sets are
one class, and only its smallest id goes on.

Band keys are range-sorted together with the next band's key. In each bucket, every
member gets an edge to the bucket's least member (a star) and one to the member
before it, so a bucket of n members gives under 2n pairs. Pairs whose sizes rule the
threshold out go. The rest are confirmed on full sets: first the best pair of each
document, then those that still lie in different components.

What these edges leave apart is settled exactly. A bucket that still holds several
components, cut by a task border or not, gives its pair if it has two members; the
members of larger ones are joined by prefix: with shingles ordered by the number of
members that hold them, two similar sets share one among the first of each, and
what its places leave must suffice for the threshold. The members of a shingle meet
CENTRES drawn centres first, whose links merge components, and then whoever is still
in another component; pairs inside a component are never joined.

A pair at similarity s shares no bucket with probability (1 - s^ROWS)^BANDS: 2.5e-7
at 0.75, below 1e-10 at 0.8.

Defined results: null or blank text has an empty set, which links with nothing;
fewer than five words are one shingle; rows that repeat a doc_id are one node; a
null doc_id links with nothing and has a null component; texts of any length are one
set; equal sets are one class, tied by the smallest id; an empty table gives no rows;
extra columns, whatever their names, stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, in_blocks, ints, mix, prefix_hash, span_hash, thrifty, utf8, workers_find_us
from .components import components

SHINGLE = 5
BANDS, ROWS = 40, 4
BINS = BANDS * ROWS
THRESHOLD = 75  # percent
CENTRES = 3
_SALT = mix(np.arange(1, 65, dtype=U64) * U64(0xC2B2AE3D27D4EB4F)) | U64(1)
_BAND_SALT = mix(np.arange(1, BANDS + 1, dtype=U64) * U64(0xA0761D6478BD642F))
_ORDER = np.stack([np.random.default_rng([11, i]).permutation(BINS) for i in range(BINS)])
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for lo, hi in in_blocks(texts, len, 1 << 20):
        data = np.frombuffer(b" ".join(texts[lo:hi]).lower() + b" ", np.uint8)
        space = _IS_SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(data) and not space[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[::2], edge[1::2]
        prefix = prefix_hash(data)
        words = span_hash(prefix, start, end)
        n = len(words) - SHINGLE + 1
        shingles = np.zeros(max(n, 0), U64)
        for j in range(SHINGLE if n > 0 else 0):
            shingles += words[j : j + n] * _SALT[j]
        shingles = mix(shingles)
        size = np.array([len(t) + 1 for t in texts[lo:hi]], np.int64)
        stop = np.searchsorted(start, np.cumsum(size)).tolist()
        first = 0
        for last in stop:
            m = last - first
            if m >= SHINGLE:
                yield np.unique(shingles[first : last - SHINGLE + 1])
            elif m:
                yield mix((words[first:last] * _SALT[:m]).sum(dtype=U64, keepdims=True) + _SALT[32 + m : 33 + m])
            else:
                yield np.zeros(0, U64)
            first = last


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """The keys of the bands of a non-empty sorted set."""
    bins = ((shingles >> U64(32)) * U64(BINS) >> U64(32)).astype(np.int64)
    head = np.concatenate([[True], bins[1:] != bins[:-1]])
    value = np.zeros(BINS, U64)
    own = bins[head]
    value[own] = shingles[head]
    if len(own) < BINS:
        full = np.zeros(BINS, bool)
        full[own] = True
        empty = np.flatnonzero(~full)
        order = _ORDER[empty]
        value[empty] = value[order[np.arange(len(empty)), full[order].argmax(1)]]
    return mix((value.reshape(BANDS, ROWS) * _SALT[40 : 40 + ROWS]).sum(1, dtype=U64) + _BAND_SALT)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, s1, s2 (sums that identify the set), keys array<long>."""
    workers_find_us(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, s1, s2, keys = [], [], [], []
            for s in shingle_sets(utf8(b, "text")):
                n.append(len(s))
                s1.append(s.sum(dtype=U64))
                s2.append(mix(s ^ _SALT[20]).sum(dtype=U64))
                keys.append(band_keys(s).view(np.int64) if len(s) else None)
            columns = [
                pa.array(ints(b, "doc_id"), pa.int64()), pa.array(n, pa.int64()), pa.array(np.array(s1, U64).view(np.int64)),
                pa.array(np.array(s2, U64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())),
            ]
            yield pa.record_batch(columns, ["doc_id", "n_shingles", "s1", "s2", "keys"])

    return docs.select("doc_id", "text").mapInArrow(thrifty(run), "doc_id long, n_shingles long, s1 long, s2 long, keys array<long>")


def sets_of(docs: DataFrame) -> DataFrame:
    workers_find_us(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = ints(b, "doc_id"), utf8(b, "text")
            for lo in range(0, len(keys), 256):
                own = [s.view(np.int64) for s in shingle_sets(texts[lo : lo + 256])]
                yield pa.record_batch([pa.array(keys[lo : lo + 256], pa.int64()), pa.array(own, pa.list_(pa.int64()))], ["doc_id", "set"])

    return docs.select("doc_id", "text").mapInArrow(thrifty(run), "doc_id long, set array<long>")


def bucket_rows(reps: DataFrame, threshold: int) -> DataFrame:
    """Edges a < b (key null), and the members a of size n of each bucket, key.

    Buckets of one member are left out, but for those at the borders of batches.
    """
    bands = reps.select("doc_id", "n_shingles", F.posexplode("keys").alias("i", "key"), "keys")
    bands = bands.select("key", F.get("keys", (F.col("i") + 1) % BANDS).alias("next"), "doc_id", "n_shingles")
    bands = bands.repartitionByRange("key", "next", "doc_id").sortWithinPartitions("key", "next", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The bucket that the last batch ended in: key, least member so far, last member, their sizes.
        carry = None
        for batch in batches:
            key, doc, n = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("key", "doc_id", "n_shingles"))
            if not len(key):
                continue
            own = 0
            if carry is not None and carry[0][0] == key[0]:
                own = 2
                key, doc, n = (np.concatenate([c, x]) for c, x in zip(carry, (key, doc, n)))
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(head, len(key)))
            # The least member of each bucket is its centre.
            order = np.lexsort((doc, np.repeat(np.arange(len(head)), size)))
            centre = np.repeat(order[head], size)
            before = np.maximum(np.arange(len(key)) - 1, np.repeat(head, size))
            at = np.arange(len(key))
            ends = [order[head[-1]], len(key) - 1]
            carry = tuple(x[ends] for x in (key, doc, n))
            shared = np.repeat(size > 1, size)
            shared[: size[0]] = shared[len(key) - size[-1] :] = True
            shared[:own] = False
            left, right = [], []
            for other in (centre, before):
                ok = (doc[other] != doc) & ((at >= own) | (other >= own))
                if other is before:
                    ok &= before != centre
                ok &= 100 * np.minimum(n, n[other]) >= threshold * np.maximum(n, n[other])
                left.append(np.minimum(doc[ok], doc[other[ok]]))
                right.append(np.maximum(doc[ok], doc[other[ok]]))
            none = pa.nulls(sum(map(len, left)), pa.int64())
            nobody = pa.nulls(int(shared.sum()), pa.int64())
            yield pa.record_batch(
                [
                    pa.concat_arrays([pa.array(np.concatenate(left)), pa.array(doc[shared])]), pa.concat_arrays([pa.array(np.concatenate(right)), nobody]),
                    pa.concat_arrays([none, pa.array(key[shared])]), pa.concat_arrays([none, pa.array(n[shared])]),
                ],
                ["a", "b", "key", "n"],
            )

    return bands.mapInArrow(thrifty(run), "a long, b long, key long, n long")


def confirm(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    both = pairs.select("a", "b").join(sets.toDF("b", "set_b"), "b").join(sets.toDF("a", "set_a"), "a")
    both = both.withColumn("n", F.size(F.array_intersect("set_a", "set_b")))
    return both.where(100 * F.col("n") >= threshold * (F.size("set_a") + F.size("set_b") - F.col("n"))).select("a", "b")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs."""
    scratch = Scratch(docs.sparkSession)
    sig = scratch.put(signatures(docs), "signatures")
    same = ["n_shingles", "s1", "s2"]
    classes = scratch.put(sig.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("rep")), "classes")
    reps = sig.select("doc_id", "keys", *same).join(classes, [*same]).where("doc_id = rep")
    rows = scratch.put(bucket_rows(reps.select("doc_id", "n_shingles", "keys"), threshold), "buckets")
    pairs = scratch.put(rows.where("key is null").groupBy("a", "b").agg(F.count("*").alias("bands")), "pairs")
    members = rows.where("key is not null").select("key", F.col("a").alias("doc_id"), "n")
    wanted = members.select("doc_id").distinct()
    # One plan at every size: the ids grow with the corpus, so they are never broadcast.
    sets = scratch.put(sets_of(docs.select("doc_id", "text").join(wanted.hint("merge"), "doc_id", "left_semi")), "sets")
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("bands", -F.col("a"))).alias("a"))
    links = scratch.put(confirm(best, sets, threshold), "links")
    labels = components(links, scratch)
    rest = _apart(pairs.join(best, ["a", "b"], "left_anti"), labels)
    more = scratch.put(confirm(rest, sets, threshold), "more")
    labels = _merge(labels, more, scratch)
    final = settle(members, sets, labels, threshold, scratch).toDF("rep", "component")
    scratch.drop(sets, pairs, rows)
    every = sig.select("doc_id", *same).join(classes, same, "left").join(final, "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return every.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def _unsettled(members: DataFrame, sets: DataFrame, labels: DataFrame, threshold: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs a < b of the buckets of two, and s, doc_id, v, n, at of the first shingles of the members of other buckets that hold several components."""
    own = labels.toDF("doc_id", "label")
    named = members.join(own, "doc_id", "left").select("key", F.coalesce("label", "doc_id").alias("label"), F.struct("doc_id", "n").alias("m"))
    buckets = named.groupBy("key").agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("m").alias("x"), F.max("m").alias("y"))
    mixed = scratch.put(buckets.where("lo <> hi").select("key", "size", "x", "y"), "mixed")
    twos = mixed.where("size = 2").where(_fits(F.col("x.n"), F.col("y.n"), threshold)).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
    todo = members.join(mixed.where("size > 2").select("key"), "key", "left_semi").select("doc_id").distinct()
    todo = scratch.put(todo, "unsettled")
    # A doc_id may have several sets.
    each = sets.join(todo, "doc_id").select("doc_id", F.xxhash64("set").alias("v"), F.size("set").cast("long").alias("n"), F.explode("set").alias("s"))
    held = each.groupBy("s").agg(F.count("*").alias("c"))
    ranked = each.join(held, "s").groupBy("doc_id", "v", "n").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("order"))
    # A set of n shares at least threshold % of them with a similar one, and 2t / (1 + t) of them with one that is no smaller.
    long = F.slice("order", 1, (F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1).cast("int"))
    firsts = ranked.select("doc_id", "v", "n", F.posexplode(long).alias("at", "e"))
    firsts = firsts.where("e.c > 1").select(F.col("e.s").alias("s"), "doc_id", "n", "at").distinct()
    return twos, scratch.put(firsts, "firsts")


def _fits(a, b, threshold: int):
    return (100 * a >= threshold * b) & (100 * b >= threshold * a)


def _may_match(threshold: int):
    """Whether members a and b (na, pa and nb, pb: size, place of the shared shingle) of different components la, lb can be similar."""
    c = F.col
    left = F.least(c("na") - c("pa"), c("nb") - c("pb"))
    short = F.when(c("na") <= c("nb"), (100 + threshold) * (c("na") - c("pa")) >= 2 * threshold * c("na")).otherwise((100 + threshold) * (c("nb") - c("pb")) >= 2 * threshold * c("nb"))
    return (c("la") != c("lb")) & _fits(c("na"), c("nb"), threshold) & short & ((100 + threshold) * left >= threshold * (c("na") + c("nb")))


def settle(members: DataFrame, sets: DataFrame, labels: DataFrame, threshold: int, scratch: Scratch) -> DataFrame:
    """node, component after every link that star and neighbour edges left apart.

    The members of a shingle first meet a few centres of it, drawn anew each round, and
    what links merges: a large family grows together in linear steps. Only members of
    components that are still different then meet each other.
    """
    twos, firsts = _unsettled(members, sets, labels, threshold, scratch)
    labels = _merge(labels, scratch.put(confirm(twos, sets, threshold), "twos"), scratch)
    if firsts.isEmpty():
        return labels
    label = lambda t, d, to: t.join(labels.toDF(d, to), d, "left").withColumn(to, F.coalesce(to, d))
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    for turn in range(CENTRES):
        own = scratch.put(label(firsts, "doc_id", "label"), "labelled")
        # A component sends its member of least hash to each shingle, so that a component costs a shingle one row.
        one = own.groupBy("s", "label").agg(F.min_by(F.struct("doc_id", "n", "at"), F.xxhash64(F.lit(turn), "doc_id")).alias("m"))
        centre = one.groupBy("s").agg(F.min_by(F.struct("label", "m"), F.xxhash64(F.lit(turn), "label")).alias("c"), F.count("*").alias("k")).where("k > 1").select("s", "c")
        met = own.toDF("s", "a", "na", "pa", "la").join(scratch.put(centre, "centre").select("s", F.col("c.label").alias("lb"), F.col("c.m.doc_id").alias("b"), F.col("c.m.n").alias("nb"), F.col("c.m.at").alias("pb")), "s")
        todo = scratch.put(met.where(_may_match(threshold)).select(*pair).distinct(), "met")
        if todo.isEmpty():
            break
        labels = _merge(labels, scratch.put(confirm(todo, sets, threshold), "confirmed"), scratch)
    own = scratch.put(label(firsts, "doc_id", "label"), "labelled")
    several = own.groupBy("s").agg((F.min("label") != F.max("label")).alias("several")).where("several").select("s")
    own = scratch.put(own.join(several, "s", "left_semi"), "several")
    if own.isEmpty():
        return labels
    # One of both is at a place that suffices for the smaller set.
    near = own.where((100 + threshold) * (F.col("n") - F.col("at")) >= 2 * threshold * F.col("n"))
    both = near.toDF("s", "a", "na", "pa", "la").join(own.toDF("s", "b", "nb", "pb", "lb"), "s").where("na < nb or (na = nb and a < b)").where(_may_match(threshold))
    todo = scratch.put(both.select(*pair).distinct(), "rest")
    if todo.isEmpty():
        return labels
    return _merge(labels, scratch.put(confirm(todo, sets, threshold), "missed"), scratch)


def _merge(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component after further links between the components."""
    if links.isEmpty():
        return labels
    joined = _apart(links, labels).select(F.col("la").alias("a"), F.col("lb").alias("b"))
    over = scratch.put(components(joined, scratch).toDF("component", "top"), "over")
    known = labels.join(over, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    # Nodes that had no link so far.
    fresh = over.select(F.col("component").alias("node"), F.col("top").alias("component")).join(labels.select("node"), "node", "left_anti")
    return scratch.put(known.unionByName(fresh), "merged")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs in different components so far, with their labels la and lb."""
    out = pairs.join(labels.toDF("a", "la"), "a", "left").join(labels.toDF("b", "lb"), "b", "left")
    out = out.withColumn("la", F.coalesce("la", "a")).withColumn("lb", F.coalesce("lb", "b"))
    return out.where("la <> lb").select("a", "b", F.least("la", "lb").alias("la"), F.greatest("la", "lb").alias("lb"))


def kept_documents(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """docs with one document of each component; all columns, whatever their names, as they were. Rows that repeat a kept doc_id stay."""
    gone = near_duplicates(docs, threshold).where(~F.col("kept")).select(F.col("doc_id").alias("_d")).distinct()
    own = docs.select(F.col("doc_id").alias("_i"), F.struct("*").alias("_row"))
    return own.join(gone, F.col("_i") == F.col("_d"), "left_anti").select("_row.*")
