"""Embedding near duplicates by an epsilon grid order join.

Vectors are normalised; cosine >= t is then distance <= sqrt(2 - 2t) = eps. They are
projected to their leading principal dimensions, whose grid cells of side eps sort
each label's vectors into a sequence. The sequence is cut into blocks that carry
their bounding box, and blocks hang in a tree of FANOUT. Pairs of intervals are
joined from the root of the tree down, and a pair whose boxes are over eps apart in
any principal dimension is skipped: projecting never makes distances longer. Pairs
of blocks that remain are joined by the same recursion on halves inside a task, and
at its end by a product of matrices in double precision, whose cosines decide.

Equal vectors of a label are one class before the join, so large groups of copies
cost nothing. A block pair returns link counts and one edge for each linked row, to
its least connected id within the pair; links themselves are never listed.

Defined results: a null label, a null or empty vector, a zero vector, null or
non-finite components, and a null vec_id link with nothing; vectors of different
length are not compared; rows that repeat a vec_id are counted as vectors of their
own and belong to one node; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, ints, thrifty, workers_find_us
from .components import components

LEADING = 6
BLOCK = 1024
LEAF = 128
FANOUT = 16
#: Slack for rounding in the skip tests, which must never skip a link.
SLACK = 1e-6


def _matrix(b: pa.RecordBatch, name: str) -> np.ndarray:
    col = b.column(b.schema.get_field_index(name))
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _by_length(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    d = b.column(b.schema.get_field_index("d")).to_numpy(zero_copy_only=False)
    for n in np.unique(d).tolist():
        yield n, b if (d == n).all() else b.take(pa.array(np.flatnonzero(d == n)))


def leading_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """The leading eigenvectors of the second moments, by vector length; moments are summed across partitions, a row of the matrix at a time.

    The driver gets d rows of d numbers for each vector length: 134 MB at 4,096 dimensions, whatever the number of vectors.
    """
    names, schema = ["d", "i", "x"], "d long, i long, x binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for d, part in _by_length(b):
                u = _unit(_matrix(part, "embedding"))
                sums[d] = sums.get(d, 0) + u.T @ u
        for d, m in sums.items():
            yield pa.record_batch([pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array([r.tobytes() for r in m], pa.binary())], names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for d, i, x in zip(*(ints(b, c) for c in names)):
                sums[d, i] = sums.get((d, i), 0) + np.frombuffer(x)
        if sums:
            yield pa.record_batch([pa.array([k[0] for k in sums], pa.int64()), pa.array([k[1] for k in sums], pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names)

    moments = classes.select("d", "embedding").mapInArrow(thrifty(run), schema).repartition("d", "i").mapInArrow(thrifty(add), schema).toArrow()
    rows: dict[int, dict[int, bytes]] = {}
    for d, i, x in zip(*(moments[c].to_pylist() for c in names)):
        rows.setdefault(d, {})[i] = x
    return {d: np.linalg.eigh(np.stack([np.frombuffer(own[i]) for i in range(d)]))[1][:, ::-1][:, :LEADING] for d, own in rows.items()}


def to_blocks(classes: DataFrame, axes: dict[int, np.ndarray], eps: float) -> DataFrame:
    """label, d, block, lo, hi, ids, counts, vectors: at most BLOCK neighbours of a label's sequence in a row."""
    cells = [f"c{i}" for i in range(LEADING)]
    wide = "label long, d long, rep long, n long, embedding binary, place array<double>, " + ", ".join(f"{c} long" for c in cells)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, part in _by_length(b):
                x = _matrix(part, "embedding")
                y = np.zeros((len(x), LEADING))
                y[:, : axes[d].shape[1]] = _unit(x) @ axes[d]
                cell = np.floor(y / eps).astype(np.int64)
                own = [part.column(part.schema.get_field_index(c)) for c in ("label", "d", "rep", "n")]
                raw = pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.record_batch([*own, raw, pa.array(list(y), pa.list_(pa.float64())), *[pa.array(cell[:, i]) for i in range(LEADING)]], ["label", "d", "rep", "n", "embedding", "place", *cells])

    order = ["label", "d", *cells, "rep"]
    ordered = classes.mapInArrow(thrifty(project), wide).repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[dict] = []

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            place = np.array([r["place"] for r in held])
            row = [
                [held[0]["label"]], [held[0]["d"]], [number], [place.min(0).tolist()], [place.max(0).tolist()],
                [np.array([r["rep"] for r in held], np.int64).tobytes()], [np.array([r["n"] for r in held], np.int64).tobytes()],
                [b"".join(r["embedding"] for r in held)], [place.tobytes()],
            ]
            number, held = number + 1, []
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), *[pa.binary()] * 4]
            return pa.record_batch([pa.array(v, k) for v, k in zip(row, kinds)], ["label", "d", "block", "lo", "hi", "ids", "counts", "vectors", "places"])

        for b in batches:
            for r in b.select(["label", "d", "rep", "n", "embedding", "place"]).to_pylist():
                if held and (len(held) == BLOCK or (held[0]["label"], held[0]["d"]) != (r["label"], r["d"])):
                    yield flush()
                held.append(r)
        if held:
            yield flush()

    return ordered.mapInArrow(thrifty(cut), "label long, d long, block long, lo array<double>, hi array<double>, ids binary, counts binary, vectors binary, places binary")


def near_intervals(blocks: DataFrame, scratch: Scratch, eps: float) -> DataFrame:
    """a <= b: the blocks of a label that aren't provably distant, from the root of the interval tree down."""
    order = Window.partitionBy("label", "d").orderBy("block")
    level = scratch.put(blocks.select("label", "d", "lo", "hi", "block", (F.row_number().over(order) - 1).alias("node")), "level")
    levels = [level]
    size = level.agg(F.max("node")).first()[0] or 0
    side = lambda f, c: F.array(*[f(F.col(c)[i]) for i in range(LEADING)])
    while size > 0:
        up = levels[-1].groupBy("label", "d", F.floor(F.col("node") / FANOUT).alias("node")).agg(side(F.min, "lo").alias("lo"), side(F.max, "hi").alias("hi"))
        levels.append(scratch.put(up, "level"))
        size //= FANOUT
    top = levels[-1]
    pairs = top.select("label", "d", F.col("node").alias("i"), F.col("node").alias("j"))
    for below in reversed(levels[:-1]):
        own = below.select("label", "d", "node", "lo", "hi", F.floor(F.col("node") / FANOUT).alias("up"))
        a = own.toDF("label", "d", "ni", "lo_i", "hi_i", "i")
        b = own.toDF("label", "d", "nj", "lo_j", "hi_j", "j")
        met = pairs.join(a, ["label", "d", "i"]).join(b, ["label", "d", "j"]).where("ni <= nj")
        for k in range(LEADING):
            met = met.where((F.col("lo_i")[k] - F.col("hi_j")[k] <= eps + SLACK) & (F.col("lo_j")[k] - F.col("hi_i")[k] <= eps + SLACK))
        pairs = scratch.put(met.select("label", "d", F.col("ni").alias("i"), F.col("nj").alias("j")), "pairs")
    name = level.select("label", "d", "node", "block")
    pairs = pairs.join(name.toDF("label", "d", "i", "a"), ["label", "d", "i"]).join(name.toDF("label", "d", "j", "b"), ["label", "d", "j"])
    return pairs.select("a", "b")


def _join_intervals(u, v, pu, pv, eps, t, met) -> None:
    """Marks the close pairs of two intervals in met, by halves of the longer one."""
    todo = [(0, len(u), 0, len(v))]
    while todo:
        a, b, c, d = todo.pop()
        if (pu[a:b].min(0) - pv[c:d].max(0) > eps + SLACK).any() or (pv[c:d].min(0) - pu[a:b].max(0) > eps + SLACK).any():
            continue
        if b - a <= LEAF and d - c <= LEAF:
            met[a:b, c:d] = u[a:b] @ v[c:d].T >= t
        elif b - a >= d - c:
            m = (a + b) // 2
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            todo += [(a, b, c, m), (a, b, m, d)]


def _least_linked(met: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows and columns of met, the least id connected to each within it."""
    i, j = np.nonzero(met)
    while True:
        na, nb = a.copy(), b.copy()
        np.minimum.at(na, i, b[j])
        np.minimum.at(nb, j, na[i])
        if (na == a).all() and (nb == b).all():
            return na, nb
        a, b = na, nb


def link(blocks: DataFrame, pairs: DataFrame, eps: float, t: float, dtype: str) -> DataFrame:
    """rep, links, hook: counts of linked vectors and an edge, for each block pair and row with links."""
    left = blocks.select(F.col("block").alias("a"), "d", F.struct("ids", "counts", "vectors", "places").alias("x"))
    right = blocks.select(F.col("block").alias("b"), F.struct("ids", "counts", "vectors", "places").alias("y"))
    both = pairs.join(left, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                same = r["a"] == r["b"]
                side = lambda s: (
                    np.frombuffer(s["ids"], np.int64), np.frombuffer(s["counts"], np.int64),
                    _unit(np.frombuffer(s["vectors"], dtype).reshape(-1, r["d"])), np.frombuffer(s["places"]).reshape(-1, LEADING),
                )
                ia, na, u, pu = side(r["x"])
                ib, nb, v, pv = side(r["y"])
                met = np.zeros((len(ia), len(ib)), bool)
                _join_intervals(u, v, pu, pv, eps, t, met)
                if same:
                    np.fill_diagonal(met, False)
                ca, cb = met @ nb, na @ met
                la, lb = _least_linked(met, ia, ib)
                rows = [(ia, ca, la)] if same else [(ia, ca, la), (ib, cb, lb)]
                for ids, count, least in rows:
                    ok = count > 0
                    yield pa.record_batch([pa.array(ids[ok]), pa.array(count[ok]), pa.array(least[ok])], ["rep", "links", "hook"])

    return both.mapInArrow(thrifty(run), "rep long, links long, hook long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of vectors."""
    spark = vectors.sparkSession
    workers_find_us(spark)
    scratch = Scratch(spark)
    eps = math.sqrt(2 - 2 * cosine)
    kind = vectors.schema["embedding"].dataType.elementType
    dtype = "float32" if isinstance(kind, T.FloatType) else "float64"
    vectors = vectors.select("vec_id", F.col("embedding").cast("array<float>" if dtype == "float32" else "array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall("embedding", lambda x: x == 0)
    good = vectors.where("vec_id is not null and label is not null and embedding is not null and size(embedding) > 0").where(~odd & ~zero)
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = scratch.put(classes.select("label", F.size("embedding").cast("long").alias("d"), "rep", "n", "embedding"), "classes")
    blocks = scratch.put(to_blocks(classes, leading_axes(classes), eps), "blocks")
    pairs = scratch.put(near_intervals(blocks, scratch, eps), "near")
    found = scratch.put(link(blocks, pairs, eps, cosine, dtype), "links")
    labels = components(found.select(F.col("rep").alias("a"), F.col("hook").alias("b")), scratch)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    about = classes.select("label", "embedding", "rep", "n").join(links, "rep", "left").join(labels.toDF("rep", "component"), "rep", "left")
    about = about.select("label", "embedding", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = vectors.join(about, ["label", "embedding"], "left")
    named = F.col("vec_id").isNotNull()
    links, component = F.when(named, F.coalesce("links", F.lit(0))).otherwise(0), F.when(named, F.coalesce("component", "vec_id"))
    return out.select("vec_id", links.cast("long").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )
