"""Joins against brute force."""

import json
import random

import pytest

from pagelens.operators import joins
from pagelens.sources import readers


@pytest.mark.parametrize("threshold", [0.3, 0.45, 0.5, 0.8, 1.0])
def test_similar_sets(spark, threshold):
    """Sizes at the borders of classes, copies, one very frequent token, and queries that aren't among the rows."""
    rng = random.Random(int(threshold * 100))
    base = [rng.sample(range(60), rng.randint(1, 40)) for _ in range(25)]
    sets = [[f"w{x}" for x in b] for b in base]
    for b in base:
        sets.append([f"w{x}" for x in b if rng.random() < threshold] + ["hot"])
        sets.append([f"w{x}" for x in b] + ["hot"] * 2)
    sets += [[f"n{i}" for i in range(n)] for n in (1, 2, 4, 8, 16, 32)] + [[], None, ["only"]]
    rows = spark.createDataFrame(list(enumerate(sets)), "id long, ts array<string>")
    asked = {i: s for i, s in enumerate(sets) if i % 3 == 0} | {1000: sets[1], 1001: ["unseen"], 1002: []}
    got = joins.similar_sets(spark.createDataFrame(list(asked.items()), rows.schema), rows, "id", "ts", threshold).collect()
    want = {}
    for a, x in asked.items():
        for b, y in enumerate(sets):
            x_, y_ = set(x or []), set(y or [])
            if a != b and x_ and y_ and len(x_ & y_) / len(x_ | y_) >= threshold:
                want[a, b] = len(x_ & y_) / len(x_ | y_)
    assert {(r.a, r.b): r.similarity for r in got} == pytest.approx(want) and len(got) == len(want) > 10


def test_manual_lists(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id:shoes": ["http://a.x/1", "http://www.a.x/2", "ftp://n", "http://b.x"], "shoes": ["http://z.x"], "id:hats": [], "hats": ["http://c.x"]}))
    (tmp_path / "b.json").write_text(json.dumps({"coats": ["http://d.x"]}))
    asked = spark.createDataFrame([("shoes", "id"), ("shoes", "th"), ("hats", "id"), ("coats", "id"), ("none", "id")], "keyword string, region string")
    got = readers.manual_results_of(asked, readers.read_manual_lists(spark, str(tmp_path))).collect()
    assert sorted((r.keyword, r.region, r.position, r.domain) for r in got) == [("coats", "id", 1, "d.x"), ("hats", "id", 1, "c.x"), ("shoes", "id", 1, "a.x"), ("shoes", "id", 2, "b.x"), ("shoes", "th", 1, "z.x")]


def test_similar_sets_in_blocks(spark):
    """More blocks than one, a size that several share, and sets at the threshold; nothing is joined or shuffled, whatever the number of pairs that share a token."""
    rng = random.Random(5)
    sets = [["hot", *(f"w{x}" for x in rng.sample(range(30), n))] for n in [9] * 40 + list(range(1, 30)) * 2]
    rows = spark.createDataFrame([(f"d{i}", s) for i, s in enumerate(sets)], "id string, ts array<string>")
    found = joins.similar_sets(rows.where("substr(id, 2) % 3 = 0"), rows, "id", "ts", 0.5, block=2_000)
    like = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    want = {(f"d{a}", f"d{b}"): like(x, y) for a, x in enumerate(sets) if a % 3 == 0 for b, y in enumerate(sets) if a != b and like(x, y) >= 0.5}
    got = found.collect()
    assert {(r.a, r.b): r.similarity for r in got} == pytest.approx(want) and len(got) == len(want) > 100
    plan = found._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan


def packed(sets):
    """Keys and packed sets of numbers."""
    import pyarrow as pa

    from pagelens.operators import set_blocks

    b = next(set_blocks.pack([pa.RecordBatch.from_arrays([pa.array(range(len(sets))), pa.array([[x * 0x9E3779B97F4A7C15 % 2**64 - 2**63 for x in s] for s in sets], pa.list_(pa.int64()))], ["k", "t"])]))
    return b.column(0), b.column(2)


@pytest.mark.parametrize("threshold", [0.1, 0.45, 0.9])
def test_blocks_in_small_steps(monkeypatch, threshold):
    """Meetings and compared tokens in steps of a few; each similar pair is found once."""
    from pagelens.operators import set_blocks

    rng = random.Random(7)
    sets = [rng.sample(range(40), rng.randint(1, 30)) for _ in range(120)] + [list(range(n)) for n in range(1, 60)]
    every, block = packed(sets)[1], set_blocks.Block(*packed(sets[::4]), threshold)
    for name, most in (("MEETINGS", 30), ("COMPARED", 20)):
        monkeypatch.setattr(set_blocks, name, most)
    got = []
    for a, q, similarity in set_blocks._meet(block, *set_blocks._opened(every), threshold):
        got += zip((block.ids.to_numpy()[q] * 4).tolist(), a.tolist(), similarity.tolist())
    like = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    want = {(q, a): s for q, x in enumerate(sets) if q % 4 == 0 for a, y in enumerate(sets) if (s := like(x, y)) >= threshold}
    assert {(q, a): s for q, a, s in got} == pytest.approx(want) and len(got) == len(want) > 50


def test_frequent_tokens_are_not_looked_up(monkeypatch):
    """Sets that share frequent tokens alone aren't compared, and only what is rare in them is looked up."""
    from pagelens.operators import set_blocks

    sets = [[*range(40), *range(100 + 100 * i, 160 + 100 * i)] for i in range(300)]
    visited, spans = [], set_blocks._spans
    monkeypatch.setattr(set_blocks, "_spans", lambda starts, lengths: visited.append(int(lengths.sum())) or spans(starts, lengths))
    block = set_blocks.Block(*packed(sets), 0.45)
    found = list(set_blocks._meet(block, *set_blocks._opened(packed(sets)[1]), 0.45))
    assert sum(len(a) for a, _, _ in found) == len(sets) and sum(visited) < 200 * len(sets)
