"""Versioned tables, the event log, the data source, stateful streams, dictionaries and medians."""

import json
import os
import random
import statistics
import subprocess
import sys
import threading
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from pagelens.operators import automaton, joins
from pagelens.operators.medians import medians
from pagelens.sources import provider_source
from pagelens.sources.changes import changes
from pagelens.sources.snapshots import Conflict, Snapshots
from pagelens.streaming import event_log, stateful

SECOND = 1_000_000


# -- versions --------------------------------------------------------------------------


@pytest.fixture
def accounts(spark, tmp_path):
    t = Snapshots(spark, str(tmp_path / "t"))
    t.create(spark.range(100).select("id", F.lit(0).alias("n")), ["id"], buckets=8, next_id=100)
    return t


def rows(df):
    return sorted(map(tuple, df.collect()))


def keys_of_buckets(t, wanted):
    """Ids whose bucket is wanted."""
    m = t.manifest()
    return [r.id for r in t.read().select("id", t._bucket(m).alias("b")).collect() if r.b in wanted]


def test_changes_keep_old_versions(spark, accounts):
    before = accounts.read()
    accounts.upsert(spark.createDataFrame([(3, 9), (500, 1)], "id long, n int"))
    accounts.delete(spark.createDataFrame([(4,), (4,), (999,)], "id long"))
    accounts.update(F.col("id") == 5, {"n": F.lit(7)})
    want = {i: 0 for i in range(100) if i != 4} | {3: 9, 500: 1, 5: 7}
    assert rows(accounts.read()) == sorted(want.items())
    assert rows(before) == [(i, 0) for i in range(100)] == rows(accounts.read(1))  # a reader keeps its version
    with pytest.raises(LookupError):
        accounts.update(F.col("id") == 12345, {"n": F.lit(1)})
    assert accounts.delete(spark.createDataFrame([], "id long")) == accounts.versions()[-1]
    with pytest.raises(Conflict):
        Snapshots(spark, accounts.root).create(spark.range(1).select("id", F.lit(0).alias("n")), ["id"])


def test_every_row_may_go(spark, accounts):
    accounts.delete(accounts.read().select("id"))
    assert accounts.read().count() == 0 and accounts.read().columns == ["id", "n"]
    accounts.upsert(spark.createDataFrame([(1, 1)], "id long, n int"))
    assert rows(accounts.read()) == [(1, 1)]


def race(t, spark, change, second):
    """``second`` is committed while ``change`` has read its version and written its rows, but not committed. What change gives."""
    ready, go, out = threading.Event(), threading.Event(), []
    claim = t._claim

    def slow(m):
        if not ready.is_set():
            ready.set()
            go.wait(60)
        return claim(m)

    t._claim = slow

    def run():
        try:
            out.append(change())
        except Conflict as e:
            out.append(e)

    thread = threading.Thread(target=run)
    thread.start()
    assert ready.wait(60)
    Snapshots(spark, t.root).upsert(second)
    go.set()
    thread.join(120)
    return out[0]


def one_more(t, spark, id_, retries=5):
    one = spark.createDataFrame([(id_,)], "id long")
    return lambda: t.change(t._of(one), lambda old, _: old.withColumn("n", F.col("n") + (F.col("id") == id_).cast("int")), retries)


def test_writers_of_other_buckets_both_commit(spark, accounts):
    a, b = keys_of_buckets(accounts, {0})[0], keys_of_buckets(accounts, {1})[0]
    assert race(accounts, spark, one_more(accounts, spark, a), spark.createDataFrame([(b, 50)], "id long, n int")) == 3
    got = dict(rows(accounts.read()))
    assert got[a] == 1 and got[b] == 50 and len(got) == 100


def test_writers_of_one_bucket_see_each_other(spark, accounts):
    """The second change is worked out again from what the first committed: no update is lost."""
    a = keys_of_buckets(accounts, {0})[0]
    assert race(accounts, spark, one_more(accounts, spark, a), spark.createDataFrame([(a, 50)], "id long, n int")) == 3
    assert dict(rows(accounts.read()))[a] == 51


def test_a_writer_that_may_not_try_again_is_refused(spark, accounts):
    a = keys_of_buckets(accounts, {0})[0]
    out = race(accounts, spark, one_more(accounts, spark, a, retries=0), spark.createDataFrame([(a, 50)], "id long, n int"))
    assert isinstance(out, Conflict) and dict(rows(accounts.read()))[a] == 50


def test_ids_are_handed_out_once(spark, accounts):
    more = [spark.createDataFrame([(k * 100 + i,) for i in range(30)], "n int").repartition(4) for k in range(3)]
    threads = [threading.Thread(target=Snapshots(spark, accounts.root).insert, args=(m, "id", ["n"])) for m in more]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    got = accounts.read().where("id >= 100").collect()
    assert sorted(r.id for r in got) == list(range(100, 190)) and accounts.manifest()["next_id"] == 190
    for k in range(3):
        own = sorted((r.id, r.n) for r in got if r.n // 100 == k)
        assert [n for _, n in own] == sorted(n for _, n in own)


def test_vacuum(spark, accounts):
    for i in range(4):
        accounts.upsert(spark.createDataFrame([(i, 1)], "id long, n int"))
    want = rows(accounts.read())
    assert accounts.vacuum(2) == 3 and accounts.versions() == [4, 5]
    assert rows(accounts.read()) == want and len(rows(accounts.read(4))) == 100
    assert accounts.vacuum(2) == 0


# -- polls ------------------------------------------------------------------------------


def test_a_poll_gives_what_changed(spark, accounts, tmp_path):
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def poll():
        before = set(rows(spark.read.schema("id long, n int, _version long").parquet(out))) if os.path.exists(out) else set()
        changes(spark, accounts.root).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
        return sorted(set(rows(spark.read.parquet(out))) - before)

    assert poll() == [(i, 0, 1) for i in range(100)] and poll() == []
    accounts.upsert(spark.createDataFrame([(3, 9), (500, None), (4, 0)], "id long, n int"))  # 4 stays what it was
    accounts.delete(spark.createDataFrame([(7,)], "id long"))
    assert poll() == [(3, 9, 3), (500, None, 3)]
    accounts.upsert(spark.createDataFrame([(3, 10)], "id long, n int"))
    accounts.upsert(spark.createDataFrame([(8, 1)], "id long, n int"))
    accounts.vacuum(1)
    assert {(3, 10, 5), (8, 1, 5), (0, 0, 5)} <= set(poll())


def test_a_running_poll_sees_a_commit(spark, accounts):
    query = changes(spark, accounts.root).writeStream.format("memory").queryName("polled").trigger(processingTime="1 second").start()
    try:
        deadline = time.monotonic() + 60
        while spark.table("polled").count() < 100 and time.monotonic() < deadline:
            time.sleep(0.5)
        accounts.upsert(spark.createDataFrame([(3, 9)], "id long, n int"))
        while spark.table("polled").where("n = 9").count() < 1 and time.monotonic() < deadline:
            time.sleep(0.5)
        assert rows(spark.table("polled").where("_version = 2")) == [(3, 9, 2)]
    finally:
        query.stop()


# -- event log -------------------------------------------------------------------------


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    write = event_log.sink(str(tmp_path), "job", ["ts"], buckets=4)
    one = spark.createDataFrame([("a", 1, "queued"), ("a", 2, "running"), ("b", 1, "queued")], "job string, ts long, status string")
    two = spark.createDataFrame([("a", 3, "success"), ("b", 0, "late")], one.schema)
    want = [("a", 3, "success"), ("b", 1, "queued")]
    for batch, n in ((one, 0), (one, 0), (two, 1), (two, 1), (one, 0)):
        write(batch, n)
    assert rows(event_log.status(spark, str(tmp_path)).select("job", "ts", "status")) == want
    assert event_log.log(spark, str(tmp_path)).count() == 5
    # A batch that died between its log and its status runs again whole.
    broken = spark.createDataFrame([("c", 9, "running")], one.schema)
    broken.write.parquet(str(tmp_path / "log" / "batch=2"))
    write(broken, 2)
    assert rows(event_log.status(spark, str(tmp_path)).select("job", "ts", "status")) == [*want, ("c", 9, "running")]
    assert event_log.log(spark, str(tmp_path)).count() == 6


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    schema = "job string, ts long, status string"
    for turn in range(3):
        spark.createDataFrame([("a", turn, f"s{turn}"), (f"j{turn}", 0, "new")], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        event_log.follow(stream, str(tmp_path / "out"), "job", ["ts"], str(tmp_path / "cp"), 4).awaitTermination()
    assert rows(event_log.status(spark, str(tmp_path / "out")).select("job", "status")) == [("a", "s2"), ("j0", "new"), ("j1", "new"), ("j2", "new")]


# -- provider replies --------------------------------------------------------------------


@pytest.fixture(scope="module")
def replies(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("replies") / "r")
    body = {"serper": '{"organic": [{"link": "http://a/%s", "title": "t"}, {"url": "http://b/%s"}, "junk", {"title": "no url"}]}', "google_cse": '{"items": [{"link": "http://c/%s", "snippet": "s"}]}'}
    made = [(f"k{i}", p, r, body[p].replace("%s", str(i))) for i in range(40) for p in body for r in ("id", "th")]
    made += [("broken", "serper", "id", "{not json"), ("null", "serper", "id", None), ("list", "serper", "id", "[1]"), ("other", "serper", "id", '{"organic": {"a": 1}}'), ("ไทย\nline", "serper", "th", body["serper"])]
    provider_source.write_replies(spark.createDataFrame(made, "keyword string, provider string, region string, reply string"), at, 8)
    provider_source.register(spark)
    return at, made


def expected(made, keep):
    out = []
    for k, p, r, text in made:
        if keep(k, p, r):
            try:
                found = json.loads(text or "{}")
            except ValueError:
                continue
            results = found.get(provider_source.FIELDS[p]) if isinstance(found, dict) else None
            for i, x in enumerate([x for x in results or [] if isinstance(x, dict)] if isinstance(results, list) else []):
                out.append((k, p, r, i, x.get("link") or x.get("url"), x.get("title"), x.get("snippet")))
    return sorted(out, key=str)


@pytest.mark.parametrize(
    "where, keep",
    [
        ("true", lambda k, p, r: True),
        ("provider = 'serper' and region = 'id'", lambda k, p, r: p == "serper" and r == "id"),
        ("keyword in ('k3', 'k7') and provider = 'google_cse'", lambda k, p, r: k in ("k3", "k7") and p == "google_cse"),
        ("keyword = 'k3' and keyword = 'k4'", lambda k, p, r: False),
        ("provider = 'nobody'", lambda k, p, r: False),
        ("keyword like 'k1%' or ord = 1", None),
    ],
)
def test_provider_source(spark, replies, where, keep):
    at, made = replies
    df = spark.read.format("provider_replies").option("buckets", 8).load(at).where(where)
    got = sorted(map(tuple, df.collect()), key=str)
    if keep is None:
        assert got == [x for x in expected(made, lambda *_: True) if x[0].startswith("k1") or x[3] == 1]
    else:
        assert got == expected(made, keep)


def test_filters_reach_the_files(spark, replies):
    at, _ = replies

    def files(*filters):
        reader = provider_source.ProviderReplies({"path": at, "buckets": "8"}).reader(None)
        assert list(reader.pushFilters(list(filters))) == []
        return sum(len(t.files) for t in reader.partitions())

    every = files()
    assert files(EqualTo(("provider",), "serper"), EqualTo(("region",), "id")) <= every / 4 + 1
    assert files(EqualTo(("keyword",), "k3")) == 4 and files(In(("keyword",), ("k3",)), EqualTo(("provider",), "serper"), EqualTo(("region",), "th")) == 1
    df = spark.read.format("provider_replies").option("buckets", 8).load(at).where("provider = 'serper' and region = 'id'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan provider_replies" in plan and "serper" not in plan  # no value is left for Spark to compare with


def test_unknown_provider(spark, tmp_path):
    provider_source.write_replies(spark.createDataFrame([("k", "bing", "id", "{}")], "keyword string, provider string, region string, reply string"), str(tmp_path / "r"), 2)
    with pytest.raises(PySparkException, match="unknown provider"):
        spark.read.format("provider_replies").option("buckets", 2).load(str(tmp_path / "r")).collect()


# -- streams with state --------------------------------------------------------------------


def batches(spark, tmp_path, parts, schema):
    """A stream that takes one file a micro-batch, in order."""
    for i, part in enumerate(parts):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i:03d}.json").write_text("".join(json.dumps(r) + "\n" for r in part))
        os.utime(tmp_path / "in" / f"{i:03d}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))


def stamp(seconds):
    return f"2024-01-01T{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}Z"


@pytest.mark.parametrize("wall_clock", [False, True])
def test_throttle_is_a_replay(spark, tmp_path, wall_clock):
    rng = random.Random(5)
    times = sorted(rng.randrange(0, 9000) for _ in range(240))
    attempts = [{"address": rng.choice("abc"), "attempt": i, "ts": stamp(t), "ok": rng.random() < 0.1} for i, t in enumerate(times)]
    last = [{"address": "z", "attempt": 999, "ts": stamp(50_000), "ok": True}, {"address": "z", "attempt": 1000, "ts": stamp(60_000), "ok": True}]
    parts = [attempts[i : i + 60] for i in range(0, 240, 60)] + [[x] for x in last]
    state, want = {}, {}
    for r, t in zip(attempts + last, times + [50_000, 60_000]):
        failures, until = state.get(r["address"], ([], 0))
        failures, until, want[r["attempt"]] = stateful.refuse(failures, until, t * SECOND, r["ok"], 3, 300 * SECOND, 300 * SECOND)
        state[r["address"]] = failures, until
    assert 20 < sum(want.values()) < 220
    stream = batches(spark, tmp_path, parts, "address string, attempt long, ts timestamp, ok boolean")
    out = stateful.throttled(stream, "address", limit=3, window=300, lock=300, wall_clock=wall_clock)
    if wall_clock:  # such a stream runs on, as its state may end at any time
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.STORE)
        query = out.writeStream.format("memory").queryName("refused").option("checkpointLocation", str(tmp_path / "cp")).start()
        deadline = time.monotonic() + 90
        while spark.table("refused").count() < len(want) and time.monotonic() < deadline and query.isActive:
            time.sleep(1)
        query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        got = spark.table("refused")
    else:
        got = stateful.drain(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert {r.attempt: r.refused for r in got.collect()} == want
    if not wall_clock:  # hours later no address holds anything
        for name in ("failures", "until"):
            held = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", name)
            assert held.load().count() == 0


def test_silence_is_told_while_it_lasts(spark, tmp_path):
    rng = random.Random(6)
    seen = {k: sorted({rng.randrange(0, 3000) for _ in range(12)}) for k in "abcd"} | {"gone": [100], "clock": [*range(0, 6001, 500)]}
    every = sorted((t, k) for k, ts in seen.items() for t in ts)
    parts = [[{"k": k, "ts": stamp(t)} for t, k in every[i : i + 9]] for i in range(0, len(every), 9)]
    out = stateful.silences(batches(spark, tmp_path, parts, "k string, ts timestamp"), "k", 250)
    got = [(r.k, r.at) for r in stateful.drain(out, str(tmp_path / "out"), str(tmp_path / "cp")).select("k", F.unix_timestamp("last_seen").alias("at")).collect()]
    base = 1_704_067_200
    want = [(k, base + a) for k, ts in seen.items() for a, b in zip(ts, [*ts[1:], 6000]) if b - a > 250 and not (k == "clock" and a == 6000)]
    assert sorted(got) == sorted(want) and ("gone", base + 100) in got


# -- dictionaries ------------------------------------------------------------------------


def check_found(spark, texts, entries):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(3)
    got = {r.i: r.found for r in automaton.add_found(df, "t", spark.createDataFrame([(e,) for e in entries], "e string")).collect()}
    real = sorted({e for e in entries if e})
    assert got == {i: [e for e in real if e in (t or "")] for i, t in enumerate(texts)}


@pytest.mark.parametrize("seed", [1, 2])
def test_found_as_contains(spark, seed, monkeypatch):
    monkeypatch.setattr(automaton, "PIECE", 7)
    if seed == 2:
        monkeypatch.setattr(automaton, "ENTRY_BYTES", 40)
    rng = random.Random(seed)
    word = lambda n, of="abé日": "".join(rng.choice(of) for _ in range(n))
    entries = ["a", "aa", "aaa", "aaaaaaaaaaaaaaaaaaaaa", "ab", "bab", "日", "é日", "", None, *(word(rng.randint(1, 6)) for _ in range(40))]
    check_found(spark, [None, "", "a" * 50, *(word(rng.randint(0, 60), "abé日x ") for _ in range(60))], entries)


def test_ten_thousand_entries(spark, sf):
    docs = [r.text.lower() for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if r.text]
    rng = random.Random(9)
    entries = set()
    while len(entries) < 10_000:
        t = rng.choice(docs)
        a = rng.randrange(0, max(len(t) - 12, 1))
        entries.add(t[a : a + rng.randint(3, 12)] or "x")
    check_found(spark, docs, sorted(entries))


def test_no_entries(spark):
    assert automaton.add_found(spark.range(2).withColumn("t", F.lit("x")), "t", spark.createDataFrame([], "e string")).first().found == []


def test_topics(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
    topics = [(i, word()) for i in range(30)]
    keywords = [None, "", *{word() for _ in range(80)}, "abc abc"]
    df = spark.createDataFrame([(k,) for k in keywords], "k string")
    got = {r.k: r.topic for r in joins.topics_of(df, "k", spark.createDataFrame(topics, "ord long, topic string")).collect()}

    def brute(k):
        if not k:
            return None
        return next((t for _, t in topics if t == k), next((t for _, t in topics if t in k or k in t), None))

    assert got == {k: brute(k) for k in keywords}


# -- medians ----------------------------------------------------------------------------


@pytest.mark.parametrize("enough, bins", [(1, 2), (50, 8), (4096, 1024)])
def test_medians(spark, enough, bins):
    rng = random.Random(enough)
    values = {"hot": [rng.choice([rng.gauss(0, 1e6), rng.randint(-5, 5)]) for _ in range(2001)], "even": [1, 2, 3, 10], "one": [4.5], "same": [2, 2, 2], None: [rng.random() for _ in range(300)], "none": [None], "odd": [float("nan"), 1.0, None]}
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, vs in values.items() for v in vs], "g string, v double").repartition(5)
    got = {r.g: (r.n, r.median) for r in medians(df, ["g"], "v", enough, bins).collect()}
    real = {g: [v for v in vs if v is not None and v == v] for g, vs in values.items()}
    assert got == {g: (len(vs), statistics.median(vs)) for g, vs in real.items() if vs}


# -- the package from anywhere --------------------------------------------------------------


def test_workers_find_the_library_from_another_folder(sf, tmp_path):
    """Only the driver's path names the repository, and everything runs in another folder."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from pagelens import catalog
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for name in ("page_title_h1", "template_heads", "amp_validate", "dictionary_hits"):
    print(name, catalog.QUERIES[name](spark, {sf!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and done.stdout.count("\n") == 4, done.stderr[-2000:]
