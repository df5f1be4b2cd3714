import datetime as dt

from pyspark.sql import functions as F

from pagelens import intent
from pagelens.operators import joins, ledger, ranking
from pagelens.sources import cache, readers
from pagelens.streaming import gaps, stateful


def test_ledger(spark):
    users = spark.createDataFrame([(1, "a", 2), (2, "b", 0)], "id long, name string, tokens int")
    more = ledger.append(users, spark.createDataFrame([("c", 5), ("d", 6)], "name string, tokens int"), "id", "name")
    assert sorted(r.id for r in more.collect()) == [1, 2, 3, 4]
    chats = spark.createDataFrame([(10, 1), (11, 9)], "id long, user_id long")
    assert [r.id for r in ledger.cascade(users, chats, "id", "user_id").collect()] == [10]
    assert ledger.delete(users, spark.createDataFrame([(1,)], "id long"), ["id"]).count() == 1
    assert ledger.update(users, F.col("id") == 1, {"tokens": F.lit(9)}).where("tokens = 9").count() == 1
    bad = ledger.violations(users, {"has tokens": F.col("tokens") > 0}).collect()
    assert [(r.id, r.violations) for r in bad] == [(2, ["has tokens"])]
    assert "email" in ledger.migrate(users, {"email": "string"}).columns
    entry = F.struct(F.current_timestamp().alias("at"), F.lit(1).alias("step"), F.lit("x").alias("text"))
    log = spark.range(1).select(F.array_repeat(entry, 200).cast("array<struct<at:timestamp,step:int,text:string>>").alias("log"))
    assert log.select(F.size(ledger.append_log(F.col("log"), entry)).alias("n")).first().n == 200


def test_fit_and_regions(spark):
    wanted = spark.createDataFrame([("p", 3)], "role string, n int")
    offered = spark.createDataFrame([("p", 1, "one"), ("p", 2, "two")], "role string, pos int, text string")
    fallback = spark.createDataFrame([("p", 1, "two"), ("p", 2, "three"), ("p", 3, "four")], "role string, pos int, text string")
    assert [r.text for r in joins.fit_content(wanted, offered, fallback).orderBy("ordinal").collect()] == ["one", "two", "three"]
    regions = spark.createDataFrame([("id", "Indonesia"), ("th", "Thailand")], "code string, label string")
    rows = spark.createDataFrame([(" TH ",), ("",)], "code string")
    assert sorted(r.label for r in joins.region_join(rows, F.col("code"), regions).collect()) == ["Indonesia", "Thailand"]


def test_first_success(spark):
    rows = spark.createDataFrame([("k", 1, False), ("k", 2, True), ("k", 3, True), ("q", 5, True)], "g string, rank int, ok boolean")
    assert [(r.g, r["rank"]) for r in ranking.first_success(rows, "g", "rank", F.col("ok")).collect()] == [("k", 2)]


def test_cache(spark, tmp_path):
    now = F.lit("2024-01-03 00:00:00").cast("timestamp")
    rows = [("a", "id", "serper", "2024-01-02 12:00:00"), ("b", "id", "serper", "2023-12-01 00:00:00"), ("c", "th", "serper", "junk")]
    cache.write_cache(spark.createDataFrame(rows, "keyword string, region string, provider string, fetched_at string"), str(tmp_path / "c"), ["keyword"])
    got = cache.read_cache(spark, str(tmp_path / "c"), now, 24)
    assert [r.keyword for r in got.collect()] == ["a"]
    hits, misses = cache.lookup(spark.createDataFrame([("a",), ("z",)], "keyword string"), got, ["keyword"])
    assert hits.count() == 1 and [r.keyword for r in misses.collect()] == ["z"]


def test_cache_keeps_one_row_a_key(spark, tmp_path):
    """A refetch takes the expired row's place, twice too, and what else has expired in its bucket goes."""
    at, now = str(tmp_path / "c"), F.lit("2024-01-03 00:00:00").cast("timestamp")
    schema = "keyword string, region string, provider string, payload string, fetched_at string"
    old = [(k, "id", "serper", "old", "2023-12-01 00:00:00") for k in "abcdef"] + [("a", "id", "serper", "older", "2023-11-01 00:00:00"), ("x", "id", "serper", "odd", None)]
    cache.write_cache(spark.createDataFrame(old, schema), at, ["keyword"], buckets=1)
    assert cache.read_cache(spark, at, now, 1e6).where("keyword = 'a'").first().payload == "old"
    source = spark.createDataFrame([("a", "new"), ("b", "new")], "keyword string, payload string")
    asked = spark.createDataFrame([("a", "id", "serper"), ("a", "id", "serper"), ("b", "id", "serper"), ("q", "id", "serper")], "keyword string, region string, provider string")
    for _ in range(2):
        got = cache.search(asked, at, source, ["keyword"], now, 24.0).collect()
        assert sorted((r.keyword, r.payload) for r in got) == [("a", "new"), ("a", "new"), ("b", "new")]
        from pagelens.sources.snapshots import Snapshots

        assert sorted((r.keyword, r.payload) for r in Snapshots(spark, at).read().collect()) == [("a", "new"), ("b", "new")]


def test_readers(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"id:shoes": ["http://a.x/1", "http://www.a.x/2", "ftp://n", "http://b.x"], "hats": ["http://c.x"]}')
    got = readers.read_manual_results(spark, str(tmp_path / "m.json"), "shoes", "id").orderBy("position").collect()
    assert [(r.position, r.domain) for r in got] == [(1, "a.x"), (2, "b.x")]
    assert readers.read_manual_results(spark, str(tmp_path / "m.json"), "hats", "th").count() == 1
    reply = '{"organic": [{"link": "http://a.x/1", "title": "t"}, {"link": "http://a.x/2"}], "peopleAlsoAsk": [{"question": "q?"}], "relatedSearches": [{"query": "r"}]}'
    payloads = spark.createDataFrame([("k", reply)], "keyword string, body string")
    assert readers.run_provider("serper", payloads, "body").select("position", "domain").first()[:] == (1, "a.x")
    assert readers.read_questions(payloads, "body").first().people_also_ask == ["q?"]
    (tmp_path / "k.json").write_text('{"seo": {"entities": ["a"], "ideal": {"h1": 1}, "must_have": ["faq"]}, "wordpress": {"ideal": {"title_length": 60}}}')
    assert [(r.topic, r.ord, r.entities) for r in readers.read_knowledge(spark, str(tmp_path / "k.json")).orderBy("ord").collect()] == [("seo", 0, ["a"]), ("wordpress", 1, [])]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.html").write_text("<p>é</p>")
    (tmp_path / "t" / "b.html").write_bytes(b"\xff\xfe")
    assert {(r.html, r.status) for r in readers.read_templates(spark, str(tmp_path / "t")).collect()} >= {("<p>é</p>", "ok")}
    assert all((r.html is not None) == (r.status == "ok") for r in readers.read_templates(spark, str(tmp_path / "t")).collect())
    (tmp_path / "r.json").write_text('{"seo_score": 80, "page": {"title": "t"}}')
    assert readers.read_reports(spark, str(tmp_path / "r.json")).first().seo_score == 80
    readers.sitemap(spark.createDataFrame([("http://a", "2024-01-01")], "url string, lastmod string"), str(tmp_path / "s"))


def test_intent(spark):
    rows = [("buy red shoes", "t"), ("order shoes cheap", "t"), ("buy hat", "t"), ("what is a shoe", "i"), ("what is a hat", "i"), ("history of hats", "i")]
    model = intent.train(spark.createDataFrame(rows, "keyword string, intent string"))
    got = intent.predict(model, spark.createDataFrame([("buy shoes",), ("what is this",), ("  ",)], "keyword string")).collect()
    assert [r.predicted for r in got] == ["t", "i", "unknown"] and got[2].confidence == 0.0


def test_throttle_steps():
    state, refused = ([], 0), []
    for at, ok in [(0, False), (1, False), (2, False), (3, True), (302.5, False), (303, True)]:
        *state, no = stateful.refuse(*state, int(at * 1e6), ok, 3, 300_000_000, 300_000_000)
        refused.append(no)
    assert refused == [False, False, False, True, False, False]


def test_streams(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [("x", base + dt.timedelta(seconds=s), ok) for s, ok in [(0, False), (1, False), (2, False), (3, True)]]
    df = spark.createDataFrame(rows, "address string, ts timestamp, ok boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = gaps.session_stream(stream, "address", "ts", "10 seconds", "1 second").writeStream.outputMode("complete").format("memory").queryName("sessions").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("sessions").first().events == 4


def test_progress(spark):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("j", n, base + dt.timedelta(seconds=n // 50)) for n in range(0, 300, 10)], "job string, n long, ts timestamp")
    assert [r.n for r in gaps.progress_points(df, "job", "n", "ts").orderBy("n").collect()] == [0, 100, 200]
    assert gaps.stalls(df, "job", "ts", 5).first().stalled is False


def test_progress_in_a_days_last_second(spark, tmp_path):
    """As in the SQL, the last half second of a day counts for the next one."""
    import duckdb

    from pagelens import catalog

    at = str(tmp_path / "events.parquet")
    times = ["2024-01-01 10:00:00", "2024-01-01 23:59:59.4", "2024-01-01 23:59:59.7", "2024-01-02 00:00:01", "2024-01-02 23:59:59.5", "2024-01-03 00:00:00"]
    spark.createDataFrame([(1, i, x) for i, x in enumerate(times)], "user_id long, event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(at)
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{at}/*.parquet'")
    want = sorted(con.execute(catalog.ORACLE["progress_points"]).fetchall())
    assert sorted(map(tuple, catalog.QUERIES["progress_points"](spark, str(tmp_path)).collect())) == want == [(1, 1), (1, 3), (1, 5)]


def test_region_rows_stay_where_they_are(spark):
    """A region holds most rows, so they aren't dealt by it, even where Spark broadcasts nothing by itself."""
    from pagelens.functions.regions import regions

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = joins.region_join(spark.range(100).select(F.lit("th").alias("code")), F.col("code"), regions(spark))
        assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_zip_of_many_files(spark):
    """More files than a slice, two of them of one name; a task reads them one by one."""
    from pagelens.operators import content

    files = spark.range(5001).select((F.col("id") % 2).alias("g"), F.concat(F.lit("f"), (F.col("id") % 5000).cast("string")).alias("name"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content"))
    z = content.zip_bundles(files, "g")
    assert "FlatMapGroups" not in z._jdf.queryExecution().executedPlan().toString() and {r.g: r.n for r in z.collect()} == {0: 2501, 1: 2500}
    back = content.unzip(z, "g").select("g", "name", "content")
    assert back.exceptAll(files).count() == 0 and files.exceptAll(back).count() == 0


def test_template_files_are_packed(spark, sf):
    """Few files for 50 pages; some are loose, some too large in both forms."""
    from pathlib import Path

    from pagelens import catalog

    held = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(held.glob("pagelens-files-*/templates"))
    got = catalog.QUERIES["template_files"](spark, sf).collect()
    (at,) = set(held.glob("pagelens-files-*/templates")) - before
    assert len(list(at.rglob("part-*"))) < 20 and {p.parent.name for p in (at / "loose").rglob("part-*")} == {"page_id=0", "page_id=3"}
    assert {r.page_id: r.status for r in got} == {i: "too large" if i % 10 == 3 else "ok" for i in range(50)} and len(got) == 50


def test_cache_grows_by_buckets(spark, tmp_path, monkeypatch):
    """A cache of more rows has more buckets, and what a request is looked up with is dealt to as many tasks."""
    from pyspark.sql import functions as F

    from pagelens.sources import cache
    from pagelens.sources.snapshots import Snapshots

    monkeypatch.setattr(cache, "HELD", 10)
    asked = spark.createDataFrame([(i, "id", "p") for i in range(200)], "k int, region string, provider string")
    at, now = str(tmp_path / "c"), F.lit("2024-01-31 00:00:00").cast("timestamp")
    cache.write_cache(asked.where("k < 190").withColumns({"payload": F.lit("old"), "fetched_at": F.when(F.col("k") % 2 == 0, "2024-01-30 12:00:00").otherwise("2024-01-01 00:00:00")}), at, ["k"])
    assert Snapshots(spark, at).manifest()["n"] == 19
    source = spark.range(200).select(F.col("id").cast("int").alias("k"), F.lit("new").alias("payload"))
    found = cache.search(asked, at, source, ["k"], now, 24.0)
    assert found._jdf.queryExecution().toString().count("REPARTITION_BY_NUM") >= 4
    assert sorted((r.k, r.payload) for r in found.collect()) == [(i, "old" if i < 190 and i % 2 == 0 else "new") for i in range(200)]
    assert cache.read_cache(spark, at, now, 24.0).count() == 200
