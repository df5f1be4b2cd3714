"""Queries of stores, data sources and streams: what they leave behind, read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import domain
from ..operators import automaton, joins
from ..operators.medians import medians
from ..operators.ranking import first_per_domain
from ..sources import provider_source
from ..sources.changes import changes
from ..sources.shared import shared_folder
from ..sources.snapshots import Snapshots
from ..streaming import event_log, stateful
from .registry import query, streamed


# -- data source -----------------------------------------------------------------


@query(r"""with r as (select page_id // 10 as k, page_id, url, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '') as domain from pages where regexp_matches(url, '^https?://') and page_id // 10 % 2 = 0 and page_id // 10 % 3 <> 0),
f as (select *, row_number() over (partition by k, domain order by page_id) as n from r), p as (select *, row_number() over (partition by k order by page_id) as position from f where n = 1)
select 'kw ' || k as keyword, 'serper' as provider, 'th' as region, position::bigint as position, url, domain, 't' || page_id as title from p where position <= 10""")
def provider_source_results(load):
    """One provider's and region's results through the data source, which opens their folders only (S-4, S-5, S-7)."""
    k = F.floor(F.col("page_id") / 10)
    pages = load("pages").select(F.concat(F.lit("kw "), k.cast("string")).alias("keyword"), k.alias("k"), "page_id", F.struct(F.col("url").alias("link"), F.concat(F.lit("t"), F.col("page_id").cast("string")).alias("title")).alias("r"))
    hits = F.transform(F.array_sort(F.collect_list(F.struct("page_id", "r"))), lambda x: x["r"])  # ten pages a keyword
    replies = pages.groupBy("keyword", "k").agg(hits.alias("hits")).select(
        "keyword", F.when(F.col("k") % 2 == 0, "serper").otherwise("google_cse").alias("provider"), F.when(F.col("k") % 3 == 0, "id").otherwise("th").alias("region"),
        F.when(F.col("k") % 2 == 0, F.to_json(F.struct(F.col("hits").alias("organic")))).otherwise(F.to_json(F.struct(F.col("hits").alias("items")))).alias("reply"),
    )
    spark = replies.sparkSession
    at = f"{shared_folder(spark)}/replies"
    provider_source.write_replies(replies, at, 16)
    provider_source.register(spark)
    found = spark.read.format(provider_source.NAME).option("buckets", 16).load(at).where("provider = 'serper' and region = 'th'")
    own = found.where(F.col("url").rlike("^https?://"))
    return first_per_domain(own, domain(F.col("url")), ["ord"], 10, ["keyword", "provider", "region"]).select("keyword", "provider", "region", F.col("position").cast("long").alias("position"), "url", "domain", "title")


# -- streams ---------------------------------------------------------------------

_HOUR = 3_600_000_000


def _clock(c: str):
    """Event time needs a zone; the tables' times have none."""
    return F.col(c).cast("timestamp").alias(c)


@query(f"""with recursive e as (select user_id, event_id, epoch_us(ts) as at, event_type <> 'error' as ok, row_number() over (partition by user_id order by ts, event_id) as n from events where event_type in ('error', 'signup')),
r as (select user_id, 0::bigint as n, []::bigint[] as times, 0::bigint as until, null::bigint as event_id, false as refused from (select distinct user_id from e)
union all select e.user_id, e.n,
case when e.at < r.until then r.times when e.ok then []::bigint[] when len(list_filter(r.times, lambda t: e.at - t <= {48 * _HOUR})) >= 2 then []::bigint[] else list_append(list_filter(r.times, lambda t: e.at - t <= {48 * _HOUR}), e.at) end,
case when e.at < r.until then r.until when not e.ok and len(list_filter(r.times, lambda t: e.at - t <= {48 * _HOUR})) >= 2 then e.at + {72 * _HOUR} else 0 end, e.event_id, e.at < r.until
from r join e on e.user_id = r.user_id and e.n = r.n + 1)
select user_id, event_id as attempt, refused from r where n > 0""")
def throttled_logins(load):
    """Every attempt of a stream: three failures in two days lock a user for three more (G-1)."""
    events = streamed(load, "events").where("event_type in ('error', 'signup')")
    attempts = events.select("user_id", F.col("event_id").alias("attempt"), _clock("ts"), (F.col("event_type") != "error").alias("ok"))
    out = stateful.throttled(attempts, "user_id", limit=3, window=48 * 3600, lock=72 * 3600)
    at = shared_folder(events.sparkSession)
    return stateful.drain(out, f"{at}/attempts", f"{at}/checkpoint")


@query("""with n as (select user_id, ts, lead(ts) over (partition by user_id order by ts) as next, max(ts) over () as seen from events)
select user_id, ts as last_seen from n where epoch_us(coalesce(next, seen)) - epoch_us(ts) > 43200000000""")
def silent_users(load):
    """Rows after which a user says nothing for half a day, those that are still silent at the end too (G-2)."""
    events = streamed(load, "events").select("user_id", _clock("ts"))
    at = shared_folder(events.sparkSession)
    out = stateful.drain(stateful.silences(events, "user_id", 43200), f"{at}/silences", f"{at}/checkpoint")
    return out.select("user_id", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"))


@query("""select user_id, arg_max(event_type, (ts, event_id)) as status, max(ts) as ts, count(*)::bigint as entries from events group by user_id""")
def event_log_status(load):
    """The log that a stream wrote and the latest status it kept beside it (G-4)."""
    events = streamed(load, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("status"))
    spark = events.sparkSession
    at = shared_folder(spark)
    event_log.follow(events, at, "user_id", ["ts", "event_id"], f"{at}/checkpoint").awaitTermination()
    entries = event_log.log(spark, at).groupBy("user_id").agg(F.count("*").alias("entries"))
    return event_log.status(spark, at).join(entries, "user_id").select("user_id", "status", "ts", "entries")


# -- versions ---------------------------------------------------------------------


@query("""with c as (select c_custkey as id, c_name as name, c_acctbal as balance from customer),
u as (select id, name, case when id % 5 = 0 then 0.0 else balance end as balance from c where id % 7 <> 0),
n as (select (select max(id) from c) + row_number() over (order by s_suppkey) as id, s_name as name, s_acctbal as balance from supplier),
v as (select * from u union all select * from n),
s as (select id, name, case when name like 'Supplier%' then balance + 1 else balance end as balance from v)
select id, name, balance, 5::bigint as version from s union all select id, name, balance, 1 from c""")
def versioned_accounts(load):
    """A table of versions after an upsert, a delete, an insert with new ids and an update, beside its first version (D-1..D-5, S-23)."""
    c = load("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    spark = c.sparkSession
    t = Snapshots(spark, f"{shared_folder(spark)}/accounts")
    t.create(c, ["id"], buckets=8, next_id=c.agg(F.max("id")).first()[0] + 1)
    t.upsert(c.where("id % 5 = 0").withColumn("balance", F.lit(0.0)))
    t.delete(c.where("id % 7 = 0"))
    t.insert(load("supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")), "id", ["name"])
    last = t.update(F.col("name").startswith("Supplier"), {"balance": F.col("balance") + 1})
    show = lambda v: t.read(v).withColumn("version", F.lit(v).cast("long"))
    return show(last).unionByName(show(1))


@query("""select c_custkey as id, c_acctbal as balance, 1::bigint as seen_at from customer union all select c_custkey, c_acctbal + 1, 3 from customer where c_custkey % 10 = 0""")
def polled_changes(load):
    """A table looked at twice: all of its rows, and then those that two further commits changed, as they are after both (G-5)."""
    c = load("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    spark = c.sparkSession
    at = shared_folder(spark)
    t = Snapshots(spark, f"{at}/table")
    t.create(c, ["id"], buckets=8)

    def poll() -> DataFrame:
        query = changes(spark, f"{at}/table").writeStream.format("parquet").option("path", f"{at}/seen").option("checkpointLocation", f"{at}/checkpoint")
        query.trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{at}/seen")

    poll()
    every_tenth = c.where("id % 10 = 0")
    t.upsert(every_tenth.withColumn("balance", F.lit(-1.0)))
    t.upsert(every_tenth.withColumn("balance", F.col("balance") + 1))
    return poll().select("id", "balance", F.col("_version").alias("seen_at"))


# -- many entries, large groups --------------------------------------------------------


def _entries(load) -> DataFrame:
    """Words of six letters or more of the benchmark."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]{6,}"), F.lit(0)))
    return load("benchmark").select(words.alias("entry")).distinct()


@query("""with e as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) as entry from benchmark), d as (select doc_id, lower(coalesce(text, '')) as body from documents)
select doc_id, count(entry)::bigint as found, md5(coalesce(string_agg(entry, ',' order by entry), '')) as entries from d left join e on contains(body, entry) group by doc_id""")
def dictionary_hits(load):
    """Which of all the benchmark's longer words each whole document contains, in one pass over it (J-5, A-12)."""
    rows = load("documents").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("body"))
    out = automaton.add_found(rows, "body", _entries(load))
    return out.select("doc_id", F.size("found").cast("long").alias("found"), F.md5(F.array_join("found", ",")).alias("entries"))


@query("""with t as (select n_nationkey as ord, lower(n_name) as topic from nation union all select 100 + p_partkey, split_part(p_name, ' ', 1) from part),
k as (select distinct unnest(list_distinct(string_split(p_name, ' '))) as keyword from part union select unnest(['china town', 'an', 'unite', 'zzz', 'new indiana'])),
x as (select keyword, topic, ord, row_number() over (partition by keyword order by topic = keyword desc, ord) as n from k join t on contains(keyword, topic) or contains(topic, keyword))
select keyword, topic from x where n = 1""")
def topic_dictionary(load):
    """Each keyword's topic among all topics: the exact one, else the first that contains it or is contained in it (J-3)."""
    nations = load("nation").select(F.col("n_nationkey").cast("long").alias("ord"), F.lower("n_name").alias("topic"))
    parts = load("part").select((F.col("p_partkey") + 100).alias("ord"), F.split("p_name", " ")[0].alias("topic"))
    words = load("part").select(F.explode(F.split("p_name", " ")).alias("keyword"))
    more = F.explode(F.array(*map(F.lit, ["china town", "an", "unite", "zzz", "new indiana"]))).alias("keyword")
    keywords = words.unionAll(load("region").limit(1).select(more)).distinct()
    return joins.topics_of(keywords, "keyword", nations.unionAll(parts)).where("topic is not null").select("keyword", "topic")


@query("""select lang, count(n_chars)::bigint as n, median(n_chars)::double as median from documents group by lang having count(n_chars) > 0""")
def language_medians(load):
    """Exact median lengths of the documents of each language, of which one may hold most rows (A-2, P-5)."""
    return medians(load("documents"), ["lang"], "n_chars", enough=64, bins=32)
