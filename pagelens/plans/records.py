"""Queries over conversations, events, orders and parts: histories, ledgers, jobs, gaps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..functions.dates import localized_date as localized
from ..operators import blueprint, joins, ledger, ranking
from ..streaming import gaps
from .registry import query

NOW = "2024-01-31 00:00:00"


@query("""with n as (select conv_id, text, row_number() over (partition by conv_id order by turn, role, text) as k from conversations where role = 'user')
select conv_id, string_agg(text, '|' order by k) as items from n where k <= 5 group by conv_id""")
def ordered_collect(load):
    """The first five user turns of each conversation, in order."""
    rows = load("conversations").where("role = 'user'")
    return blueprint.ordered_items(rows, "conv_id", ["turn", "role", "text"], "text", 5).select("conv_id", F.array_join("items", "|").alias("items"))


@query("""with n as (select conv_id, role, text, row_number() over (partition by conv_id, role order by turn, text) as n from conversations where role in ('user', 'assistant'))
select u.conv_id, u.n::bigint as n, length(u.text)::bigint as asked, length(a.text)::bigint as answered from n u join n a on a.conv_id = u.conv_id and a.n = u.n and a.role = 'assistant' where u.role = 'user'""")
def zip_turns(load):
    z = joins.zip_positions(load("conversations").withColumn("o", F.struct("turn", "text")), "conv_id", "o", "role", "user", "assistant", "text")
    return z.select("conv_id", F.col("n").cast("long").alias("n"), F.length("left").cast("long").alias("asked"), F.length("right").cast("long").alias("answered"))


@query("""with r as (select *, row_number() over (partition by conv_id order by turn desc, role desc, text desc) as k from conversations)
select conv_id, string_agg(role || ': ' || trim(text), chr(10) order by turn, role, text) as history from r where k <= 8 and role in ('user', 'assistant') and trim(text) <> '' group by conv_id""")
def history_tail(load):
    """The last eight rows of each conversation; blanks and other roles go after the cut."""
    rows = load("conversations").withColumn("o", F.struct("turn", "role", "text"))
    last = ranking.tail(rows, "conv_id", "o", 8).where("role in ('user', 'assistant') and trim(text) <> ''")
    said = F.array_sort(F.collect_list(F.struct("o", F.concat("role", F.lit(": "), F.trim("text")).alias("line"))))
    return last.groupBy("conv_id").agg(F.array_join(F.transform(said, lambda x: x["line"]), "\n").alias("history"))


@query("""select c.conv_id, count(*)::bigint as messages from conversations c where exists (select 1 from customer k where k.c_custkey = c.conv_id and k.c_acctbal > 0) group by c.conv_id""")
def owned_messages(load):
    owners = load("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("conv_id"))
    return load("conversations").join(owners, "conv_id", "left_semi").groupBy("conv_id").agg(F.count("*").alias("messages"))


@query(r"""with t as (select conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) as line from conversations where turn = 0)
select conv_id, case when length(line) > 42 then rtrim(substr(line, 1, 42)) || '...' else line end as title from t""")
def chat_title(load):
    return load("conversations").where("turn = 0").select("conv_id", T.chat_title(F.col("text")).alias("title"))


@query("""with c as (select conv_id, max(turn) as updated, conv_id % 7 = 0 as pinned from conversations group by conv_id)
select conv_id, pinned, updated::bigint as updated, row_number() over (order by pinned desc, updated desc, conv_id desc)::bigint as rank from c qualify rank <= 50""")
def chat_listing(load):
    """The first fifty conversations: pinned, then latest, then id."""
    c = load("conversations").groupBy("conv_id").agg(F.max("turn").alias("updated")).withColumn("pinned", F.col("conv_id") % 7 == 0)
    return ranking.latest(c, 50, F.desc("pinned"), F.desc("updated"), F.desc("conv_id")).select("conv_id", "pinned", "updated", "rank")


@query("select event_id, row_number() over (order by event_id desc)::bigint as rank from events qualify rank <= 50")
def latest_n(load):
    return ranking.latest(load("events").select("event_id"), 50, F.desc("event_id"))


@query("""select event_id, user_id, round(sum(case when event_type = 'purchase' then -1 when event_type = 'signup' then 5 else 0 end) over (partition by user_id order by ts, event_id), 6)::bigint as balance from events""")
def running_balance(load):
    delta = F.when(F.col("event_type") == "purchase", -1).when(F.col("event_type") == "signup", 5).otherwise(0)
    return ledger.running_balance(load("events"), "user_id", ["ts", "event_id"], delta).select("event_id", "user_id", "balance")


@query("select user_id, count(*)::bigint as n, count(*) >= 20 as \"full\" from events where event_type = 'purchase' group by user_id")
def user_quota(load):
    return ledger.quota(load("events").where("event_type = 'purchase'"), "user_id", 20)


@query("""select user_id, event_type, arg_max(event_id, (ts, event_id)) as event_id, arg_max(value, (ts, event_id)) as value from events group by all""")
def upsert_latest(load):
    e = load("events").select("user_id", "event_type", "event_id", "ts", "value")
    return ledger.upsert_latest(e, ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query("""with e as (select user_id as job, ts, event_id, case event_type when 'signup' then 'queued' when 'error' then 'error' when 'purchase' then 'success' else 'running' end as status, event_id % 8 as step from events),
l as (select job, arg_max(status, (ts, event_id)) as status, arg_max(step, (ts, event_id)) as step from e group by job)
select job, status, (case when status = 'success' then 8 else step end)::bigint as step, case when status in ('queued', 'running') then 'error' else status end as after_boot from l""")
def job_status_fold(load):
    kind = F.col("event_type")
    status = F.when(kind == "signup", "queued").when(kind == "error", "error").when(kind == "purchase", "success").otherwise("running")
    e = load("events").select(F.col("user_id").alias("job"), "ts", "event_id", status.alias("status"), (F.col("event_id") % 8).alias("step"), F.lit(8).cast("long").alias("total"))
    jobs = ledger.fold_status(e, "job", ["ts", "event_id"])
    boot = ledger.reset_stuck(jobs.withColumn("before", F.col("status")))
    return boot.select("job", F.col("before").alias("status"), "step", F.col("status").alias("after_boot"))


@query("""with r as (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events)
select user_id, count(*)::bigint as kept, min(event_id) as least, max(event_id) as most from r where k <= 20 group by user_id""")
def log_tail(load):
    rows = load("events").withColumn("o", F.struct("ts", "event_id"))
    return ranking.tail(rows, "user_id", "o", 20).groupBy("user_id").agg(F.count("*").alias("kept"), F.min("event_id").alias("least"), F.max("event_id").alias("most"))


@query("""select event_id, count(*) over (partition by user_id order by ts range between interval 86400 seconds preceding and current row)::bigint as failures from events where event_type = 'error'""")
def sliding_failures(load):
    """Failures of the user in the day up to each one."""
    return gaps.sliding_count(load("events").where("event_type = 'error'"), "user_id", "ts", 86400, "failures").select("event_id", "failures")


@query("""with g as (select user_id, ts, event_id, lag(ts) over (partition by user_id order by ts, event_id) as prev from events),
s as (select *, sum(case when prev is null or date_diff('microsecond', prev, ts) > 43200000000 then 1 else 0 end) over (partition by user_id order by ts, event_id) as session from g)
select user_id, session::bigint as session, count(*)::bigint as events, min(event_id) as first_event from s group by all""")
def session_gaps(load):
    return gaps.sessions(load("events"), "user_id", ["ts", "event_id"], "ts", 43200).groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"))


@query(f"select event_id from events where ts >= timestamp '{NOW}' - interval 48 hours and ts <= timestamp '{NOW}'")
def cache_ttl_valid(load):
    from ..sources.cache import still_valid

    return load("events").where(still_valid(F.col("ts"), F.lit(NOW).cast("timestamp"), 48) & (F.col("ts") <= F.lit(NOW).cast("timestamp"))).select("event_id")


@query("select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as bigint), 0) as k from events")
def json_prop(load):
    return load("events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0).cast("long")).alias("k"))


@query("""select o_orderkey, day(o_orderdate) || ' ' || (['Januari','Februari','Maret','April','Mei','Juni','Juli','Agustus','September','Oktober','November','Desember'])[month(o_orderdate)] || ' ' || year(o_orderdate) as local_id,
(year(o_orderdate) + 543)::bigint as year_th, strftime(o_orderdate, '%Y-%m-%d') as iso from orders""")
def localized_date(load):
    d = F.col("o_orderdate")
    return load("orders").select("o_orderkey", localized(d, "id").alias("local_id"), (F.year(d) + 543).cast("long").alias("year_th"), F.date_format(d, "yyyy-MM-dd").alias("iso"))


@query("""with h as (select p_partkey, p_partkey * 40503 % 16777216 as v from part), c as (select p_partkey, lpad(lower(to_hex(v)), 6, '0') as hex, v // 65536 as r, v // 256 % 256 as g, v % 256 as b from h)
select p_partkey, hex, round((0.2126 * r + 0.7152 * g + 0.0722 * b) / 255, 6)::double as luminance, round((greatest(r, g, b) - least(r, g, b)) / 255.0, 6)::double as saturation from c""")
def color_luminance(load):
    c = load("part").select("p_partkey", F.lpad(F.lower(F.hex(F.col("p_partkey") * 40503 % 16777216)), 6, "0").alias("hex"))
    r, g, b = (S.channel(F.col("hex"), i) for i in range(3))
    return c.select("p_partkey", "hex", F.round(S.luminance(r, g, b), 6).alias("luminance"), F.round(S.saturation(r, g, b), 6).alias("saturation"))
