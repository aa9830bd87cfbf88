"""Streaming queries and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_spark.plans.registry import query
from evidence_spark.session import scratch_path
from evidence_spark.streaming import jobs as ST

DAILY = """select strftime(time_bucket(interval '1 day', ts),'%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, count(*) filter (where value > 100) as n_high,
 round(sum(value)/count(*),6) as mean_value from events group by 1, 2"""


@query("drift_watch_daily", "X-03", DAILY)
def drift_watch_daily(t):
    return ST.drift_watch(t.events, "ts", "event_type", "value")


@query("drift_watch_sliding", "X-03", """
with w as (select *, unnest(range(0,7)) as k from events), s as (select strftime(date_trunc('day', ts) - to_days(k::integer),'%Y-%m-%d %H:%M:%S') as start, event_type, value from w)
select start, event_type, count(*) as n, count(*) filter (where value > 100) as n_high, round(sum(value)/count(*),6) as mean_value from s group by 1, 2""")
def drift_watch_sliding(t):
    return ST.drift_watch(t.events, "ts", "event_type", "value", "7 days", "1 day")


@query("drift_watch_stream", "X-03", DAILY)
def drift_watch_stream(t):
    stream = ST.event_stream(t.spark, t.root, t.events.schema)
    result = ST.drift_watch(stream, "ts", "event_type", "value", watermark="1 hour")
    return ST.run_to_table(result, scratch_path(t.spark, "drift"), scratch_path(t.spark, "drift-state"))


FRESH = """
with recursive e as (select event_id, user_id, event_type, epoch_us(ts) as t from events),
following as (select a.event_id, arg_min(b.event_id, row(b.t, b.event_id)) as after from e a join e b on a.user_id = b.user_id and a.event_type = b.event_type and b.t > a.t + 6*3600*1000000::bigint group by a.event_id),
kept(event_id) as (select arg_min(event_id, row(t, event_id)) from e group by user_id, event_type union select f.after from kept k join following f on k.event_id = f.event_id)
select user_id, event_type, event_id from e join kept using (event_id)"""


@query("fresh_keys", "X-01", FRESH)
def fresh_keys(t):
    return ST.fresh_keys_batch(t.events, ["user_id", "event_type"], "event_id", "ts", 6 * 3600)


@query("fresh_keys_stream", "X-01", FRESH)
def fresh_keys_stream(t):
    stream = ST.event_stream(t.spark, t.root, t.events.schema)
    result = ST.fresh_keys(stream, ["user_id", "event_type"], "event_id", "ts", 6 * 3600)
    return ST.run_to_table(result, scratch_path(t.spark, "fresh"), scratch_path(t.spark, "fresh-state"), "append")


# Lifetimes of answers in seconds by provider: news, web, encyclopedia, page (fixed values).
NEWS, WEB, ENCYCLOPEDIA, PAGE = 600, 1800, 21600, 3600
LIFETIMES = {"click": NEWS, "view": WEB, "purchase": ENCYCLOPEDIA}
BY_PROVIDER = f"""
with recursive e as (select event_id, user_id, event_type, epoch_us(ts) as t,
  1000000::bigint * case event_type {' '.join(f"when '{k}' then {v}" for k, v in LIFETIMES.items())} else {PAGE} end as life from events),
following as (select a.event_id, arg_min(b.event_id, row(b.t, b.event_id)) as after from e a join e b on a.user_id = b.user_id and a.event_type = b.event_type and b.t > a.t + a.life group by a.event_id),
kept(event_id) as (select arg_min(event_id, row(t, event_id)) from e group by user_id, event_type union select f.after from kept k join following f on k.event_id = f.event_id)
select user_id, event_type, event_id from e join kept using (event_id)"""


@query("fresh_by_provider", "X-01", BY_PROVIDER)
def fresh_by_provider(t):
    """The kind of an event stands for the provider of an answer; each has its own lifetime."""
    return ST.fresh_keys_batch(t.events, ["user_id", "event_type"], "event_id", "ts", ST.lifetime("event_type", LIFETIMES, PAGE))


@query("fresh_by_provider_stream", "X-01", BY_PROVIDER)
def fresh_by_provider_stream(t):
    stream = ST.event_stream(t.spark, t.root, t.events.schema)
    result = ST.fresh_keys(stream, ["user_id", "event_type"], "event_id", "ts", ST.lifetime("event_type", LIFETIMES, PAGE), ENCYCLOPEDIA)
    return ST.run_to_table(result, scratch_path(t.spark, "provider"), scratch_path(t.spark, "provider-state"), "append")


@query("latest_request", "X-02", """
select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by user_id""")
def latest_request(t):
    return ST.latest_request_batch(t.events, "user_id", "event_id", ["event_type"])


STATUS = """select user_id, event_id, case when event_id < max(event_id) over (partition by user_id order by ts, event_id rows unbounded preceding) then 'late' else 'current' end as status from events"""


@query("request_status", "X-02", STATUS)
def request_status(t):
    return ST.request_status_batch(t.events, "user_id", "event_id", "ts")


@query("latest_request_stream", "X-02", STATUS)
def latest_request_stream(t):
    stream = ST.event_stream(t.spark, t.root, t.events.schema)
    marked = ST.latest_request(stream, "user_id", "event_id", "ts")
    return ST.run_to_table(marked, scratch_path(t.spark, "latest"), scratch_path(t.spark, "latest-state"), "append")


@query("preview_totals", "X-04", "select user_id, count(*) as n, max(value) as best, min(value) as worst from events group by user_id")
def preview_totals(t):
    """Each trigger upserts the users it changed; the last preview is the batch answer."""
    stream = ST.event_stream(t.spark, t.root, t.events.schema)
    return ST.run_to_upserts(ST.preview_totals(stream, "user_id", "value"), ["user_id"], scratch_path(t.spark, "preview"), scratch_path(t.spark, "preview-state"))
