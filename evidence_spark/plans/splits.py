"""Split, sampling and ordering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_spark.operators import ranking as R
from evidence_spark.operators import splits as SP
from evidence_spark.plans.registry import query

MESSAGES = "(select conv_id % 50 as key, conv_id, turn from conversations)"


def messages(t):
    return t.conversations.select((F.col("conv_id") % 50).alias("key"), "conv_id", "turn")


@query("stratified_split", "M-01", """
with r as (select doc_id, toxic, row_number() over (partition by toxic order by md5(doc_id || '|7')) as p, count(*) over (partition by toxic) as n from labels),
f as (select *, case when p <= floor(n*0.7+0.5) then 'train' when p <= floor(n*0.85+0.5) then 'valid' else 'test' end as fold from r)
select doc_id, toxic, fold from f""")
def stratified_split(t):
    return SP.stratified_split(t.labels.select("doc_id", "toxic"), "doc_id", "toxic", {"train": 0.7, "valid": 0.15, "test": 0.15}, 7)


@query("group_split", "M-02", """
with g as (select user_id, bool_and(value < 300) as ok from events group by 1),
r as (select user_id, row_number() over (order by md5(user_id || '|11')) as p, count(*) over () as n from g where ok),
c as (select user_id from r where p <= floor(n*0.25+0.5))
select case when user_id in (from c) then 'simulado' else 'estudo' end as fold, user_id, count(*) as n from events group by 1, 2""")
def group_split(t):
    folded = SP.group_split(t.events, "user_id", 0.25, 11, F.col("value") < 300)
    return folded.groupBy("fold", "user_id").agg(F.count(F.lit(1)).alias("n"))


@query("group_kfold", "M-03", """
with g as (select user_id, count(*) as n_rows from events group by 1),
r as (select *, row_number() over (order by n_rows desc, md5(user_id || '|0')) - 1 as turn from g)
select user_id, n_rows, (case when (turn // 5) % 2 = 0 then turn % 5 else 4 - turn % 5 end)::integer as fold from r""")
def group_kfold(t):
    return SP.group_kfold(t.events, "user_id", 5)


@query("source_holdout", "M-04", """
with h as (select distinct source from documents where source in ('src1','src4','src7'))
select case when source in (from h) then 'test' else 'train' end as fold, count(*) as n, count(distinct source) as n_sources from documents group by 1""")
def source_holdout(t):
    held = t.documents.filter(F.col("source").isin("src1", "src4", "src7")).select("source").distinct()
    train, test = SP.source_holdout(t.documents, "source", held)
    both = train.select(F.lit("train").alias("fold"), "source").union(test.select(F.lit("test").alias("fold"), "source"))
    return both.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("n_sources"))


@query("time_holdout", "M-04", """
select case when year(o_orderdate) in (1995,1996) then 'train' else 'test' end as fold, count(*) as n, round(avg(o_totalprice),4) as mean_price
from orders where year(o_orderdate) in (1995,1996,1997) group by 1""")
def time_holdout(t):
    dated = t.orders.withColumn("year", F.year("o_orderdate"))
    return SP.time_holdout(dated, "year", [1995, 1996], [1997]).groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


@query("group_rounds", "A-17", """
select user_id, count(*) as n from events where user_id in (select user_id from events group by 1
  having min(date_diff('day', date '2024-01-01', ts::date) // 10) = 2 and max(date_diff('day', date '2024-01-01', ts::date) // 10) = 2) group by 1
union all select -1, count(distinct user_id) from events""")
def group_rounds(t):
    rounds = t.events.withColumn("round", F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 10))
    only = rounds.join(SP.single_round_groups(rounds, "user_id", "round", 2), "user_id", "left_semi")
    found = only.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return found.union(rounds.agg(F.lit(-1).cast("long").alias("user_id"), F.countDistinct("user_id").alias("n")))


@query("whole_groups_until", "W-17", """
with g as (select user_id, count(*) as n from events group by 1), c as (select user_id, n, sum(n) over (order by user_id) as cum from g)
select user_id, n from c where cum - n < 5000""")
def whole_groups_until(t):
    kept = R.whole_groups_until(t.events, "user_id", "user_id", 5000)
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("first_groups_per_fold", "W-18", """
with g as (select distinct event_type as fold, user_id from events)
select fold, user_id, position::integer as position from (select *, row_number() over (partition by fold order by user_id) as position from g) where position <= 3""")
def first_groups_per_fold(t):
    return SP.first_groups_per_fold(t.events.withColumnRenamed("event_type", "fold"), "fold", "user_id", 3).select(
        "fold", "user_id", "position")


@query("golden_cases", "W-19", """
with d as (select doc_id, lang, source, quality, n_chars % 3 as seal from documents left join labels using (doc_id)),
a as (select min(doc_id) as doc_id from d group by lang union all select min(doc_id) from d group by source),
b as (select doc_id from d where quality is null order by doc_id limit 3),
c as (select doc_id from (select doc_id, row_number() over (partition by seal order by doc_id) as rn from d) where rn <= 3)
select distinct doc_id from (from a union all from b union all from c)""")
def golden_cases(t):
    docs = t.documents.join(t.labels, "doc_id", "left").withColumn("seal", F.col("n_chars") % 3)
    return SP.golden_cases(docs, "doc_id", ["lang", "source"], "quality", "seal")


@query("cap_per_section", "W-04", """
with l(event_type, cap) as (values ('view',6),('click',20),('error',6),('signup',4),('purchase',8)),
r as (select e.event_type, event_id, cap, row_number() over (partition by e.event_type order by value desc, event_id) as p from events e join l using (event_type))
select event_type, event_id, 'shown' as result from r where p <= cap
union all select event_type, count(*), 'over_limit' from r where p > cap group by event_type""")
def cap_per_section(t):
    """Best rows per section up to its limit, and how many were over it."""
    limits = {"view": 6, "click": 20, "error": 6, "signup": 4, "purchase": 8}
    cap = F.element_at(F.create_map(*[F.lit(v) for kv in limits.items() for v in kv]), F.col("event_type"))
    rows = t.events.filter(F.col("event_type").isin(list(limits)))
    best = R.top_per_key(rows.select("event_type", "event_id", "value"), ["event_type"], [F.desc("value"), F.asc("event_id")], max(limits.values()))
    shown = best.filter(F.col("position") <= cap).select("event_type", "event_id", F.lit("shown").alias("result"))
    over = rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cap).select(
        "event_type", (F.col("n") - cap).alias("event_id"), F.lit("over_limit").alias("result"))
    return shown.union(over)


@query("sample_errors", "T-04", """
select doc_id from labels where toxic = 1 and quality = 1 order by md5(doc_id || '|42') limit 20""")
def sample_errors(t):
    wrong = t.labels.filter((F.col("toxic") == 1) & (F.col("quality") == 1))
    return SP.sample_rows(wrong.select("doc_id"), "doc_id", 20, 42)


@query("stratified_sample", "T-07", """
select quality, doc_id from (select quality, doc_id, row_number() over (partition by quality order by md5(doc_id || '|5')) as rn from labels) where rn <= 25""")
def stratified_sample(t):
    return SP.stratified_sample(t.labels.select("quality", "doc_id"), "quality", "doc_id", 25, 5)


@query("result_order", "T-06", """
select o_orderkey, o_orderpriority, o_totalprice from orders order by substr(o_orderpriority,1,1)::int, o_totalprice desc, o_orderkey""")
def result_order(t):
    return t.orders.orderBy(F.substring("o_orderpriority", 1, 1).cast("int"), F.desc("o_totalprice"), "o_orderkey").select(
        "o_orderkey", "o_orderpriority", "o_totalprice")


@query("trace_stats", "A-24", """
with r as (select event_type as stage, case when value > 100 then 'discarded' else 'kept' end as result, (user_id % 6)::varchar as reason from events),
c as (select stage, result, reason, count(*) as n from r group by all),
t as (select stage, result, sum(n) as total, arg_max(reason, row(n, reason)) as top_reason, max(n) as top_n from c group by all)
select stage, result, total::bigint as total, top_reason, top_n from t""")
def trace_stats(t):
    rows = t.events.select(F.col("event_type").alias("stage"), F.when(F.col("value") > 100, "discarded").otherwise("kept").alias("result"),
                           (F.col("user_id") % 6).cast("string").alias("reason"))
    counts = rows.groupBy("stage", "result", "reason").agg(F.count(F.lit(1)).alias("n"))
    top = F.struct("n", "reason")
    return counts.groupBy("stage", "result").agg(F.sum("n").alias("total"), F.max_by("reason", top).alias("top_reason"),
                                                 F.max("n").alias("top_n"))
