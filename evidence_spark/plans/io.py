"""Reader and writer queries: tables written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_spark.operators import evaluation as E
from evidence_spark.operators import profile as P
from evidence_spark.operators import training as TR
from evidence_spark.plans.pairs import PAIRS, pairs
from evidence_spark.plans.registry import query
from evidence_spark.plans.splits import stratified_split
from evidence_spark.session import scratch_path
from evidence_spark.sources import readers as RD
from evidence_spark.sources import sinks as SK


@query("csv_round_trip", "S-01", "select doc_id, md5(text) as digest, lang, source, n_chars from documents")
def csv_round_trip(t):
    path = scratch_path(t.spark, "csv")
    t.documents.write.option("header", True).option("escape", '"').csv(path)
    back = RD.read_corpus_csv(t.spark, path, t.documents.schema)
    return back.select("doc_id", F.md5("text").alias("digest"), "lang", "source", "n_chars")


@query("jsonl_round_trip", "S-02", "select conv_id, turn, role, text from conversations")
def jsonl_round_trip(t):
    path = scratch_path(t.spark, "jsonl")
    t.conversations.write.json(path)
    return RD.read_jsonl(t.spark, path, t.conversations.schema)


@query("json_array_round_trip", "S-03", "select conv_id, count(*) as n_turns from conversations group by conv_id")
def json_array_round_trip(t):
    """One array of records per conversation, written as text and read as documents."""
    path = scratch_path(t.spark, "jsonarray")
    turns = t.conversations.groupBy("conv_id").agg(F.to_json(F.collect_list(F.struct("conv_id", "turn"))).alias("value"))  # one conversation
    turns.select("value").write.text(path)
    schema = t.conversations.select("conv_id", "turn").schema
    back = t.spark.read.text(path).select(F.inline(F.from_json("value", f"array<{schema.simpleString()}>")))
    return back.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))


@query("export_splits", "S-09", """
with r as (select doc_id, toxic, row_number() over (partition by toxic order by md5(doc_id || '|7')) as p, count(*) over (partition by toxic) as n from labels)
select case when p <= floor(n*0.7+0.5) then 'train' when p <= floor(n*0.85+0.5) then 'valid' else 'test' end as fold, count(*) as n, sum(toxic)::bigint as toxic from r group by 1""")
def export_splits(t):
    path = scratch_path(t.spark, "splits")
    SK.export_splits(stratified_split(t).select("doc_id", "toxic", "fold"), path)
    back = t.spark.read.option("header", True).schema("doc_id long, toxic int, fold string").csv(path)
    return back.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic"))


@query("table_manifest", "S-10")
def table_manifest(t):
    return SK.write_table_with_manifest(t.orders, scratch_path(t.spark, "orders"), ["o_orderkey"])


@query("report_json", "S-11", f"""
select lang, tp, fp, fn, tn from (select lang, count(*) filter (where y and rule) as tp, count(*) filter (where not y and rule) as fp, count(*) filter (where y and not rule) as fn,
 count(*) filter (where not y and not rule) as tn from {PAIRS} group by lang)""")
def report_json(t):
    path = scratch_path(t.spark, "report")
    counts = E.confusion_matrix(pairs(t), "y", "rule", ["lang"]).select("lang", "tp", "fp", "fn", "tn")
    SK.write_report_json(counts, path, ["lang"])
    back = t.spark.read.schema("lang string, metrics struct<tp:long,fp:long,fn:long,tn:long>").json(path)
    return back.select("lang", "metrics.*")


@query("history_upsert", "S-13", """
with h as (select 'q' || (conv_id % 20) as query, conv_id*1000+turn as saved_at, case when turn % 5 = 4 then 'erro' else 'ok' end as status, role as result, conv_id % 2 = 0 as old from conversations),
m as (select * from h where old or status <> 'erro'), l as (select *, row_number() over (partition by query order by saved_at desc, result desc) as rn from m)
select query, saved_at, status, result from l where rn = 1 order by saved_at desc, query limit 12""")
def history_upsert(t):
    rows = t.conversations.select(F.concat(F.lit("q"), (F.col("conv_id") % 20).cast("string")).alias("query"), (F.col("conv_id") * 1000 + F.col("turn")).alias("saved_at"),
                                  F.when(F.col("turn") % 5 == 4, "erro").otherwise("ok").alias("status"), F.col("role").alias("result"), "conv_id")
    old, new = rows.filter(F.col("conv_id") % 2 == 0).drop("conv_id"), rows.filter(F.col("conv_id") % 2 != 0).drop("conv_id")
    return SK.history_upsert(old, new)


@query("required_columns", "P-14", "select doc_id, quality from labels")
def required_columns(t):
    return P.assert_columns(t.labels, ["doc_id", "quality"], ["answer"])


@query("sealed_evaluation", "E-13", f"""
select 1 as touches, count(*) as n, round(count(*) filter (where y and model)/greatest(count(*) filter (where model),1),6) as precision from {PAIRS}""")
def sealed_evaluation(t):
    """Opened twice: the second call returns what the first one stored."""
    path = scratch_path(t.spark, "ledger")
    TR.sealed_evaluation(path, pairs(t), "pair_id", "y", "model", "score")
    ledger = TR.sealed_evaluation(path, pairs(t), "pair_id", "y", "model", "score")
    return ledger.select("touches", "n", F.get_json_object("result", "$.precision").cast("double").alias("precision"))
