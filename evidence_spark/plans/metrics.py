"""Evaluation queries over the scored pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_spark.functions import numbers as N
from evidence_spark.operators import evaluation as E
from evidence_spark.operators import profile as P
from evidence_spark.plans import sqltext as S
from evidence_spark.plans.pairs import PAIRS, pairs
from evidence_spark.plans.registry import query

CM = """count(*) filter (where y and pred) as tp, count(*) filter (where not y and pred) as fp,
  count(*) filter (where y and not pred) as fn, count(*) filter (where not y and not pred) as tn"""


@query("confusion_matrix", "A-11", f"""
select *, round(100*tp/(tp+fp+fn+tn),2) as tp_per_100, round(100*fp/(tp+fp+fn+tn),2) as fp_per_100,
  round(100*fn/(tp+fp+fn+tn),2) as fn_per_100, round(100*tn/(tp+fp+fn+tn),2) as tn_per_100
from (select lang, {CM} from (select *, rule as pred from {PAIRS}) group by lang)""")
def confusion_matrix(t):
    return E.confusion_matrix(pairs(t), "y", "rule", ["lang"])


@query("precision_recall", "A-12", f"""
select lang, round(count(*) filter (where y and model)/greatest(count(*) filter (where model),1),6) as precision,
  round(count(*) filter (where y and model)/greatest(count(*) filter (where y),1),6) as recall from {PAIRS} group by lang""")
def precision_recall(t):
    pr = E.precision_recall(F.col("y"), F.col("model"))
    return pairs(t).groupBy("lang").agg(*[F.round(c, 6).alias(n) for n, c in pr.items()])


REPORT = f"""with base as (select case when y then 'true' else 'false' end as t, case when rule then 'true' else 'false' end as p from {PAIRS}),
classes as (select t as class from base union select p from base),
per as (select class, (select count(*) from base where t=class) as support, (select count(*) from base where p=class) as shown,
  (select count(*) from base where t=class and p=class) as hits from classes),
pr as (select class, support, case when shown>0 then hits/shown else 0 end as precision, case when support>0 then hits/support else 0 end as recall from per),
f as (select *, case when precision+recall>0 then 2*precision*recall/(precision+recall) else 0 end as f1 from pr)
select class, support::bigint as support, round(precision,6) as precision, round(recall,6) as recall, round(f1,6) as f1 from f
union all select 'macro avg', sum(support)::bigint, round(avg(precision),6), round(avg(recall),6), round(avg(f1),6) from f
union all select 'weighted avg', sum(support)::bigint, round(sum(precision*support)/sum(support),6), round(sum(recall*support)/sum(support),6),
  round(sum(f1*support)/sum(support),6) from f"""


@query("classification_report", "A-13", REPORT)
def classification_report(t):
    return E.classification_report(pairs(t), "y", "rule")


@query("accuracy_summary", "A-14", f"""
select round(avg((y=rule)::int),6) as accuracy,
  round(greatest(count(*) filter (where y), count(*) filter (where not y))/count(*),6) as majority_baseline, count(*) as n from {PAIRS}""")
def accuracy_summary(t):
    return E.accuracy_summary(pairs(t), "y", "rule")


def _measures(d):
    return (f"count(*) filter (where {d}) as {d}_shown, "
            f"round(10*(count(*) filter (where y and {d})/greatest(count(*) filter (where y),1)),2) as {d}_recall_per_10, "
            f"round(count(*) filter (where y and {d})/greatest(count(*) filter (where {d}),1),3) as {d}_precision")


SLICES = " union all ".join(
    f"select '{d}' as dimension, {d} as value, count(*) as n, count(*) filter (where y) as positives, {_measures('rule')}, "
    f"{_measures('model')}, count(*) filter (where y) < 10 as small_sample from {PAIRS} group by {d}"
    for d in ("grp", "lang", "size_band"))


@query("slice_metrics", "A-15 W-18", SLICES)
def slice_metrics(t):
    return E.slice_metrics(pairs(t), "y", ["rule", "model"], ["grp", "lang", "size_band"])


@query("worst_best_slice", "A-16", f"""
select dimension, arg_min(value, row(model_precision, value)) as worst, min(model_precision) as worst_measure,
  arg_max(value, row(model_precision, value)) as best, max(model_precision) as best_measure from ({SLICES}) group by dimension""")
def worst_best_slice(t):
    return E.worst_best_slice(slice_metrics(t), "model_precision")


@query("accuracy_by", "A-29", f"""
select grp, round(avg((y=model)::int),6) as accuracy, count(*) as n from {PAIRS} group by grp""")
def accuracy_by(t):
    return E.accuracy_by(pairs(t), "grp", "y", "model")


@query("calibration_table", "A-18", f"""
select least(floor(score*10),9)::integer as bin, count(*) as n, round(avg(score),6) as mean_score,
  round(avg(y::int),6) as positive_share from {PAIRS} group by 1 having count(*) >= 5""")
def calibration_table(t):
    return E.calibration_table(pairs(t), "y", "score")


@query("wilson_interval", "A-19", f"""
with g as (select grp, count(*) filter (where y) as k, count(*) as n from {PAIRS} group by grp),
c as (select *, k/n as p, 1+1.96*1.96/n as den from g)
select grp, k, n, round(greatest(0,((p+1.96*1.96/(2*n))/den) - 1.96*sqrt(p*(1-p)/n+1.96*1.96/(4*n*n))/den),3) as low,
  round(least(1,((p+1.96*1.96/(2*n))/den) + 1.96*sqrt(p*(1-p)/n+1.96*1.96/(4*n*n))/den),3) as high from c""")
def wilson_interval(t):
    rates = pairs(t).groupBy("grp").agg(F.count_if("y").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = E.wilson_interval(F.col("k").cast("double"), F.col("n").cast("double"))
    return rates.select("grp", "k", "n", low.alias("low"), high.alias("high"))


@query("agreement_kappa", "A-20", f"""
with b as (select lang, rule as a, model as b from {PAIRS}),
t as (select lang, count(*) as n, count(*) filter (where a=b) as agreed, count(*) filter (where a) as a1, count(*) filter (where b) as b1 from b group by lang),
k as (select *, agreed/n as po, (a1*b1 + (n-a1)*(n-b1))/(n*n) as pe from t)
select lang, n, agreed, round(100*po,1) as agree_per_100, round(case when pe<1 then (po-pe)/(1-pe) end,4) as kappa,
  round(case when pe<1 then (po-pe)/(1-pe) end,4) >= 0.6 and round(100*po,1) >= 85 as passes from k""")
def agreement_kappa(t):
    return E.agreement(pairs(t), "rule", "model", ["lang"])


@query("overlap_of_deciders", "A-21", f"""
select count(*) filter (where y and rule and not model) as only_rule, count(*) filter (where y and model and not rule) as only_model,
  count(*) filter (where y and rule and model) as both, count(*) filter (where not y and rule) as rule_fp,
  count(*) filter (where not y and model) as model_fp, count(*) filter (where not y and rule and model) as shared_fp,
  count(*) filter (where y and (rule or model)) as union_tp, count(*) filter (where not y and (rule or model)) as union_fp,
  count(*) filter (where y and rule and model) as veto_tp, count(*) filter (where not y and rule and model) as veto_fp from {PAIRS}""")
def overlap_of_deciders(t):
    return E.overlap_of_deciders(pairs(t), "y", "rule", "model")


CUTS = [0.1, 0.15, 0.2, 0.3, 0.5]


@query("promotion_table", "A-22", " union all ".join(f"""
select {c}::double as cut, count(*) filter (where not rule and score>={c}) as promoted, count(*) filter (where not rule and score>={c} and y) as promoted_right,
  count(*) filter (where not rule and score>={c} and not y) as promoted_wrong, count(*) filter (where rule and score<{c}) as warned,
  count(*) filter (where rule and score<{c} and not y) as warned_rule_wrong from {PAIRS}""" for c in CUTS))
def promotion_table(t):
    return E.promotion_table(pairs(t), "y", "rule", "score", CUTS)


CURVE = f"""(select cut, shown, tp, shown - tp as fp, positives, n_rows, tp_here, tp/greatest(shown,1) as precision,
  tp/greatest(positives,1) as recall from (
  select cut, sum(n) over w as shown, sum(pos) over w as tp, pos as tp_here, sum(pos) over () as positives, sum(n) over () as n_rows
  from (select score as cut, count(*) as n, count(*) filter (where y) as pos from {PAIRS} group by score)
  window w as (order by cut desc)))"""


@query("pr_curve", "W-06", f"""
select cut, shown::bigint as shown, tp::bigint as tp, round(precision,6) as precision, round(recall,6) as recall from {CURVE}""")
def pr_curve(t):
    curve = E.pr_curve(pairs(t), "y", "score")
    return curve.select("cut", "shown", "tp", N.rounded("precision", 6).alias("precision"), N.rounded("recall", 6).alias("recall"))


@query("average_precision", "W-06 E-22", f"""
select round(sum(tp_here/greatest(positives,1)*precision),6) as average_precision, max(positives)::bigint as positives from {CURVE}""")
def average_precision(t):
    return E.average_precision(pairs(t), "y", "score")


@query("threshold_at_precision", "W-07", f"""
select min(cut) as cut, round(arg_min(precision,cut),6) as precision, round(arg_min(recall,cut),6) as recall,
  arg_min(shown,cut)::bigint as shown from {CURVE} where precision >= 0.25""")
def threshold_at_precision(t):
    return E.threshold_at_precision(pairs(t), "y", "score", 0.25)


@query("threshold_for_fp_budget", "W-08", f"""
with c as (select cut, sum(fp) over (order by cut desc) as fp, sum(tp) over (order by cut desc) as tp from (
  select score as cut, count(*) filter (where not y and not rule) as fp, count(*) filter (where y and not rule) as tp from {PAIRS} group by score)),
f as (select count(*) filter (where not y) as neg, count(*) filter (where not y and rule) as bfp, count(*) filter (where y and rule) as btp,
  count(*) filter (where y) as pos from {PAIRS}),
r as (select cut, (bfp+fp)/greatest(neg,1) as fp_rate, (btp+tp)/greatest(pos,1) as recall from c, f)
select min(cut) as cut, round(arg_min(fp_rate,cut),6) as fp_rate, round(arg_min(recall,cut),6) as recall from r where fp_rate <= 0.5""")
def threshold_for_fp_budget(t):
    return E.threshold_for_fp_budget(pairs(t), "y", "rule", "score", 0.5)


@query("best_accuracy_threshold", "W-09", f"""
with r as (select cut, (tp + (n_rows - positives - fp))/n_rows as accuracy, fp, positives - tp as fn from {CURVE})
select arg_max(cut, row(accuracy,cut)) as cut, round(max(accuracy),6) as accuracy, arg_max(fp, row(accuracy,cut))::bigint as accepted_by_mistake,
  arg_max(fn, row(accuracy,cut))::bigint as lost from r""")
def best_accuracy_threshold(t):
    return E.best_accuracy_threshold(pairs(t), "y", "score")


@query("errors_at_best_accuracy", "W-09", f"""
with r as (select cut, (tp + (n_rows - positives - fp))/n_rows as accuracy from {CURVE}), b as (select arg_max(cut, row(accuracy,cut)) as cut from r)
select pair_id, score, case when y then 'lost' else 'accepted_by_mistake' end as error from {PAIRS}, b where y <> (score >= cut)""")
def errors_at_best_accuracy(t):
    return E.errors_at_best_accuracy(pairs(t), "y", "score", "pair_id")


@query("hybrid_decider", "M-17", f"""
with f as (select count(*) filter (where compared and rule) as rs, count(*) filter (where compared and rule and y) as rt, count(*) filter (where y) as pos from {PAIRS}),
c as (select cut, sum(n) over (order by cut desc) as shown, sum(p) over (order by cut desc) as tp from (
  select score as cut, count(*) as n, count(*) filter (where y) as p from {PAIRS} where not compared group by score)),
r as (select cut, (tp+rt)/greatest(shown+rs,1) as precision, (tp+rt)/greatest(pos,1) as recall from c, f)
select min(cut) as cut, round(arg_min(precision,cut),6) as precision, round(arg_min(recall,cut),6) as recall from r where precision >= 0.15""")
def hybrid_decider(t):
    return E.hybrid_decider(pairs(t), "y", "compared", "rule", "score", 0.15)


@query("decision_crosstab", "J-16", f"""
select rule, model, count(*) as n, count(*) filter (where y) as positives, round(100*avg(y::int),1) as positive_per_100
from {PAIRS} group by rule, model""")
def decision_crosstab(t):
    return E.decision_crosstab(pairs(t), "rule", "model", "y")


@query("worst_errors", "T-03", f"""
(select 'shown_by_mistake' as kind, pair_id, score from {PAIRS} where model and not y order by score desc, pair_id limit 15)
union all (select 'missed', pair_id, score from {PAIRS} where not model and y order by score, pair_id limit 15)""")
def worst_errors(t):
    return E.worst_errors(pairs(t), "y", "model", "score", "pair_id")


@query("logit_stretch", "P-17", f"""select pair_id, round({S.logit('score')},6) as stretched from {PAIRS}""")
def logit_stretch(t):
    return pairs(t).select("pair_id", F.round(N.logit("score"), 6).alias("stretched"))


@query("lookalike_negatives", "A-07", f"""
with r as (select quantile_cont(score,0.5) as ruler from {PAIRS} where y)
select size_band, count(*) as n, count(*) filter (where y) as positives, count(*) filter (where not y and score>=ruler) as lookalikes,
  count(*) filter (where y and score>=ruler) as positives_above_ruler, round(max(ruler),6) as ruler from {PAIRS}, r group by size_band""")
def lookalike_negatives(t):
    return P.lookalike_negatives(pairs(t), "score", "y", "size_band")


@query("cluster_bootstrap_diff", "E-20")
def cluster_bootstrap_diff(t):
    return E.cluster_bootstrap_diff(pairs(t), "y", "model", "rule", "grp")


@query("precision_contract", "E-21")
def precision_contract(t):
    return E.contract(pairs(t), "y", "model", "rule", "grp")


@query("scoreboard", "E-22")
def scoreboard(t):
    return E.scoreboard(pairs(t), "y", {"rule": None, "model": "score"}, "rule", "grp")
