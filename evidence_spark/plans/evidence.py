"""Evidence and synthesis queries. Claims and evidence rows are derived from orders and their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_spark.functions import numbers as N
from evidence_spark.functions import text as X
from evidence_spark.lexicons import EUROPEAN
from evidence_spark.operators import claims as C
from evidence_spark.operators import evidence as EV
from evidence_spark.plans import sqltext as S
from evidence_spark.plans.registry import query
from evidence_spark.session import kept

TYPES = ["contagem", "acontecimento_recente", "quantidade_periodo", "fato_historico", "opiniao", "acontecimento"]


def order_claims(t):
    o = t.orders
    kind = F.element_at(X.words_array(TYPES), (F.col("o_orderkey") % len(TYPES) + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("claim_id"), kind.alias("claim_type"), (F.col("o_orderkey") % 7 != 0).alias("has_value"),
                    (F.col("o_orderkey") % 13 != 0).alias("comparable"), (F.col("o_custkey") % 11 == 0).alias("detail_negated"),
                    (F.col("o_custkey") % 3).alias("direct_count"))


def line_evidence(t):
    v = F.floor(F.col("l_quantity") / 10) * 10
    return t.lineitem.select(
        F.col("l_orderkey").alias("claim_id"), (F.col("l_suppkey") % 4).cast("string").alias("evidence_group"), F.col("l_partkey").cast("string").alias("url"),
        F.when(F.col("l_linenumber") % 3 == 0, "trecho").otherwise("completo").alias("kind"),
        F.when(F.col("l_discount") > 0.08, "outro_periodo").when(v >= 30, "apoia").otherwise("contradiz").alias("relation"),
        v.cast("double").alias("value"), (F.col("l_tax") > 0.01).alias("explicit"),
        F.when(F.col("l_tax") < 0.07, F.year("l_shipdate")).alias("period"))


CLAIMS_SQL = f"(select o_orderkey as claim_id, ({S.words(TYPES)})[(o_orderkey % {len(TYPES)})+1] as claim_type, o_orderkey%7<>0 as has_value, o_orderkey%13<>0 as comparable, o_custkey%11=0 as detail_negated, o_custkey%3 as direct_count from orders)"
LINES_SQL = """(select l_orderkey as claim_id, (l_suppkey%4)::varchar as evidence_group, l_partkey::varchar as url, case when l_linenumber%3=0 then 'trecho' else 'completo' end as kind,
 case when l_discount>0.08 then 'outro_periodo' when floor(l_quantity/10)*10>=30 then 'apoia' else 'contradiz' end as relation, floor(l_quantity/10)*10 as value, l_tax>0.01 as explicit,
 case when l_tax<0.07 then year(l_shipdate) end as period from lineitem)"""
REPS = f"""c as (select claim_id, evidence_group, explicit, value, count(*) as n, min({{'url': url, 'relation': relation, 'period': period}}) as first from {LINES_SQL}
  where relation in ('apoia','contradiz','valor') and kind in ('completo','resumo') group by all),
reps as (select claim_id, evidence_group, explicit, value, first.relation as relation, first.period as period, first.url as url from (select *, row_number() over (partition by claim_id, evidence_group order by explicit desc, n desc, value) as rn from c) where rn=1)"""


@query("representatives", "E-04", f"with {REPS} select claim_id, evidence_group, explicit, value, relation, url from reps")
def representatives(t):
    return EV.representatives(line_evidence(t)).select("claim_id", "evidence_group", "explicit", "value", "relation", "url")


SAME = "abs({a}-{b}) <= 0.005*greatest(abs({a}),abs({b}),1e-9)"
SYN = f"""with {REPS}, nm as (select * from reps where explicit),
per as (select claim_id, count(*) as n_reps, count(*) filter (where relation='apoia') as support, count(*) filter (where relation='contradiz') as against,
  {SAME.format(a='min(value)', b='max(value)')} as one_value, count(*) filter (where period is null) as undated from nm group by 1),
bp as (select claim_id, period, {SAME.format(a='min(value)', b='max(value)')} and min(relation)=max(relation) as agrees, min(relation) as relation from nm where period is not null group by all),
nw as (select claim_id, arg_max(agrees, period) as agrees, arg_max(relation, period) as nrel from bp group by 1),
j as (select c.*, per.*  exclude (claim_id), nw.agrees, nw.nrel from {CLAIMS_SQL} c left join per using (claim_id) left join nw using (claim_id)),
s as (select *, case when claim_type in ('opiniao','previsao') then 'nao_verificavel' when not comparable then case when direct_count>0 then 'sem_comparacao' else 'insuficiente' end
  when n_reps is null then 'insuficiente' when not has_value then case when one_value then 'resposta' else 'divergentes' end
  when against>0 and support=0 then 'contradizem'
  when claim_type in ('contagem','acontecimento_recente') and not one_value and undated=0 and coalesce(agrees,false) then case when nrel='apoia' then 'apoiam' else 'contradizem' end
  when not one_value and claim_type in ('contagem','acontecimento_recente') then 'divergentes' when support>0 and against=0 then 'apoiam' else 'divergentes' end as raw from j),
y as (select claim_id, case when detail_negated and raw='apoiam' then 'contradizem' when detail_negated and raw='contradizem' then 'apoiam' else raw end as situation, coalesce(n_reps,0) as n_reps, has_value from s)"""


@query("synthesis", "E-04", SYN + " select claim_id, situation, n_reps from y")
def synthesis(t):
    return EV.synthesise(order_claims(t), line_evidence(t)).select("claim_id", "situation", "n_reps")


@query("indication", "E-05", SYN + """
select claim_id, case when situation='nao_verificavel' then 'inconclusiva' when not has_value then case when situation='resposta' then 'resposta' else 'sem_resposta' end
  when situation='apoiam' then 'dados_compativeis' when situation='contradizem' then 'dados_diferentes' else 'inconclusiva' end as label,
  n_reps=1 and situation in ('apoiam','contradizem','resposta') as single_source from y""")
def indication(t):
    return EV.indicate(EV.synthesise(order_claims(t), line_evidence(t))).select("claim_id", "label", "single_source")


NAMED_SQL = f"""(select l_orderkey as claim_id, (l_suppkey%4)::varchar as evidence_group, l_partkey::varchar as url, case when l_linenumber%3=0 then 'trecho' else 'completo' end as kind,
 case when floor(l_quantity/10)*10>=30 then 'apoia' else 'contradiz' end as relation, floor(l_quantity/10)*10 as value, list_contains(string_split(title,' '), entity) as explicit,
 case when l_tax<0.07 then year(l_shipdate) end as period, case when l_returnflag <> 'R' and title <> entity and list_contains(string_split(title,' '), entity) then title end as source_entity
 from (select *, case when l_suppkey % 2 = 0 then p_name else string_split(p_name,' ')[2] end as title from lineitem join part on p_partkey = l_partkey)
 join (select l_orderkey as k, arg_min(string_split(p_name,' ')[2], row(l_linenumber, l_partkey)) as entity from lineitem join part on p_partkey = l_partkey group by 1) on k = l_orderkey)"""
NAMED = SYN.replace(LINES_SQL, NAMED_SQL).replace("'period': period}", "'period': period, 'source_entity': source_entity}").replace(
    "first.url as url from", "first.url as url, first.source_entity as source_entity from").replace("nm as (select * from reps where explicit)", """
nn as (select claim_id, case when coalesce(count(source_entity) = count(*) and min(source_entity) = max(source_entity), false) then 'other_entity' when count(*) filter (where explicit) = 0 then 'not_named'
  when count(distinct source_entity) filter (where explicit) > 1 and count(distinct value) filter (where explicit and source_entity is not null) > 1 then 'ambiguous_name'
  when count(*) filter (where explicit and source_entity is null) = 0 then 'other_entity' end as reason from reps group by 1),
nm as (select reps.* from reps join nn using (claim_id) where explicit and source_entity is null and reason is null)""")


@query("synthesis_by_name", "E-04 E-08", NAMED + f""" select y.claim_id, situation, n_reps, case when comparable and claim_type not in ('opiniao','previsao') then reason end as reason
from y join {CLAIMS_SQL} c using (claim_id) left join nn using (claim_id)""")
def synthesis_by_name(t):
    """Each line is a source about a part, a claim is about the thing its first line names; titles are that thing or a longer name."""
    thing = F.element_at(F.split("p_name", " "), 2)
    lines = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    asked = lines.groupBy("l_orderkey").agg(F.min_by(thing, F.struct("l_linenumber", "l_partkey")).alias("entity"))
    titled = lines.withColumn("title", F.when(F.col("l_suppkey") % 2 == 0, F.col("p_name")).otherwise(thing)).join(asked, "l_orderkey")
    v = F.floor(F.col("l_quantity") / 10) * 10
    # Names repeat: what a title says about a thing is read once for each two of them.
    named = titled.groupBy("entity", "title").agg(F.lit(0).alias("_n")).select(
        F.col("entity").alias("_e"), F.col("title").alias("_t"), F.array_contains(F.split(X.norm("title"), " "), X.norm("entity")).alias("explicit"),
        EV.source_entity(F.col("entity"), F.col("title"), EUROPEAN).alias("longer"))
    read = titled.join(kept(named, "named"), F.col("entity").eqNullSafe(F.col("_e")) & F.col("title").eqNullSafe(F.col("_t")))
    rows = read.select(
        F.col("l_orderkey").alias("claim_id"), (F.col("l_suppkey") % 4).cast("string").alias("evidence_group"), F.col("l_partkey").cast("string").alias("url"),
        F.when(F.col("l_linenumber") % 3 == 0, "trecho").otherwise("completo").alias("kind"), F.when(v >= 30, "apoia").otherwise("contradiz").alias("relation"),
        v.cast("double").alias("value"), "explicit", F.when(F.col("l_tax") < 0.07, F.year("l_shipdate")).alias("period"), F.when(F.col("l_returnflag") != "R", F.col("longer")).alias("source_entity"))
    return EV.synthesise(order_claims(t), rows).select("claim_id", "situation", "n_reps", "reason")


REL_SQL = """with q as (select l_orderkey as claim_id, l_linenumber, o_totalprice/10000 as v, case o_orderkey%3 when 0 then 'approx' when 1 then 'eq' else 'min' end as cmp, o_custkey%5=0 as neg, l_quantity as xv,
 case l_linenumber%4 when 0 then 'max' else 'eq' end as xc, l_tax>0.07 as xn, case when o_orderkey%4=0 then [] else [l_returnflag] end as cq, case when l_partkey%3=0 then [] else [l_linestatus] end as xq,
 case when o_orderkey%2=0 then [year(o_orderdate)] else [] end as cy, case when l_partkey%2=0 then [year(l_shipdate)] else [] end as xy, o_orderkey%17=0 as novalue from lineitem join orders on l_orderkey=o_orderkey),
i as (select *, case when cmp='approx' then v*0.9 when cmp='min' then v when v>=1000 then v*0.995 else v end as lo, case when cmp='approx' then v*1.1 when cmp='min' then 'infinity'::double when v>=1000 then v*1.005 else v end as hi,
 case when xc='max' then 0 else xv end as xlo, xv as xhi from q)
select case when xn and not neg then 'negada_na_fonte' when len(cq)>0 and len(xq)>0 and len(list_intersect(cq,xq))=0 then 'outra_categoria' when len(cq)>0 and len(xq)=0 then 'sem_categoria'
 when len(cq)=0 and len(xq)>0 then 'categoria_nao_informada' when len(cy)>0 and len(xy)>0 and len(list_intersect(cy,xy))=0 then 'outro_periodo'
 when novalue then case when xc='eq' then 'valor' else 'limite' end when xc='max' and lo<=xhi and xlo<=hi then 'limite' when lo<=xhi and xlo<=hi then 'apoia' else 'contradiz' end as relation, count(*) as n from i group by 1"""


@query("quantity_relations", "E-02", REL_SQL)
def quantity_relations(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    strings, ints = F.array().cast("array<string>"), F.array().cast("array<int>")
    k = F.col("o_orderkey")
    claim = {"value": F.when(k % 17 != 0, F.col("o_totalprice") / 10000), "comparator": F.when(k % 3 == 0, "approx").when(k % 3 == 1, "eq").otherwise("min"),
             "negated": F.col("o_custkey") % 5 == 0, "qual_keys": F.when(k % 4 == 0, strings).otherwise(F.array("l_returnflag")),
             "years": F.when(k % 2 == 0, F.array(F.year("o_orderdate"))).otherwise(ints)}
    found = {"value": F.col("l_quantity"), "comparator": F.when(F.col("l_linenumber") % 4 == 0, "max").otherwise("eq"), "negated": F.col("l_tax") > 0.07,
             "qual_keys": F.when(F.col("l_partkey") % 3 == 0, strings).otherwise(F.array("l_linestatus")),
             "years": F.when(F.col("l_partkey") % 2 == 0, F.array(F.year("l_shipdate"))).otherwise(ints)}
    return j.select(EV.quantity_relation(claim, found, F.lit(None).cast("string")).alias("relation")).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("quantity_evidence", "E-02")
def quantity_evidence(t):
    """Every figure of a document is claimed once and looked for in the sentences of its neighbours."""
    q = C.quantities(t.documents, ["doc_id"], "text", EUROPEAN)
    claims = q.groupBy("doc_id", "unit_key").agg(F.min(F.struct("pos", "value", "comparator", "negated", "unit", "quals")).alias("q")).select(
        F.col("doc_id").alias("claim_id"), "unit_key", "q.value", "q.comparator", "q.negated", "q.unit", C.qualifier_keys(F.col("q.quals")).alias("qual_keys"),
        F.array().cast("array<int>").alias("years"), F.lit(None).cast("string").alias("entity"), F.array().cast("array<string>").alias("prop_stems"))
    near = claims.select("claim_id").distinct().select("claim_id", F.explode(F.array(F.col("claim_id"), F.col("claim_id") + 1)).alias("doc_id"))
    sents = near.join(t.documents, "doc_id").select("claim_id", F.col("doc_id").cast("string").alias("url"), F.col("doc_id").cast("string").alias("cluster_id"),
                                                    F.lit("completo").alias("kind"), F.substring_index("text", "\n", 1).alias("title"),
                                                    F.explode(X.sentences("text", ".!?;", 15)).alias("sentence"))
    return EV.quantity_evidence(claims, sents, EUROPEAN).select("claim_id", "url", "raw", "value", "relation", "explicit")


@query("year_evidence", "E-03", """
with o as (select o_orderkey, 'Contrato ' || o_orderpriority || ' fundado em ' || (1900 + o_orderkey % 90) || ' e pago em ' || year(o_orderdate) as s, 1900 + (o_orderkey*7) % 90 as claimed from orders)
select o_orderkey, (1900 + o_orderkey % 90)::integer as year, case when 1900 + o_orderkey % 90 = claimed then 'apoia' else 'contradiz' end as relation from o""")
def year_evidence(t):
    k = F.col("o_orderkey")
    sentence = F.concat(F.lit("Contrato "), "o_orderpriority", F.lit(" fundado em "), (k % 90 + 1900).cast("string"), F.lit(" e pago em "), F.year("o_orderdate").cast("string"))
    rows = t.orders.select("o_orderkey", sentence.alias("sentence"), X.words_array(["fund"]).alias("stems"), F.array((k * 7 % 90 + 1900).cast("int")).alias("years"))
    return EV.year_evidence(rows, ["o_orderkey"], "sentence", "stems", "years")


METHOD_EN, PERIOD_EN = r"(^| )(the|with|by|des|der|los)( |$)", r"(^| )(from|depuis|seit|desde|on)( |$)"


@query("select_context", "E-06", f"""
with h as (select doc_id, {S.stems_of(S.tokens("string_split(text,chr(10))[1]"))} as head, source, text from documents),
s as (select doc_id, source, head, unnest(list_distinct({S.sentences('text')})) as sentence from h),
f as (select *, {S.norm('sentence')} as n, len(list_intersect(head, {S.stems_of(S.tokens('sentence'))})) as hits from s where length(sentence) between 50 and 320
  and regexp_matches(sentence,'^["“(]?[A-ZÀ-Ý0-9]') and regexp_matches(sentence,'[.!?]["”)]?$') and not ends_with(sentence,'...') and not contains(sentence,'…') and not regexp_matches(sentence,'[0-9]')
  and not regexp_matches(sentence,{S.q(EV.ANAPHORIC)})),
g as (select source, doc_id, sentence, 2*hits + case when regexp_matches(n,{S.q(METHOD_EN)}) then 2 else 0 end + case when regexp_matches(n,{S.q(PERIOD_EN)}) then 1 else 0 end as score from f
  where hits >= 2 and (regexp_matches(n,{S.q(METHOD_EN)}) or regexp_matches(n,{S.q(PERIOD_EN)}))),
u as (select *, row_number() over (partition by source, doc_id order by score desc, sentence desc) as ru from g),
p as (select *, row_number() over (partition by source order by score desc, doc_id) as position from u where ru = 1)
select source as claim_id, doc_id as url, score::integer as score, position::integer as position from p where position <= 2""")
def select_context(t):
    """Explaining sentences for every source: at most one per document, two per source."""
    rows = t.documents.select(F.col("source").alias("claim_id"), F.col("doc_id").alias("url"), X.stems(F.substring_index("text", "\n", 1)).alias("prop_stems"),
                              F.explode(F.array_distinct(X.sentences("text"))).alias("sentence"))
    rows = rows.withColumn("need", F.lit(2)).withColumn("unit_numbers", F.col("sentence").rlike("[0-9]"))
    return EV.select_context(rows, METHOD_EN, PERIOD_EN).select("claim_id", "url", "score", "position")


@query("observations", "E-07", """
with r as (select user_id as claim_id, case when event_type in ('view','click') then 'direto' else 'contexto' end as relation, case event_type when 'signup' then 'propria' when 'error' then 'republicacao' else 'independente' end as independence,
 case when event_id % 9 <> 0 then ts end as published, event_id % 2 as copies, event_id % 40 = 0 as negated, user_id % 3 = 0 as relative from events),
d as (select *, relation='direto' and published is not null as dated, date_diff('day', published::date, date '2024-02-20') as age from r)
select claim_id, sum(copies)::bigint as republished, bool_or(negated) as check_negation, bool_or(relative) and count(*) filter (where dated) > 0 and count(*) filter (where dated and age <= 14) = 0 as older_than_claim,
 not bool_or(relative) and count(*) filter (where dated) > 0 and count(*) filter (where dated and age <= 365) = 0 as all_over_a_year, count(*) filter (where independence='propria') as own,
 count(*) filter (where independence='republicacao') as copies_of_own, count(*) filter (where independence='mesmo_veiculo') as same_outlet from d group by 1""")
def observations(t):
    e = t.events
    rows = e.select(F.col("user_id").alias("claim_id"), F.when(F.col("event_type").isin("view", "click"), "direto").otherwise("contexto").alias("relation"),
                    F.when(F.col("event_type") == "signup", "propria").when(F.col("event_type") == "error", "republicacao").otherwise("independente").alias("independence"),
                    F.when(F.col("event_id") % 9 != 0, F.col("ts")).alias("published"), (F.col("event_id") % 2).alias("copies"),
                    (F.col("event_id") % 40 == 0).alias("negated"), (F.col("user_id") % 3 == 0).alias("relative"))
    return EV.observations(rows, F.lit("2024-02-20").cast("date"))


@query("homonym_check", "E-08", """
select l_orderkey as claim_id, count(distinct l_suppkey % 3) as n_entities, count(distinct l_quantity) as n_values, count(distinct l_suppkey % 3) > 1 and count(distinct l_quantity) > 1 as ambiguous
from lineitem where l_linenumber % 4 <> 0 group by 1""")
def homonym_check(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("claim_id"), F.when(F.col("l_linenumber") % 4 != 0, F.col("l_suppkey") % 3).alias("source_entity"), F.col("l_quantity").alias("value"))
    return EV.homonym_check(rows)


@query("validate_citations", "E-09", """
with a as (select conv_id*1000+turn as answer_id, case when turn % 3 = 0 then 'divergentes' else 'apoiam' end as situation, ['F' || (length(text) % 9), 'F' || (turn + 5)] as cites from conversations where role='assistant'),
p as (select conv_id*1000+turn as answer_id, 'F' || k as packet_id from conversations, range(1,5) r(k) where role='assistant'),
v as (select answer_id, count(*) as valid from (select distinct answer_id, unnest(cites) as packet_id from a) join p using (answer_id, packet_id) group by 1)
select a.answer_id, case when coalesce(valid,0)=0 then 'insuficiente' else situation end as situation, coalesce(valid,0) as valid, coalesce(valid,0)=0 as downgraded from a left join v using (answer_id)""")
def validate_citations(t):
    said = t.conversations.filter(F.col("role") == "assistant").withColumn("answer_id", F.col("conv_id") * 1000 + F.col("turn"))
    cite = lambda c: F.concat(F.lit("F"), c.cast("string"))
    answers = said.select("answer_id", F.when(F.col("turn") % 3 == 0, "divergentes").otherwise("apoiam").alias("situation"),
                          F.array(cite(F.length("text") % 9), cite(F.col("turn") + 5)).alias("citations"))
    packets = said.select("answer_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(4)), cite)).alias("packet_id"))
    return EV.validate_citations(answers, packets)


@query("detail_fanout", "E-11", """
select claim_id, detail::integer as detail, value from (select l_orderkey as claim_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 as detail, l_quantity as value from lineitem) where detail between 1 and 2""")
def detail_fanout(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("claim_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("pos"), F.col("l_quantity").alias("value"))
    return EV.detail_fanout(rows, "claim_id").select("claim_id", "detail", "value")


@query("rubric_score", "A-31", """
with r as (select event_id, (user_id % 3)/2.0 as s, ((event_id // 3) % 3)/2.0 as o, (event_id % 3)/2.0 as i, case when value > 100 then 0.7 else 1.0 end as c, event_id % 20 <> 0 as ok, case when event_id % 30 = 0 then ' ' else 'motivo' end as reason from events),
x as (select event_id, case when ok and c in (0,0.5,1) and trim(reason) <> '' and s > 0 and o > 0 then s*40+o*20+i*20+c*20 end as score from r)
select event_id, score::double as score, case when score is null then 'unknown' when score >= 80 then 'strong' when score >= 50 then 'partial' else 'limited' end as tone from x""")
def rubric_score(t):
    e = F.col("event_id")
    reason = F.when(e % 30 == 0, " ").otherwise("motivo")
    rows = t.events.select(
        "event_id", (F.col("user_id") % 3 / 2).alias("support_level"), (F.floor(e / 3) % 3 / 2).alias("original_level"), (e % 3 / 2).alias("independent_level"),
        F.when(F.col("value") > 100, 0.7).otherwise(1.0).alias("context_level"), (e % 20 != 0).alias("assessable"), F.lit("x").alias("claim"),
        *[reason.alias(f"{n}_reason") for n in EV.CRITERIA])
    return EV.rubric_score(rows, "event_id")
