"""Event frame and comparison queries. Headlines are derived from orders, lines and their dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_spark import lexicons as L
from evidence_spark.functions import dates
from evidence_spark.functions import text as X
from evidence_spark.operators import events as EV
from evidence_spark.plans import sqltext as S
from evidence_spark.plans.registry import query

WHO = ["Senado", "Ministério da Saúde", "STF", "Prefeitura de Campinas", "Petrobras", "Banco Central"]
ACTS = ["aprova", "anuncia", "não aprova", "suspende", "reduz", "aumenta", "entra com ação contra", "diz que aprova"]
WHAT = ["o reajuste da tarifa", "a lei das apostas", "o contrato de 30 dias", "a taxa de 12%", "a vacina"]


def headline(key):
    pick = lambda names, c: F.element_at(X.words_array(names), (c % len(names) + 1).cast("int"))
    return F.concat_ws(" ", pick(WHO, key), pick(ACTS, F.floor(key / 7)), pick(WHAT, F.floor(key / 3)))


HEAD_SQL = "(({who})[(k % {a}) + 1] || ' ' || ({acts})[((k // 7) % {b}) + 1] || ' ' || ({what})[((k // 3) % {c}) + 1])".format(
    who=S.words(WHO), acts=S.words(ACTS), what=S.words(WHAT), a=len(WHO), b=len(ACTS), c=len(WHAT))


def headlines(t):
    return t.orders.select("o_orderkey", headline(F.col("o_orderkey")).alias("title"), "o_orderdate")


CASES = " ".join(f"when regexp_matches(tail,{S.q('^(?:' + p + ') ')}) then '{n}'" for n, p in EV.ordered_actions())


@query("action_class", "C-10", f"""
with h as (select distinct o_orderkey, string_split({S.norm(HEAD_SQL)},' ') as w from (select *, o_orderkey as k from orders)),
d as (select w, count(*) as n from h group by w),
x as (select w, n, unnest(range(1,len(w)+1)) as i from d),
y as (select w, n, i, case {CASES} end as cls from (select *, array_to_string(w[i:i+5],' ') || ' ' as tail from x)),
a as (select * from y where cls is not null),
f as (select a.* from a where not exists (select 1 from (select unnest(range(greatest(a.i-3,1),a.i)) as q) z where list_contains({S.words(L.SUBORDINATORS_PT)}, a.w[z.q])
  and not exists (select 1 from a o where o.w = a.w and o.i > z.q and o.i < a.i))),
m as (select w, any_value(n) as n, arg_min(cls, i) as cls from f group by w),
r as (select d.w, d.n, m.cls from d left join m using (w))
select cls as action, sum(n)::bigint as n from r group by 1""")
def action_class(t):
    """Headlines repeat: each distinct one is read once and carries its count."""
    titles = headlines(t).groupBy("title").agg(F.count(F.lit(1)).alias("n"))
    frames = EV.event_frames(titles, ["n"], "title")
    return frames.groupBy("action").agg(F.sum("n").alias("n"))


@query("event_frames", "C-10")
def event_frames(t):
    titles = headlines(t).groupBy("title").agg(F.count(F.lit(1)).alias("n"))
    f = EV.event_frames(titles, ["n"], "title")
    text = lambda c: F.array_join(F.array_sort(c), " ")
    return f.select("sentence", "n", "action", text("agent_names").alias("agent"), text("object_keys").alias("object"), text("nouns").alias("nouns"), "negated", "stage", "passive")


@query("sentence_actions", "C-10")
def sentence_actions(t):
    """Frames of every sentence of the documents, counted by action and negation."""
    sents = t.documents.select("doc_id", F.explode(X.sentences("text", ".!?", 12)).alias("s"))
    return EV.event_frames(sents, ["doc_id"], "s").groupBy("action", "negated").agg(F.count(F.lit(1)).alias("n"))


def originals(t):
    claims = t.orders.select("o_orderkey", headline(F.col("o_orderkey")).alias("claim"), F.concat(
        headline(F.col("o_orderkey")), F.lit(". O texto trata de "), F.col("o_orderpriority"), F.lit(".")).alias("body"), F.col("o_orderdate").alias("published"))
    return EV.original_events(claims, "o_orderkey", "claim", "body", "published")


@query("original_events", "C-11")
def original_events(t):
    o = originals(t)
    return o.select("o_orderkey", "action", F.array_join(F.array_sort("agent_names"), " ").alias("agent"), F.array_join(F.array_sort("object_keys"), " ").alias("object"),
                    F.col("date.day").alias("day"), "date_explicit")


@query("compare_events", "C-16")
def compare_events(t):
    """Every original against the headlines of the next orders."""
    o = originals(t)
    o = o.select("o_orderkey", *[F.col(c).alias(f"o_{c}") for c in ("action", "agent_names", "agent_words", "object_keys", "nouns", "names", "numbers", "negated",
                                                                 "attribution", "other_actions", "date", "date_explicit")])
    titles = t.orders.select("o_orderkey", headline(F.col("o_orderkey")).alias("title"), F.to_date("o_orderdate").alias("published"))
    frames = EV.frames_of_distinct(titles, ["o_orderkey", "published"], "title")
    c = frames.select(F.col("o_orderkey").alias("c_id"), F.col("published").alias("c_published"),
                      F.struct(F.col("published").alias("day"), F.lit("dia").alias("granularity")).alias("c_date"), F.lit(False).alias("c_date_explicit"),
                      *[F.col(n).alias(f"c_{n}") for n in ("action", "agent_names", "agent_words", "object_keys", "nouns", "names", "target", "numbers", "negated", "attribution")])
    near = t.orders.select("o_orderkey", F.explode(F.array(*[F.col("o_orderkey") + d for d in (1, 2, 6, 42, 210)])).alias("c_id"))
    return EV.compare_events(near.join(o, "o_orderkey").join(c, "c_id"), ["o_orderkey", "c_id"])


FACTS = """(select event_id, (['match','conflict','unknown'])[(event_id%3)+1] as agent, event_id%4<>0 as has_action, user_id%2=0 as same_action, user_id%3=0 as obj, event_id%11=0 as disjoint, event_id%5=0 as named,
 (event_id%4)::integer as shared, event_id%17=0 as noobj, case when event_id%2=0 then round((value%10)/10,4) end as sem, ts::date as c_day, date '2024-01-15' as o_day, event_id%7=0 as ce, event_id%13=0 as oe, ts::date + (event_id%9)::integer as pub,
 event_id%6=0 as oneg, event_id%10=0 as cneg, event_id%19=0 as onum, event_id%23=0 as surv from events)"""


@query("event_verdict", "C-16 F-13", f"""
with f as (select *, case when not named and disjoint then 'outro_acontecimento' when not has_action then case when agent<>'conflict' and (obj or shared>=2) then 'relacao_incerta' when obj then 'contexto_relacionado' else 'outro_acontecimento' end
 when not same_action then case when obj then 'contexto_relacionado' else 'outro_acontecimento' end when agent='conflict' then case when obj then 'contexto_relacionado' else 'outro_acontecimento' end
 when agent='unknown' then case when obj then 'relacao_incerta' else 'outro_acontecimento' end when obj or noobj then 'mesmo_acontecimento' when sem>=0.72 then 'mesmo_acontecimento' when sem<0.55 then 'outro_acontecimento' else 'relacao_incerta' end as first,
 case when ce and oe then case when abs(c_day-o_day)>1 then case when c_day<o_day then 'antes' else 'depois' end end when ce and abs(pub-o_day)<=7 then 'mesma_epoca'
  when ce then case when c_day<o_day-7 then 'antes' when c_day>o_day+1 then 'depois' end when oe then case when c_day<o_day-1 then 'antes' when c_day>o_day+7 then 'tarde' end
  else case when c_day<o_day-7 then 'antes' when c_day>o_day+7 then 'tarde' end end as wh from {FACTS}),
g as (select *, case when first='mesmo_acontecimento' and wh='antes' then 'contexto_relacionado' when first='mesmo_acontecimento' and wh='depois' then 'outro_acontecimento' when first='mesmo_acontecimento' and wh='tarde' then 'relacao_incerta' else first end as dated,
  coalesce(first='mesmo_acontecimento' and wh='antes', false) as earlier from f)
select case when dated='mesmo_acontecimento' and surv then 'contexto_relacionado' when dated='mesmo_acontecimento' and (oneg<>cneg or onum) then 'detalhe_divergente' else dated end as kind, earlier, wh as "when", count(*) as n from g group by all""")
def event_verdict(t):
    e, u = F.col("event_id"), F.col("user_id")
    agent = F.element_at(X.words_array(["match", "conflict", "unknown"]), (e % 3 + 1).cast("int"))
    first = EV.verdict(agent, e % 4 != 0, u % 2 == 0, u % 3 == 0, e % 11 == 0, e % 5 == 0, e % 4, e % 17 == 0,
                       F.when(e % 2 == 0, F.round(F.col("value") % 10 / 10, 4)))
    day = lambda c: F.struct(c.alias("day"), F.lit("dia").alias("granularity"))
    when = EV.date_verdict(day(F.lit("2024-01-15").cast("date")), e % 13 == 0, day(F.to_date("ts")), e % 7 == 0, F.date_add(F.to_date("ts"), (e % 9).cast("int")))
    staged = t.events.select(first.alias("first"), when.alias("when"), e)
    act = F.lit("aprovar")
    kind, earlier = EV.settle(F.col("first"), F.col("when"), act, act, e % 6 == 0, e % 10 == 0, e % 19 == 0, e % 23 == 0)
    return staged.select(kind.alias("kind"), earlier.alias("earlier"), "when").groupBy("kind", "earlier", "when").agg(F.count(F.lit(1)).alias("n"))


@query("age_of_facts", "F-12", """
select o_orderkey % 3 as kind, count(*) as n, count(*) filter (where o_orderkey % 3 <> 2) as dated from orders group by 1""")
def age_of_facts(t):
    text = F.when(F.col("o_orderkey") % 3 == 0, "Decidiu ontem").when(F.col("o_orderkey") % 3 == 1, "Em maio de 1996 decidiu").otherwise("Decidiu")
    folded = t.orders.select((F.col("o_orderkey") % 3).alias("kind"), "o_orderdate", dates.padded_fold(text).alias("t"))
    found = folded.select("kind", dates.fact_date("t", "o_orderdate").alias("d"))
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d").isNotNull()).alias("dated"))
