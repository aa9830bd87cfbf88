"""Join, similarity and duplicate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_spark.functions import numbers as N
from evidence_spark.functions import text as X
from evidence_spark.lexicons import EUROPEAN
from evidence_spark.operators import blocking as B
from evidence_spark.operators import dedupe as D
from evidence_spark.operators import joins as J
from evidence_spark.operators import quality as Q
from evidence_spark.operators import simjoin as SJ
from evidence_spark.operators.ranking import best_per_key
from evidence_spark.plans import sqltext as S
from evidence_spark.plans.registry import query
from evidence_spark.session import cut_lineage, kept
from evidence_spark.plans.splits import MESSAGES, messages

STOP = EUROPEAN.stop


@query("attach_features", "J-01", """
select d.doc_id, d.lang, l.quality, l.toxic from documents d left join labels l using (doc_id)""")
def attach_features(t):
    return J.attach_features(t.documents.select("doc_id", "lang"), t.labels, ["doc_id"])


@query("attach_required_scores", "J-02", """
select lang, count(*) as n, round(sum(score),6) as total from (
  select lang, (d.n_chars % 1000)/1000.0 as score from documents d join labels using (doc_id)) group by lang""")
def attach_required_scores(t):
    scores = t.documents.select("doc_id", "lang", (F.col("n_chars") % 1000 / 1000).alias("score"))
    scored = J.attach_required_scores(t.labels, scores, ["doc_id"], "score")
    return scored.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 6).alias("total"))


@query("join_integrity", "J-03", """
with l as (select o_orderkey as k, count(*) as nl from orders group by 1), r as (select l_orderkey as k, count(*) as nr from lineitem group by 1),
b as (select coalesce(nl,0) as nl, coalesce(nr,0) as nr, l.k as lk, r.k as rk from l full join r using (k))
select sum(nl)::bigint as left_rows, sum(nr)::bigint as right_rows, sum(nl*nr)::bigint as inner_rows, sum(nl*greatest(nr,1))::bigint as left_join_rows,
  count(*) filter (where nr > 1) as duplicate_right_keys, count(*) filter (where rk is null) as left_only_keys, count(*) filter (where lk is null) as right_only_keys from b""")
def join_integrity(t):
    return J.join_integrity_report(t.orders.withColumnRenamed("o_orderkey", "k"), t.lineitem.withColumnRenamed("l_orderkey", "k"), "k")


@query("keep_in_sources", "J-04", """
select doc_id, source from documents where doc_id in (select doc_id from labels where quality = 1)""")
def keep_in_sources(t):
    return J.keep_in(t.documents.select("doc_id", "source"), t.labels.filter(F.col("quality") == 1), ["doc_id"])


@query("keep_out_sources", "J-05", """
select source, count(*) as n from documents where source not in (select source from documents join labels using (doc_id) where toxic = 1 and quality = 0) group by source""")
def keep_out_sources(t):
    bad = t.documents.join(t.labels, "doc_id").filter((F.col("toxic") == 1) & (F.col("quality") == 0)).select("source").distinct()
    return J.keep_out(t.documents, bad, ["source"]).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


FOLD = "case when user_id % 10 < 7 then 'estudo' when user_id % 10 < 9 then 'simulado' else 'prova' end"


@query("split_overlap", "J-06 U-05", f"""
with s as (select {FOLD} as fold, user_id::varchar as user_id, event_id::varchar as event_id, event_type from events),
v as (select 'user_id' as column_name, user_id as value, fold from s union all select 'event_id', event_id, fold from s union all select 'event_type', event_type, fold from s),
c as (select column_name, value, count(distinct fold) as folds from v group by 1, 2)
select column_name, count(*) as n_values, count(*) filter (where folds > 1) as shared from c group by 1""")
def split_overlap(t):
    ten = F.col("user_id") % 10
    fold = F.when(ten < 7, "estudo").when(ten < 9, "simulado").otherwise("prova")
    return J.overlap_report(t.events.withColumn("fold", fold), "fold", ["user_id", "event_id", "event_type"])


@query("assert_no_overlap", "J-06", f"""
select 'user_id' as column_name, count(distinct user_id) as n_values, 0 as shared from events""")
def assert_no_overlap(t):
    ten = F.col("user_id") % 10
    fold = F.when(ten < 7, "estudo").when(ten < 9, "simulado").otherwise("prova")
    return J.assert_no_overlap(t.events.withColumn("fold", fold), "fold", ["user_id"])


@query("split_intersection", "U-05", """
(select 'both' as part, user_id from (select user_id from events where event_type='error' intersect select user_id from events where event_type='signup'))
union all (select 'only_error', user_id from (select user_id from events where event_type='error' and value > 100 except select user_id from events where event_type='signup' and value > 100))""")
def split_intersection(t):
    of = lambda kind, low: t.events.filter((F.col("event_type") == kind) & (F.col("value") > low)).select("user_id")
    both = of("error", 0).intersect(of("signup", 0)).select(F.lit("both").alias("part"), "user_id")
    only = of("error", 100).subtract(of("signup", 100)).select(F.lit("only_error").alias("part"), "user_id")
    return both.union(only)


# --- similarity ---------------------------------------------------------------------------------------------------------

HEADS = f"(select doc_id, {S.title_key('string_split(text,chr(10))[1]', STOP)} as k from documents)"


@query("title_jaccard_pairs", "J-08 F-07 F-09", f"""
with s as (select list_sort(k) as k, min(doc_id) as id, count(*) as n from {HEADS} where len(k) > 0 group by 1)
select x.id as a, y.id as b, round({S.jaccard('x.k', 'y.k')},6) as jaccard, x.n as copies_a, y.n as copies_b
from s x join s y on x.id < y.id and {S.jaccard('x.k', 'y.k')} >= 0.7""")
def title_jaccard_pairs(t):
    heads = t.documents.select("doc_id", X.title_key(F.substring_index("text", "\n", 1), STOP).alias("k"))
    sets = cut_lineage(SJ.distinct_sets(heads, "doc_id", "k"))
    found = SJ.jaccard_join(sets, None, 0.7)
    copies = lambda side: sets.select(F.col("set_id").alias(side), F.col("n_copies").alias(f"copies_{side}"))
    return found.withColumn("jaccard", F.round("jaccard", 6)).join(copies("a"), "a").join(copies("b"), "b").select(
        "a", "b", "jaccard", "copies_a", "copies_b")


@query("page_title_links", "J-08", f"""
with p as (select list_sort(k) as k, min(page_id) as id from (select page_id, {S.title_key("regexp_extract(html,'<title>([^<]*)</title>',1)", STOP)} as k from pages) where len(k) > 0 group by 1),
d as (select list_sort(k) as k, min(doc_id) as id from {HEADS} where len(k) > 0 group by 1)
select p.id as page_id, d.id as doc_id, round({S.jaccard('p.k', 'd.k')},6) as jaccard from p join d on {S.jaccard('p.k', 'd.k')} >= 0.6""")
def page_title_links(t):
    pages = t.pages.select("page_id", X.title_key(F.regexp_extract("html", "<title>([^<]*)</title>", 1), STOP).alias("k"))
    heads = t.documents.select("doc_id", X.title_key(F.substring_index("text", "\n", 1), STOP).alias("k"))
    found = SJ.jaccard_join(SJ.distinct_sets(pages, "page_id", "k"), SJ.distinct_sets(heads, "doc_id", "k"), 0.6)
    return found.select(F.col("a").alias("page_id"), F.col("b").alias("doc_id"), F.round("jaccard", 6).alias("jaccard"))


@query("cosine_pairs", "J-09", """
with u as (select embedding, min(vec_id) as id from embeddings group by 1)
select x.id as a, y.id as b, round(list_dot_product(x.embedding::double[], y.embedding::double[])
  / sqrt(list_dot_product(x.embedding::double[], x.embedding::double[])) / sqrt(list_dot_product(y.embedding::double[], y.embedding::double[])),6) as cosine
from u x join u y on x.id < y.id where list_dot_product(x.embedding::double[], y.embedding::double[])
  / sqrt(list_dot_product(x.embedding::double[], x.embedding::double[])) / sqrt(list_dot_product(y.embedding::double[], y.embedding::double[])) >= 0.4""")
def cosine_pairs(t):
    return SJ.cosine_join(t.embeddings, "vec_id", "embedding", 0.4).withColumn("cosine", F.round("cosine", 6))


@query("cosine_of_pairs", "J-09", """
with p as (select a.vec_id as a, (a.vec_id * 7 + 3) % (select count(*) from embeddings) as b from embeddings a)
select p.a, p.b, round(list_cosine_similarity(x.embedding::double[], y.embedding::double[]),6) as cosine
from p join embeddings x on x.vec_id = p.a join embeddings y on y.vec_id = p.b""")
def cosine_of_pairs(t):
    total = t.embeddings.agg(F.count(F.lit(1)).alias("n"))
    pairs = t.embeddings.select(F.col("vec_id").alias("a")).join(F.broadcast(total)).select(
        "a", ((F.col("a") * 7 + 3) % F.col("n")).alias("b"))
    return SJ.cosine_pairs(pairs, t.embeddings, "a", "b", "vec_id", "embedding").withColumn("cosine", F.round("cosine", 6))


@query("overlap_feature", "J-08", f"""
with b as (select item_id, {S.words3('text')} as w from benchmark), d as (select doc_id, {S.words3('string_split(text,chr(10))[1]')} as w from documents),
p as (select item_id, doc_id from (select item_id, unnest(w) as x from b where len(w) > 0) join (select doc_id, unnest(w) as x from d) using (x) group by all having count(*) >= 5)
select p.item_id, p.doc_id, round({S.jaccard('b.w', 'd.w')},6) as overlap from p join b using (item_id) join d using (doc_id)""")
def overlap_feature(t):
    items = t.benchmark.select("item_id", X.words3("text").alias("wb"))
    docs = t.documents.select("doc_id", X.words3(F.substring_index("text", "\n", 1)).alias("wd"))
    near = (items.select("item_id", F.explode("wb").alias("x")).join(docs.select("doc_id", F.explode("wd").alias("x")), "x")
            .groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 5))
    return near.join(items, "item_id").join(docs, "doc_id").select(
        "item_id", "doc_id", F.round(X.jaccard(F.col("wb"), F.col("wd")), 6).alias("overlap"))


def nearest_second(ts):
    """A time to the nearest second, half to even as an SQL cast does."""
    return F.timestamp_seconds(F.bround(F.unix_micros(F.to_timestamp_ltz(ts)) / 1e6, 0))


@query("near_in_time", "J-10", """
with a as (select event_id as a_id, user_id, case when event_id % 50 <> 0 then ts end as a_ts from events where event_type='signup'),
b as (select event_id as b_id, user_id, case when event_id % 70 <> 0 then ts end as b_ts from events where event_type='purchase')
select a_id, count(*) as n_near from a join b using (user_id) where a_ts is null or b_ts is null or abs(epoch(a_ts)::bigint - epoch(b_ts)::bigint) <= 7*86400 group by a_id""")
def near_in_time(t):
    dated = lambda kind, key, name, every: t.events.filter(F.col("event_type") == kind).select(
        F.col("event_id").alias(key), "user_id", nearest_second(F.when(F.col("event_id") % every != 0, F.col("ts"))).alias(name))
    return J.count_near_in_time(dated("signup", "a_id", "at", 50), dated("purchase", "b_id", "bt", 70), ["user_id"], "a_id", "at", "bt")


SHINGLE = "list_distinct(list_transform(range(1,len(w)-{k}+2), lambda i: array_to_string(w[i:i+{k}-1],' ')))"


@query("contamination", "J-15", f"""
with b as (select item_id, {S.tokens('text')} as w from benchmark), d as (select doc_id, {S.tokens('text')} as w from documents),
bg as (select item_id, {SHINGLE.format(k=8)} as s from b), g as (select item_id, len(s) as n, unnest(s) as g from bg),
dg as (select doc_id, unnest({SHINGLE.format(k=8)}) as g from d),
h as (select item_id, doc_id, count(*) as hits, any_value(n)::integer as n from g join dg using (g) group by all)
select item_id, doc_id, hits, n, round(hits/n,6) as share from h where hits/n >= 0.5""")
def contamination(t):
    docs = t.documents.select("doc_id", X.tokens("text").alias("w"))
    items = t.benchmark.select("item_id", X.tokens("text").alias("w"))
    return SJ.contamination(docs, items, "doc_id", "item_id", "w", "w", 8, 0.5).withColumn("share", F.round("share", 6))


@query("repeat_across_splits", "J-14", f"""
select doc_id, lang from documents where doc_id % 5 = 0 and {S.norm('text')} in (select {S.norm('text')} from documents where doc_id % 5 <> 0)""")
def repeat_across_splits(t):
    train, test = t.documents.filter(F.col("doc_id") % 5 != 0), t.documents.filter(F.col("doc_id") % 5 == 0)
    return J.repeated_across(train, test, X.norm("text")).select("doc_id", "lang")


@query("adjudicate", "J-17", """
with j as (select doc_id, quality as a, case when doc_id % 7 = 0 then 1 - quality else quality end as b,
  case when doc_id % 3 = 0 then toxic end as c, case when doc_id % 2 = 0 then quality end as h from labels)
select case when a=b then 'agreed' when c is not null then 'third_judge' when h is not null then 'human' else 'unresolved' end as origin,
  case when a=b then a else coalesce(c,h) end as label, count(*) as n from j group by 1, 2""")
def adjudicate(t):
    q, d = F.col("quality"), F.col("doc_id")
    judges = t.labels.select("doc_id", q.alias("a"), F.when(d % 7 == 0, 1 - q).otherwise(q).alias("b"),
                             F.when(d % 3 == 0, F.col("toxic")).alias("c"), F.when(d % 2 == 0, q).alias("h"))
    return J.adjudicate(judges, "a", "b", "c", "h").groupBy("origin", "label").agg(F.count(F.lit(1)).alias("n"))


# --- duplicates -----------------------------------------------------------------------------------------------------------

HEAD, BODY = "string_split(text, chr(10))[1]", "substr(text, length(string_split(text, chr(10))[1]) + 2)"
REPUBLISHED = f"""
with recursive d as (select doc_id, {HEAD} as title, {BODY} as snippet from documents),
f as (select doc_id, length(title) as score, case when snippet = '' then 1 when length(snippet) <= 300 then 2 else 3 end as content,
  length(snippet) > 60 as long, {S.title_key('title', STOP)} as k, {S.title_key('snippet', STOP)} as s, list_sort({S.numbers_in('title')}) as nums,
  len(list_filter({S.tokens('title')}, lambda w: list_contains({S.words(EUROPEAN.negations)}, w))) > 0 as neg from d),
o as materialized (select *, len(k) as nk, len(s) as ns, row_number() over (order by score desc, doc_id) as n from f),
kw as materialized (select n, unnest(k) as w from o), sw as materialized (select n, unnest(s) as w from o),
ks as (select x.n, y.n as m, count(*) as shared from kw x join kw y using (w) where y.n < x.n group by 1, 2),
ss as (select x.n, y.n as m, count(*) as shared from sw x join sw y using (w) where y.n < x.n group by 1, 2),
e as (select ks.n, m from ks join o x on x.n = ks.n join o y on y.n = m where x.neg = y.neg and x.nums = y.nums and shared / (x.nk + y.nk - shared) >= 0.7
  union select ss.n, m from ss join o x on x.n = ss.n join o y on y.n = m where x.long and shared / (x.ns + y.ns - shared) >= 0.8),
g as materialized (select n, list_sort(list(m)) as earlier, row_number() over (order by n) as i from e group by n),
r as (select 0::bigint as i, [0]::bigint[] as joined, 0::bigint as n, 0::bigint as leader
  union all select g.i, case when len(free) > 0 then list_append(r.joined, g.n) else r.joined end, g.n, coalesce(free[1], g.n)
  from r join g on g.i = r.i + 1, lateral (select list_filter(g.earlier, lambda m: not list_contains(r.joined, m)) as free)),
c as (select o.doc_id, coalesce(r.leader, o.n) as leader, o.content, o.score from o left join r on r.n = o.n)
select c.doc_id, o.doc_id as leader, first_value(c.doc_id) over (partition by c.leader order by c.content desc, c.score desc, c.doc_id) as lead
from c join o on o.n = c.leader"""


@query("republication_clusters", "D-02 W-02", REPUBLISHED)
def republication_clusters(t):
    """Documents as candidates: the head line is the title, all the text after it the snippet; longer titles are taken first."""
    title = F.substring_index("text", "\n", 1)
    parts = t.documents.select(F.col("doc_id").alias("id"), title.alias("title"), F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)").alias("snippet"))
    kind = F.when(F.col("snippet") == "", "titulo").when(F.length("snippet") <= 300, "trecho").otherwise("completo")
    found = D.republications(parts.select("*", F.length("title").alias("score"), kind.alias("content_kind")), EUROPEAN)
    return found.withColumnRenamed("id", "doc_id")


@query("claim_groups", "D-05", f"""
with recursive e as (select distinct conv_id as g, {S.norm('text')} as c from conversations where role='user'),
c as (select c, min(g) as lead from e group by c),
r(g, root) as (select g, g from e union select r.g, y.g from r join e x on x.g = r.root join e y on y.c = x.c)
select g as conv_id, min(root) as group_id from r group by g""")
def claim_groups(t):
    """Conversations that share a normalised claim belong to one group, through any chain of claims."""
    claims = t.conversations.filter(F.col("role") == "user").select("conv_id", X.norm("text").alias("claim"))
    return D.connected_groups(claims, "conv_id", "claim")


@query("conflicting_values", "D-04", """
with e as (select l_orderkey as claim_id, l_suppkey % 5 as cluster_id, l_partkey::varchar as url, l_extendedprice as value from lineitem),
u as (select claim_id, cluster_id, url, min(value) as v from e group by all),
s as (select claim_id, cluster_id, not (abs(max(v)-min(v)) <= 0.005*greatest(abs(max(v)),abs(min(v)),1e-9)) as conflict from u group by all)
select s.claim_id, count(distinct case when conflict then cluster_id || '|' || url else cluster_id::varchar end) as n_groups, count(*) as n from e join s using (claim_id, cluster_id) group by 1""")
def conflicting_values(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("claim_id"), (F.col("l_suppkey") % 5).alias("cluster_id"),
                             F.col("l_partkey").cast("string").alias("url"), F.col("l_extendedprice").alias("value"))
    return D.split_by_conflicting_value(rows).groupBy("claim_id").agg(
        F.countDistinct("evidence_group").alias("n_groups"), F.count(F.lit(1)).alias("n"))


# --- quality ------------------------------------------------------------------------------------------------------------

def _slips(long: str, short: str) -> str:
    """Whether dropping one of a doubled digit of ``long`` gives ``short``, for each place."""
    a, b = (f"regexp_replace({x},'[^0-9]','','g')" for x in (long, short))
    return f"list_transform(range(1, length({a})), lambda i: substr({a},i,1) = substr({a},i+1,1) and substr({a},1,i) || substr({a},i+2) = {b})"


SLIPS_A, SLIPS_B = _slips("number", "k"), _slips("k", "number")
WITH_UNIT = "list_transform(regexp_extract_all({c},'[0-9]+(?:[.,][0-9]+)*\\s+\\p{{L}}+'), lambda m: {key} || ' ' || lower(regexp_extract(m,'(\\p{{L}}+)$',1)))"
UNITS = {c: WITH_UNIT.format(c=c, key=S.number_key("m")) for c in ("head", "body")}
HEAD_NUMBERS = f"""with d as (select doc_id, string_split(text,chr(10))[1] as head, substr(text,length(string_split(text,chr(10))[1])+2) as body from documents),
h0 as (select doc_id, unnest({S.numbers_in('head')}) as number, {S.numbers_in('body')} as all_known, {UNITS['head']} as asked, {UNITS['body']} as said, length(body) as n_body from d),
h1 as (select *, string_split(list_filter(asked, lambda a: starts_with(a, number || ' '))[1], ' ')[2] as unit from h0 where not list_contains(all_known, number)),
h as (select *, list_filter(all_known, lambda k: unit is null or list_contains(said, k || ' ' || unit)) as known from h1),
m as (select doc_id, number, len(list_filter(known, lambda k: length(regexp_replace(number,'[^0-9]','','g')) >= 3 and levenshtein(regexp_replace(k,'[^0-9]','','g'), regexp_replace(number,'[^0-9]','','g')) = 1)) as n_near,
  len(list_filter(known, lambda k: list_contains(list_concat({SLIPS_A}, {SLIPS_B}), true))) > 0 as slip
  from h where n_body >= 80)"""


@query("number_audit", "Q-02 F-20", HEAD_NUMBERS + """
select doc_id, number, case when slip then 'near' when regexp_matches(number,'^(19|20)[0-9]{2}$') then 'year' when n_near > 0 then 'near' else 'missing' end as verdict, n_near::integer as n_near from m""")
def number_audit(t):
    head = F.substring_index("text", "\n", 1)
    body = F.substr(F.col("text"), F.length(head) + 2, F.length("text"))
    split = t.documents.select("doc_id", head.alias("head"), body.alias("body"))
    return Q.headline_number_audit(split, "doc_id", "head", "body")


@query("majority_vote", "Q-03", """
with r as (select l_orderkey as item, l_returnflag as reading, l_linenumber from lineitem),
o as (select item, arg_min(reading, row(l_linenumber, reading)) as original, count(*) as total from r group by item),
c as (select item, reading, count(*) as n from r group by all),
w as (select item, reading from c join o using (item) where n >= 2 and n * 2 > total)
select o.item, coalesce(w.reading, original) as kept, coalesce(w.reading, original) <> original as changed from o left join w using (item)""")
def majority_vote(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("item"), F.col("l_returnflag").alias("reading"), F.col("l_linenumber").alias("pass_no"))
    return Q.majority_vote(rows, "item", "reading", "pass_no")


@query("measure_eligibility", "Q-01", """
with x as (select *, doc_id % 11 = 0 as seen, doc_id % 13 = 0 as synthetic, toxic = 1 and doc_id < (select avg(doc_id) from labels) as old_positive from labels)
select quality, count(*) as n, count(*) filter (where not seen and not synthetic) as measured, count(*) filter (where toxic = 1 and not seen and not synthetic) as measured_positives,
  count(*) filter (where old_positive and not seen and not synthetic) as old_source_positives from x group by quality""")
def measure_eligibility(t):
    middle = t.labels.agg(F.avg("doc_id").alias("mid"))
    rows = t.labels.join(F.broadcast(middle)).select(
        "quality", (F.col("toxic") == 1).alias("y"), (F.col("doc_id") % 11 == 0).alias("seen"), (F.col("doc_id") % 13 == 0).alias("synthetic"),
        ((F.col("toxic") == 1) & (F.col("doc_id") < F.col("mid"))).alias("old_positive"))
    return Q.measure_eligibility(rows, "quality", "y", ["seen", "synthetic"], "old_positive")


@query("rejudge_score", "Q-05", """
with x as (select quality as old, case when doc_id % 9 = 0 then 1 - quality else quality end as new, toxic as human from labels)
select round(avg((old <> new)::int),6) as flipped, round(avg((old = new)::int),6) as agree, round(avg((new = human)::int),6) as human_agrees,
  avg((new = human)::int) >= 0.7 as passes from x""")
def rejudge_score(t):
    q = F.col("quality")
    rows = t.labels.select(q.alias("old"), F.when(F.col("doc_id") % 9 == 0, 1 - q).otherwise(q).alias("new"), F.col("toxic").alias("human"))
    return Q.rejudge_score(rows, "old", "new", "human")


@query("capture_scores", "Q-04", f"""
with d as (select doc_id, text, {S.tokens('text')} as toks, {S.tokens('string_split(text,chr(10))[1]')} as head from documents),
c as (select doc_id, len(list_filter(list_distinct(head), lambda w: not list_contains(toks, w)))::integer as missing,
  len(list_intersect(toks, ['license','licensed','token']))::integer as leaked, len(toks) >= 60 as kept from d)
select kept, count(*) as n, sum(missing)::bigint as missing, sum(leaked)::bigint as leaked, count(*) filter (where kept and missing = 0 and leaked = 0) as passed from c group by kept""")
def capture_scores(t):
    rows = t.documents.select(X.tokens("text").alias("observed"), X.tokens(F.substring_index("text", "\n", 1)).alias("required"))
    return Q.capture_scores(rows, "observed", "required", ["license", "licensed", "token"], F.size("observed") >= 60)


@query("claim_candidates", "J-07", f"""
with b as (select item_id, list_distinct(list_transform({S.title_key('text', STOP)}, lambda w: {S.stem('w')})) as k from benchmark),
bs as (select item_id, greatest(2, ceil(len(k) / 3)) as least, unnest(k) as stem from b),
ds as (select doc_id, unnest(list_distinct(list_transform({S.title_key('text', STOP)}, lambda w: {S.stem('w')}))) as stem from documents)
select item_id, doc_id from bs join ds using (stem) group by item_id, doc_id, least having count(*) >= least""")
def claim_candidates(t):
    """All documents that share at least a third of a claim's stems, and two."""
    stems = lambda c: F.array_distinct(F.transform(X.title_key(c, STOP), X.stem))
    claims = t.benchmark.select("item_id", stems("text").alias("keys")).withColumn("least", F.greatest(F.lit(2), F.ceil(F.size("keys") / 3)).cast("int"))
    asked = kept(claims.select(F.explode("keys").alias("stem")).distinct(), "asked")
    words = t.documents.select("doc_id", F.explode(F.array_distinct(X.tokens("text"))).alias("w")).filter(~F.col("w").isin(list(STOP)))
    return B.shared_at_least(claims, B.held_stems(words, "doc_id", asked).withColumnRenamed("stem", "key"), "item_id", "doc_id")


@query("latest_message", "W-21 X-02", f"""
select key, turn, conv_id from (select *, row_number() over (partition by key order by conv_id desc, turn desc) as rn from {MESSAGES}) where rn = 1""")
def latest_message(t):
    return best_per_key(messages(t), ["key"], F.struct("conv_id", "turn"), ["turn", "conv_id"])
