"""Page, address and outlet queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_spark.functions import dates, urls
from evidence_spark.functions import text as X
from evidence_spark.lexicons import EUROPEAN, FACT_CHECKERS, SCIENCE_DOMAINS, SOCIAL_DOMAINS
from evidence_spark.operators import dedupe as D
from evidence_spark.operators import joins as J
from evidence_spark.operators.ranking import exact_quantiles, top_per_key
from evidence_spark.plans import sqltext as S
from evidence_spark.plans.registry import query
from evidence_spark.sources import feeds, pages as G

# --- the page parser said in SQL ------------------------------------------------------------------------------------


def _decode(c):
    for entity, char in G.ENTITIES:
        c = f"replace({c},{S.q(entity)},{S.q(char)})"
    return c


def _plain(c):
    flat = f"regexp_replace(regexp_replace({c},'(?i)<br\\s*/?>',' ','g'),'<[^>]*>','','g')"
    return f"trim(regexp_replace({_decode(flat)},'\\s+',' ','g'))"


def _para(c):
    bare = f"trim(regexp_replace(regexp_replace({_plain(c)},{S.q(G.CITATION)},'','g'),'\\s+',' ','g'))"
    return f"regexp_replace({bare},'\\s+([.,;:!?])','\\1','g')"


RAW = f"string_split_regex(regexp_replace(html,{S.q(G.SKIPPED)},' ','g'),{S.q(G.P_OPEN)})[2:]"
PARAS = "list_transform(" + RAW + ", lambda p: " + _para(f"regexp_replace(p,{S.q(G.BLOCK_END)},'')") + ")"
ARTICLES = f"""(select page_id, url, {S.domain('url')} as domain, {_plain("regexp_extract(html,'(?is)<title[^>]*>(.*?)</title>',1)")} as title,
  list_filter(long, lambda p: not regexp_matches(p,{S.q(G.INJECTION)})) as paragraphs,
  len(list_filter(long, lambda p: regexp_matches(p,{S.q(G.INJECTION)}))) as dropped
  from (select page_id, url, html, list_filter({PARAS}, lambda p: length(p) >= 40) as long from pages))"""


def articles(t):
    return G.pages_to_articles(t.pages)


@query("page_articles", "S-07", f"""
select page_id, title, len(paragraphs)::bigint as n_paragraphs, dropped::bigint as injection_dropped,
  coalesce(list_sum(list_transform(paragraphs, lambda p: length(p))),0)::bigint as n_chars from {ARTICLES}""")
def page_articles(t):
    total = F.aggregate("paragraphs", F.lit(0).cast("long"), lambda s, p: s + F.length(p))
    return articles(t).select("page_id", "title", F.size("paragraphs").cast("long").alias("n_paragraphs"),
                              F.col("injection_dropped").cast("long").alias("injection_dropped"), total.alias("n_chars"))


@query("page_paragraphs", "S-07", f"""
select page_id, (p[2]-1)::integer as pos, p[1] as paragraph from (
  select page_id, unnest(list_transform(paragraphs, lambda x, i: row(x, i))) as p from {ARTICLES})""")
def page_paragraphs(t):
    return G.paragraph_rows(articles(t))


BODIES = f"""(select page_id, domain, body, len(string_split_regex(body,'\\s+')) as n_words from (select page_id, domain,
  array_to_string(list_filter(paragraphs, lambda p: len(string_split(p,' ')) >= 8),chr(10)) as body from {ARTICLES})
  where body <> '' and len(string_split_regex(body,'\\s+')) >= 60)"""


@query("article_bodies", "S-08", f"""
select domain, count(*) as n_articles, sum(n_words)::bigint as n_words, quantile_cont(n_words,0.5) as median_words from {BODIES} group by domain""")
def article_bodies(t):
    bodies = G.article_body_text(articles(t))
    counts = bodies.groupBy("domain").agg(F.count(F.lit(1)).alias("n_articles"), F.sum("n_words").alias("n_words"))
    median = exact_quantiles(bodies, ["domain"], "n_words", [0.5]).select("domain", F.col("quantile").alias("median_words"))
    return counts.join(median, "domain")


@query("page_domains", "P-07", f"""
select page_id, {S.domain('url')} as domain, {S.plain_host('url')} as plain_host from pages""")
def page_domains(t):
    return t.pages.select("page_id", urls.domain("url").alias("domain"), urls.plain_host("url").alias("plain_host"))


@query("canonical_pages", "P-08", f"""
select {S.canonical_url('url')} as canonical, count(*) as n_pages, min(page_id) as first_page from pages group by 1""")
def canonical_pages(t):
    return t.pages.groupBy(urls.canonical_url("url").alias("canonical")).agg(
        F.count(F.lit(1)).alias("n_pages"), F.min("page_id").alias("first_page"))


@query("dedupe_keep_best", "W-01 W-21", f"""
select canonical, page_id, score from (select {S.plain_host('url')} as canonical, page_id, length(html) as score,
  row_number() over (partition by {S.plain_host('url')} order by length(html) desc, page_id) as rn from pages) where rn = 1""")
def dedupe_keep_best(t):
    scored = t.pages.select(urls.plain_host("url").alias("canonical"), "page_id", F.length("html").cast("long").alias("score"))
    return D.dedupe_keep_best(scored, ["canonical"], "score", "page_id", ["page_id", "score"])


ORIGINS = ["google_news", "bing_news", "bing_web", "wikipedia"]


def _ends(names):
    return "(" + "|".join(n.replace(".", "\\.") for n in names) + ")$"


@query("source_type", "P-18", f"""
with p as (select {S.domain('url')} as d, (['google_news','bing_news','bing_web','wikipedia'])[(page_id % 4)+1] as origin from pages)
select case when origin='wikipedia' then 'enciclopedia' when regexp_matches(d,'\\.(gov|gob|mil|leg|jus|mp|def)(\\.[a-z]{{2}})?$') then 'instituicao_publica'
  when regexp_matches(d,'\\.edu(\\.[a-z]{{2}})?$|\\.ac\\.[a-z]{{2}}$') or regexp_matches(d,{S.q(_ends(SCIENCE_DOMAINS))}) or regexp_matches(d,'(^|\\.)u[a-z]{{1,8}}\\.br$') then 'cientifica'
  when regexp_matches(d,{S.q(_ends(SOCIAL_DOMAINS))}) then 'rede_social' when ends_with(d,'.int') then 'organismo_internacional'
  when origin in ('google_news','bing_news') then 'noticia' else 'web' end as source_type, origin, count(*) as n from p group by 1, 2""")
def source_type(t):
    origin = F.element_at(X.words_array(ORIGINS), (F.col("page_id") % 4 + 1).cast("int"))
    staged = t.pages.select(urls.domain("url").alias("d"), origin.alias("origin"))
    return staged.groupBy(urls.source_type(F.col("d"), F.col("origin")).alias("source_type"), "origin").agg(
        F.count(F.lit(1)).alias("n"))


@query("injection_paragraphs", "P-21", f"""
select role, count(*) as n, count(*) filter (where regexp_matches(text,{S.q(G.INJECTION)})) as n_dropped from conversations group by role""")
def injection_paragraphs(t):
    return t.conversations.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(G.is_injection("text")).alias("n_dropped"))


AGENCIES = [("com/en", "English desk"), ("example.org", "Open desk"), ("example.com", "Main desk"), ("/fr/", "French desk"), *FACT_CHECKERS]


def contains_lookup(df, url, patterns, keys):
    """First pattern of a fixed ordered list contained in the address, as (agency, rank); rows without one are dropped."""
    lowered = F.lower(url)
    hits = F.array(*[F.when(F.contains(lowered, F.lit(p)), F.struct(F.lit(i).alias("rank"), F.lit(name).alias("agency")))
                     for i, (p, name) in enumerate(patterns)])
    found = df.select(*keys, F.get(F.filter(hits, lambda h: h.isNotNull()), F.lit(0)).alias("hit"))
    return found.filter(F.col("hit").isNotNull()).select(*keys, "hit.rank", "hit.agency")


@query("fact_check_sources", "J-12 E-10", f"""
with p(rank, pattern, agency) as (values {','.join(f"({i},{S.q(p)},{S.q(a)})" for i, (p, a) in enumerate(AGENCIES))}),
h as (select page_id, agency, row_number() over (partition by page_id order by rank) as rn from pages, p where contains(lower(url), pattern))
select agency, min(page_id) as page_id, count(*) as n_pages from h where rn = 1 group by agency""")
def fact_check_sources(t):
    found = contains_lookup(t.pages, F.col("url"), AGENCIES, ["page_id"])
    return found.groupBy("agency").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n_pages"))


@query("same_outlet_join", "J-11", f"""
with p as (select page_id, {S.plain_host('url')} as d from pages),
l as (select page_id, unnest(list_filter(string_split(d,'.'), lambda x: x <> '' and x not in ('com','br','org','net','gov','leg','jus','www'))) as label from p),
b as (select distinct page_id, replace(label,'-','') as label from l),
c as (select label, count(*) as n from b group by label)
select label, n as n_pages, (n*(n-1)/2)::bigint as n_pairs from c where n > 1""")
def same_outlet_join(t):
    """Outlets shared by several pages. The outlet key is the group, so pairs are counted, never listed."""
    labels = t.pages.select("page_id", F.explode(urls.domain_labels(urls.plain_host("url"))).alias("label"))
    keyed = labels.select("page_id", F.replace("label", F.lit("-"), F.lit("")).alias("label")).distinct()
    counts = keyed.groupBy("label").agg(F.count(F.lit(1)).alias("n_pages")).filter(F.col("n_pages") > 1)
    return counts.withColumn("n_pairs", (F.col("n_pages") * (F.col("n_pages") - 1) / 2).cast("long"))


def _title_sql(c):
    return _plain(f"regexp_extract({c},'(?is)<title[^>]*>(.*?)</title>',1)")


STOP = EUROPEAN.stop
ART = f"""(select page_id, url, {S.canonical_url('url')} as canon, {S.domain('url')} as d, {_title_sql('html')} as title,
  timestamp '2024-01-01' + to_days((page_id % 30)::integer) as published from pages)"""


@query("page_independence", "D-03", f"""
with a as (select *, row_number() over () as x from {ART}),
t as (select *, {S.title_key('title', STOP)} as k, {S.numbers_in('title')} as nums, split_part(d,'.',1) as outlet0, replace({S.norm("split_part(d,'.',1)")},' ','') as ok from a),
p as (select l.page_id as a_id, r.page_id as c_id, l.canon = r.canon as address, l.ok as lo, r.ok as ro, r.d as rd,
  abs(epoch(l.published) - epoch(r.published)) <= 7*86400 as close, l.k as lk, r.k as rk, l.nums as ln, r.nums as rn, {S.norm('l.title')} = {S.norm('r.title')} as eq
  from t l join t r on l.page_id < r.page_id and {S.norm('l.title')} = {S.norm('r.title')}),
f as (select *, list_sort(ln) = list_sort(rn) and (case when len(lk) < 4 or len(rk) < 4 then eq else {S.jaccard('lk', 'rk')} >= 0.85 end) and close as same_title,
  length(lo) >= 2 and ((length(ro) >= 2 and (lo = ro or (length(lo) >= 3 and starts_with(ro, lo)) or (length(ro) >= 3 and starts_with(lo, ro)))) or
  list_contains(string_split(rd,'.'), lo)) as outlet from p)
select a_id, c_id, case when address then 'propria' when outlet and same_title then 'propria' when outlet then 'mesmo_veiculo'
  when same_title then 'republicacao' else 'independente' end as kind,
  case when address then 'same_address' when outlet and same_title then 'same_outlet_and_title' when outlet then 'same_outlet'
  when same_title then 'same_title' else 'none' end as reason from f""")
def page_independence(t):
    """Pages that share a normalised title, judged for independence from the first one."""
    titled = t.pages.select(
        "page_id", "url", urls.domain("url").alias("domain"),
        G.plain_text(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("page_id") % 30).cast("int"))).alias("published"))
    titled = titled.withColumn("outlet", F.substring_index("domain", ".", 1))
    judged = D.independence_by_title(titled, "page_id", EUROPEAN)
    return judged.select("a_id", "c_id", F.col("independence").alias("kind"), "reason")


@query("outlet_counts", "A-23", f"""
select d as domain, count(*) as publications, count(distinct page_id % 5) as n_relations,
  count(*) filter (where page_id % 5 = 0) as same, arg_min(page_id, row(published, page_id)) as first_page, arg_max(page_id, row(published, page_id)) as latest_page
from {ART} group by d""")
def outlet_counts(t):
    dated = t.pages.select("page_id", urls.domain("url").alias("domain"), (F.col("page_id") % 5).alias("relation"), (
        F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("page_id") % 30).cast("int"))).alias("published"))
    order = F.struct("published", "page_id")
    return dated.groupBy("domain").agg(
        F.count(F.lit(1)).alias("publications"), F.countDistinct("relation").alias("n_relations"),
        F.count_if(F.col("relation") == 0).alias("same"), F.min_by("page_id", order).alias("first_page"),
        F.max_by("page_id", order).alias("latest_page"))


@query("pages_to_read", "W-05", f"""
with b as (select {S.domain('url')} as cluster, page_id, length(html) as similarity, page_id % 3 as category from pages where page_id % 4 <> 3),
c as (select *, row_number() over (partition by category, cluster order by similarity desc, page_id) as rc from b),
a as (select *, row_number() over (partition by category order by similarity desc, page_id) as position from c where rc <= 2)
select category, position::integer as position, page_id, cluster from a where position <= 8""")
def pages_to_read(t):
    """At most two pages per cluster and eight per question, allowed origins only."""
    rows = t.pages.filter(F.col("page_id") % 4 != 3).select(
        urls.domain("url").alias("cluster"), "page_id", F.length("html").alias("similarity"), (F.col("page_id") % 3).alias("category"))
    order = [F.desc("similarity"), F.asc("page_id")]
    per_cluster = top_per_key(rows, ["category", "cluster"], order, 2, "rc").drop("rc")
    return top_per_key(per_cluster, ["category"], order, 8).select("category", "position", "page_id", "cluster")


TITLED = f"""x as (select *, {S.title_key('title', STOP)} as k, list_sort({S.numbers_in('title')}) as nums, {S.norm('title')} as n from {ART}),
y as (select x.*, not contains(url, '?') as direct, length(regexp_replace(html,'<[^>]*>','','g')) as chars from x join (select page_id, html from pages) using (page_id))"""


@query("own_article_join", "J-18", f"""
with {TITLED},
art as (select page_id as article_id, * from y where page_id % 5 = 0), cand as (select * from y where page_id % 5 <> 0 and chars >= 500),
p as (select article_id, cand.page_id as c_id, art.canon = cand.canon as address, art.d = cand.d as near, cand.direct, art.nums = cand.nums and len(art.k) > 0 and len(cand.k) > 0 as likely,
  {S.jaccard('art.k', 'cand.k')} as j, art.n = cand.n as eq, len(art.k) < 4 or len(cand.k) < 4 as short from art, cand),
h as (select article_id, c_id, 1 as how, 0 as pref, 0.0 as j from p where address
  union all select article_id, c_id, 2, case when direct and near then 0 when direct then 1 else 2 end, 0.0 from p where likely and case when short then eq else j >= 0.85 end
  union all select article_id, c_id, 3, 0, j from p where likely and near and j >= 0.6),
r as (select *, row_number() over (partition by article_id order by how, pref, j desc, c_id) as rn from h)
select article_id, c_id, how from r where rn = 1""")
def own_article_join(t):
    """The article's own page among the pages with enough text: same address, else the same title, else a like title of its domain."""
    base = t.pages.select(
        "page_id", urls.canonical_url("url").alias("canon"), urls.domain("url").alias("domain"), (~F.contains("url", F.lit("?"))).alias("direct"),
        F.length(F.regexp_replace("html", "<[^>]*>", "")).alias("chars"), G.plain_text(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"))
    found = J.own_article(base.filter(F.col("page_id") % 5 == 0).withColumnRenamed("page_id", "article_id"),
                          base.filter((F.col("page_id") % 5 != 0) & (F.col("chars") >= 500)).withColumnRenamed("page_id", "c_id"), EUROPEAN)
    return found.select("article_id", "c_id", "how")


def _feed(t):
    """Feed documents rendered from the pages: one feed per language folder of the address."""
    item = F.concat(F.lit("<item><title>"), F.regexp_extract("html", "(?is)<title[^>]*>([^<]*)</title>", 1), F.lit(" - Outlet "),
                    (F.col("page_id") % 7).cast("string"), F.lit("</title><link>"), F.replace("url", F.lit("&"), F.lit("&amp;")),
                    F.lit("</link><pubDate>Mon, 05 Feb 2024 10:"), F.lpad((F.col("page_id") % 60).cast("string"), 2, "0"),
                    F.lit(":00 -0300</pubDate><source url=\"https://www.outlet"), (F.col("page_id") % 7).cast("string"),
                    F.lit(".example.com\">Outlet "), (F.col("page_id") % 7).cast("string"), F.lit("</source></item>"))
    return t.pages.select("page_id", F.col("page_id").cast("string").alias("query"), F.concat(
        F.when(F.col("page_id") % 50 == 7, F.lit("<!DOCTYPE x>")).otherwise(F.lit("")), F.lit("<rss><channel>"), item,
        F.lit("</channel></rss>")).alias("xml"))


@query("feed_candidates", "S-04 S-05 F-11", f"""
select page_id::varchar as query, {_plain("regexp_extract(html,'(?is)<title[^>]*>([^<]*)</title>',1)")} as title, url, 'Outlet ' || (page_id % 7) as outlet,
  'outlet' || (page_id % 7) || '.example.com' as domain, strftime(timestamp '2024-02-05 13:00:00' + to_minutes(page_id % 60),'%Y-%m-%d %H:%M:%S') as published
from pages where page_id % 50 <> 7 and {_plain("regexp_extract(html,'(?is)<title[^>]*>([^<]*)</title>',1)")} <> ''""")
def feed_candidates(t):
    items, _ = feeds.read_feed_items(_feed(t))
    found = feeds.feed_to_candidates(items, "google_news")
    return found.select("query", "title", "url", "outlet", "domain", F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"))


@query("feed_quarantine", "S-04", "select page_id::varchar as query, 'doctype_or_entity' as reason from pages where page_id % 50 = 7")
def feed_quarantine(t):
    _, refused = feeds.read_feed_items(_feed(t))
    return refused.select("query", "reason")


@query("encyclopedia_candidates", "S-06", f"""
select page_id::varchar as query, title, url, trim(regexp_replace(title || '  ' || title,'\\s+',' ','g')) as snippet, page_id % 9 = 0 as disambiguation
from (select page_id, url, {_title_sql('html')} as title from pages) where title <> ''""")
def encyclopedia_candidates(t):
    title = G.plain_text(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    entry = F.struct(F.lit(1).alias("index"), title.alias("title"), F.col("url").alias("fullurl"),
                     F.concat(title, F.lit("  "), title).alias("extract"),
                     F.when(F.col("page_id") % 9 == 0, F.create_map(F.lit("disambiguation"), F.lit(""))).alias("pageprops"))
    doc = F.to_json(F.struct(F.struct(F.create_map(F.col("page_id").cast("string"), entry).alias("pages")).alias("query")))
    answers = t.pages.select(F.col("page_id").cast("string").alias("query"), doc.alias("json"))
    return feeds.encyclopedia_to_candidates(answers).select("query", "title", "url", "snippet", "disambiguation")


@query("source_texts", "E-01", f"""
with a as (select page_id, title, array_to_string(paragraphs,' ') as body from {ARTICLES})
select kind, count(*) as n, sum(length(text))::bigint as n_chars from (
  select 'completo' as kind, body as text from a where length(body) >= 500 union all
  select 'trecho', substr(body,1,200) from a where length(body) < 500 and body <> '' union all select 'titulo', title from a) group by kind""")
def source_texts(t):
    body = F.array_join("paragraphs", " ")
    full = F.length(body) >= 500
    candidates = articles(t).select(
        F.col("page_id").alias("claim_id"), "url", "title", F.lit("bing_web").alias("origin"),
        F.when(full, "completo").otherwise("trecho").alias("content_kind"), F.when(full, body).otherwise("").alias("page_text"),
        F.substring(body, 1, 200).alias("snippet"))
    return G.source_texts(candidates).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("page_dates", "F-11 F-12", """
select page_id, strftime(timestamp '2024-02-05 13:00:00' + to_minutes(page_id % 60),'%Y-%m-%d %H:%M:%S') as rfc, '2024-02-05 08:30:00' as iso from pages""")
def page_dates(t):
    rfc = F.concat(F.lit("Mon, 05 Feb 2024 10:"), F.lpad((F.col("page_id") % 60).cast("string"), 2, "0"), F.lit(":00 -0300"))
    return t.pages.select("page_id", F.date_format(dates.parse_timestamp(rfc), "yyyy-MM-dd HH:mm:ss").alias("rfc"),
                          F.date_format(dates.parse_timestamp(F.lit("2024-02-05T10:30:00+02:00")), "yyyy-MM-dd HH:mm:ss").alias("iso"))
