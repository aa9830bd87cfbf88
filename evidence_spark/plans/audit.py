"""Corpus audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_spark.functions import dates, text as X
from evidence_spark.lexicons import EUROPEAN, OUTLET_WORDS
from evidence_spark.operators import profile as P
from evidence_spark.plans import sqltext as S
from evidence_spark.plans.registry import query

STOP = EUROPEAN.stop
LABELLED = "documents d join labels l using (doc_id)"


def labelled(t):
    return t.documents.join(t.labels, "doc_id")


def with_labels(t):
    return t.documents.join(t.labels, "doc_id", "left")


def profile_events(t):
    """Events with an age in days counted from a fixed date; error events count as undated."""
    age = F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("ts"))
    return t.events.withColumn("age_days", F.when(F.col("event_type") != "error", age))


EVENTS_SQL = ("(select *, case when event_type <> 'error' then date_diff('day', cast(ts as date), date '2024-01-31') end "
              "as age_days from events)")
BAND_SQL = ("case when age_days is null then 'sem data' when age_days <= 1 then 'mesmo dia ou véspera' "
            "when age_days <= 30 then '2 a 30 dias' else 'mais de um mês' end")


@query("documents_by_lang_source", "A-03", """
select lang, source, count(*) as n_docs, sum(n_chars)::bigint as chars from documents group by all""")
def documents_by_lang_source(t):
    return t.documents.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("chars"))


@query("rate_table", "A-01 U-03", f"""
select coalesce(source,'(all)') as source, count(*) as n_rows, count(distinct lang) as n_groups,
  round(avg(toxic)*100,1) as positive_per_100
from {LABELLED} group by grouping sets ((source),())""")
def rate_table(t):
    return P.rate_table(labelled(t), ["source"], "lang", F.col("toxic") == 1)


@query("null_profile", "P-01", """
with j as (select d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
           from documents d left join labels l using (doc_id))
unpivot (select count(*) filter (where doc_id is null) as doc_id, count(*) filter (where text is null) as text,
  count(*) filter (where lang is null) as lang, count(*) filter (where source is null) as source,
  count(*) filter (where n_chars is null) as n_chars, count(*) filter (where quality is null) as quality,
  count(*) filter (where toxic is null) as toxic from j)
on columns(*) into name column_name value nulls""")
def null_profile(t):
    return P.null_profile(with_labels(t))


@query("drop_null_rows", "P-02", """
select lang, count(*) as n from documents left join labels using (doc_id)
where quality is not null and toxic is not null group by lang""")
def drop_null_rows(t):
    return with_labels(t).na.drop(subset=["quality", "toxic"]).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("fill_null", "P-03", """
select coalesce(quality, -1)::integer as quality, coalesce(toxic, -1)::integer as toxic, count(*) as n
from documents left join labels using (doc_id) group by 1, 2""")
def fill_null(t):
    return P.fill_null(with_labels(t), {"quality": -1, "toxic": -1}).groupBy("quality", "toxic").agg(
        F.count(F.lit(1)).alias("n"))


@query("min_words_filter", "P-04", f"""
select doc_id, len({S.split_words('text')})::bigint as n_words from documents where len({S.split_words('text')}) >= 60""")
def min_words_filter(t):
    counted = t.documents.select("doc_id", X.word_count("text").alias("n_words"))
    return counted.filter(F.col("n_words") >= 60)


@query("signal_eligible", "P-05", f"""
select doc_id, length(text)::bigint as n_kept from (
  select doc_id, text, length(regexp_replace(text,'[^\\p{{L}}]','','g')) as letters,
    length(regexp_replace(text,'[^\\p{{Lu}}]','','g')) as uppers from documents)
where not regexp_matches(text,'^https?://[^\\s]+$') and len({S.split_words('text')}) >= 60
  and (letters = 0 or uppers::double/letters <= 0.7)""")
def signal_eligible(t):
    ok = (~F.col("text").rlike(r"^https?://\S+$")) & (X.word_count("text") >= 60) & (X.upper_share("text") <= 0.7)
    return t.documents.filter(ok).select("doc_id", F.length("text").cast("long").alias("n_kept"))


@query("binarise_label", "P-06", """
select (doc_id % 6 >= 3)::integer as y, count(*) as n, sum(toxic)::bigint as toxic from labels group by 1""")
def binarise_label(t):
    six = t.labels.withColumn("grade", F.col("doc_id") % 6)
    return six.groupBy((F.col("grade") >= 3).cast("int").alias("y")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic"))


@query("clean_text_for_bow", "P-09", f"""
select doc_id, array_to_string(list_filter(string_split_regex(trim(regexp_replace(regexp_replace(regexp_replace(
  lower(text),'http[^\\s]+|www[^\\s]+','','g'),'[^\\p{{L}}\\p{{N}}_\\s]','','g'),'[0-9]+','','g')),'\\s+'),
  lambda w: w <> '' and not list_contains({S.words(STOP)}, w)),' ') as clean from documents""")
def clean_text_for_bow(t):
    c = F.regexp_replace(F.lower("text"), r"http[^\s]+|www[^\s]+", "")
    c = F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", ""), "[0-9]+", "")
    kept = F.filter(F.split(F.trim(c), r"\s+"), lambda w: (w != "") & ~F.array_contains(X.words_array(STOP), w))
    return t.documents.select("doc_id", F.array_join(kept, " ").alias("clean"))


OUTLETS = "|".join(OUTLET_WORDS)
SHORTCUTS = [r"http[^\s]+|www\.[^\s]+", r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}", r"[0-9]{1,2}h[0-9]{0,2}", rf"\b({OUTLETS})\b"]


def _strip_sql(c):
    for p in SHORTCUTS:
        c = f"regexp_replace({c},{S.q(p)},' ','g')"
    return f"trim(regexp_replace({c},'\\s+',' ','g'))"


def strip_shortcuts(c):
    """Drop links, dates, hours and outlet names, then squeeze spaces."""
    for pattern in SHORTCUTS:
        c = F.regexp_replace(c, pattern, " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


@query("strip_shortcuts", "P-10", f"""
select source, count(*) as n, count(*) filter (where text <> {_strip_sql('text')}) as changed,
  sum(length({_strip_sql('text')}))::bigint as chars_left from documents group by source""")
def strip_shortcuts_query(t):
    cleaned = t.documents.withColumn("clean", strip_shortcuts(F.col("text")))
    return cleaned.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("text") != F.col("clean")).alias("changed"),
        F.sum(F.length("clean")).alias("chars_left"))


PATTERNS = {"link": "http|www", "date": "[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}", "year": r"\b(2019|2020|2021|2024)\b",
            "license": "License|Licensed", "outlet": rf"\b({OUTLETS})\b"}


@query("shortcut_word_audit", "P-11", " union all ".join(
    f"select {S.q(n)} as pattern, count(*) filter (where regexp_matches(text,{S.q(p)})) as n_texts from documents"
    for n, p in PATTERNS.items()))
def shortcut_word_audit(t):
    return P.text_pattern_audit(t.documents, "text", PATTERNS)


@query("age_band", "P-13", f"""
select {BAND_SQL} as band, event_type, count(*) as n from {EVENTS_SQL} group by 1, 2""")
def age_band(t):
    return profile_events(t).groupBy(dates.age_band("age_days").alias("band"), "event_type").agg(
        F.count(F.lit(1)).alias("n"))


@query("truth_case", "P-15", """
select doc_id, case when toxic=1 and quality=0 then 'hit_shown' when toxic=0 and quality=0 then 'shown_by_mistake'
  when toxic=1 then 'missed' else 'silent_correct' end as truth_case from labels""")
def truth_case(t):
    y, shown = F.col("toxic") == 1, F.col("quality") == 0
    case = (F.when(y & shown, "hit_shown").when(shown, "shown_by_mistake").when(y, "missed").otherwise("silent_correct"))
    return t.labels.select("doc_id", case.alias("truth_case"))


@query("parse_ddmmyyyy", "P-16", """
select year(try_strptime(regexp_extract(s,'([0-9]{2}/[0-9]{2}/[0-9]{4})',1),'%d/%m/%Y'))::integer as year,
  count(*) as n, count(*) filter (where try_strptime(regexp_extract(s,'([0-9]{2}/[0-9]{2}/[0-9]{4})',1),'%d/%m/%Y') is null) as bad
from (select case when o_orderkey % 7 = 0 then '99/99/2020' when o_orderkey % 5 = 0 then 'sem data'
      else 'em ' || strftime(o_orderdate,'%d/%m/%Y') || ' as 10h' end as s from orders) group by 1""")
def parse_ddmmyyyy(t):
    rendered = F.when(F.col("o_orderkey") % 7 == 0, F.lit("99/99/2020")).when(
        F.col("o_orderkey") % 5 == 0, F.lit("sem data")).otherwise(
        F.concat(F.lit("em "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" as 10h")))
    parsed = t.orders.select(dates.parse_ddmmyyyy(rendered).alias("day"))
    return parsed.groupBy(F.year("day").alias("year")).agg(F.count(F.lit(1)).alias("n"),
                                                          F.count_if(F.col("day").isNull()).alias("bad"))


@query("period_of", "P-19", f"""
select event_type, case when age_days is null then 'sem_data'
  when epoch(timestamp '2024-02-14 00:00:00') - epoch(ts) <= 30*86400 then 'recente' else 'anterior' end as period,
  count(*) as n from {EVENTS_SQL} group by 1, 2""")
def period_of(t):
    dated = profile_events(t).withColumn("published", F.when(F.col("age_days").isNotNull(), F.col("ts")))
    period = dates.period_of("published", F.lit("2024-02-14 00:00:00").cast("timestamp"))
    return dated.groupBy("event_type", period.alias("period")).agg(F.count(F.lit(1)).alias("n"))


@query("title_cut", "P-20", """
select doc_id, substr(string_split(text,chr(10))[1],1,110) as title110, length(string_split(text,chr(10))[1]) > 110 as title_cut
from documents""")
def title_cut(t):
    first = F.substring_index("text", "\n", 1)
    return t.documents.select("doc_id", F.substring(first, 1, 110).alias("title110"), (F.length(first) > 110).alias("title_cut"))


def repair_case(word):
    """Lower a word with a capital inside, except brands; short words and ``iPhone`` shapes stay."""
    inner = word.rlike(r"^\p{Ll}.*\p{Lu}")
    shape = word.rlike(r"^[ie]\p{Lu}[^\p{Lu}]*$")
    from evidence_spark.lexicons import BRANDS
    broken = (F.length(word) >= 4) & inner & ~F.lower(word).isin(BRANDS) & ~shape
    return F.when(broken, F.lower(word)).otherwise(word)


@query("repair_mid_word_case", "P-22", """
with w as (select doc_id, unnest(regexp_extract_all(text,'\\p{L}+')) as word from documents)
select count(*) as n_words, count(*) filter (where broken) as repaired, count(distinct doc_id) filter (where broken) as docs
from (select doc_id, length(word) >= 4 and regexp_matches(word,'^\\p{Ll}.*\\p{Lu}')
  and lower(word) not in ('iphone','ipad','ipod','ifood','imac','icloud','itunes','ebay','ios','esports')
  and not regexp_matches(word,'^[ie]\\p{Lu}[^\\p{Lu}]*$') as broken from w)""")
def repair_mid_word_case(t):
    words = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(1))).alias("word"))
    broken = words.select("doc_id", (repair_case(F.col("word")) != F.col("word")).alias("broken"))
    return broken.agg(F.count(F.lit(1)).alias("n_words"), F.count_if("broken").alias("repaired"),
                      F.countDistinct(F.when(F.col("broken"), F.col("doc_id"))).alias("docs"))


@query("class_share", "A-02", """
select quality, count(*) as n, round(count(*)/sum(count(*)) over (),4) as share from labels group by quality""")
def class_share(t):
    return P.class_share(t.labels, "quality")


@query("crosstab", "A-03", """
select source, count(*) as total, count(*) filter (where lang='de') as de, count(*) filter (where lang='en') as en,
  count(*) filter (where lang='es') as es, count(*) filter (where lang='fr') as fr
from documents group by source order by total desc, source limit 15""")
def crosstab(t):
    return P.crosstab(t.documents, "source", "lang", ["de", "en", "es", "fr"], top=15)


@query("describe_words", "A-04 W-16", f"""
with w as (select lang, len({S.split_words('text')})::bigint as n_words from documents)
select lang, count(*) as n, round(avg(n_words),4) as mean, round(stddev_samp(n_words),4) as std,
  min(n_words)::double as min, max(n_words)::double as max, quantile_cont(n_words,0.25) as p25,
  quantile_cont(n_words,0.5) as p50, quantile_cont(n_words,0.75) as p75 from w group by lang""")
def describe_words(t):
    return P.describe_by(t.documents.select("lang", X.word_count("text").alias("n_words")), "lang", "n_words")


@query("rate_by_two_bands", "A-05", f"""
select {BAND_SQL} as band, {', '.join(f"round(avg(value) filter (where event_type='{e}'),4) as mean_{e}, count(*) filter (where event_type='{e}') as n_{e}" for e in ('click', 'view', 'purchase'))}
from {EVENTS_SQL} group by 1""")
def rate_by_two_bands(t):
    banded = profile_events(t).withColumn("band", dates.age_band("age_days"))
    return P.rate_by_two_bands(banded, "band", "event_type", ["click", "view", "purchase"], F.col("value"))


@query("conditional_rates", "A-06", """
select event_type, round(avg((value > 50)::int::double)*100,1) as high,
  round(avg(case when value > 10 then (value > 50)::int::double end)*100,1) as high_of_medium,
  round(avg(case when user_id % 2 = 0 then (value > 10)::int::double end)*100,1) as medium_of_even
from events group by event_type""")
def conditional_rates(t):
    v, even = F.col("value"), F.col("user_id") % 2 == 0
    return P.conditional_rates(t.events, "event_type", {
        "high": (v > 50, F.lit(True)), "high_of_medium": (v > 50, v > 10), "medium_of_even": (v > 10, even)})


@query("coverage_profile", "A-08", """
unpivot (select lang, round(avg((quality is not null)::int)*100,1) as quality, round(avg((toxic is not null)::int)*100,1) as toxic,
  round(avg((source is not null)::int)*100,1) as source from documents left join labels using (doc_id) group by lang)
on quality, toxic, source into name column_name value present_per_100""")
def coverage_profile(t):
    return P.coverage_profile(with_labels(t), "lang", ["quality", "toxic", "source"])


CORR = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@query("feature_target_corr", "A-09", " union all ".join(
    f"select '{c}' as feature, round(corr({c}, l_extendedprice),6) as corr, abs(corr({c}, l_extendedprice)) > 0.95 as leak_suspect from lineitem"
    for c in CORR))
def feature_target_corr(t):
    return P.feature_target_corr(t.lineitem, "l_extendedprice", CORR)


@query("target_leak_suspects", "A-10", " union all ".join(
    f"select '{c}' as feature, count(*) as n_values, round(sum(hits)/sum(n),6) as purity, round(sum(hits)/sum(n),6) >= 0.99 as leak_suspect "
    f"from (select v, max(n) as hits, sum(n) as n from (select {c}::varchar as v, toxic, count(*) as n from {LABELLED} group by 1,2) group by v)"
    for c in ("source", "lang", "quality", "doc_id")))
def target_leak_suspects(t):
    return P.target_leak_suspects(labelled(t), "toxic", ["source", "lang", "quality", "doc_id"])


@query("year_class_table", "A-28", """
select year(o_orderdate)::integer as year, count(*) as n, count(*) filter (where o_orderstatus='F') as F,
  count(*) filter (where o_orderstatus='O') as O, count(*) filter (where o_orderstatus='P') as P from orders group by 1""")
def year_class_table(t):
    dated = t.orders.withColumn("year", F.year("o_orderdate"))
    return dated.groupBy("year").agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(F.col("o_orderstatus") == s).alias(s) for s in ("F", "O", "P")])


@query("wide_classes_to_long", "U-01", """
select label, count(*) as n, sum(length(text))::bigint as chars from (
  select 'url' as label, url as text from pages union all select 'html', html from pages) group by label""")
def wide_classes_to_long(t):
    long = t.pages.unpivot(["page_id"], ["url", "html"], "label", "text")
    return long.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("union_sources", "U-02", """
select origin, count(*) as n from (select 'documents' as origin, text from documents union all
  select 'benchmark', text from benchmark union all select 'conversations', text from conversations) group by origin""")
def union_sources(t):
    parts = [getattr(t, n).select(F.lit(n).alias("origin"), "text") for n in ("documents", "benchmark", "conversations")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


@query("distinct_rows", "U-04 D-01", """
select count(*) as n_rows, count(distinct text) as n_distinct, count(*) - count(distinct text) as n_removed,
  (select count(*) from (select text from documents group by text having count(*) > 1)) as n_repeated_texts from documents""")
def distinct_rows(t):
    # Copies meet on a 64-bit hash first; the text itself settles collisions.
    copies = t.documents.groupBy(F.xxhash64("text").alias("h"), "text").agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"),
                      (F.sum("n") - F.count(F.lit(1))).alias("n_removed"),
                      F.count_if(F.col("n") > 1).alias("n_repeated_texts"))


@query("exact_duplicates", "D-01", """
select min(doc_id) as keep_id, count(*) as n_copies, count(distinct source) as n_sources from documents
group by text having count(*) > 1""")
def exact_duplicates(t):
    copies = t.documents.groupBy(F.xxhash64("text"), "text").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n_copies"), F.countDistinct("source").alias("n_sources"))
    return copies.filter(F.col("n_copies") > 1).select("keep_id", "n_copies", "n_sources")


@query("set_columns", "U-06", f"""
with s as (select doc_id, {S.title_key("string_split(text,chr(10))[1]", STOP)} as head, {S.title_key("text", STOP)} as body from documents)
select doc_id, len(list_intersect(head, body))::bigint as shared, len(body)::bigint as n_body,
  len(list_filter(body, lambda x: not list_contains(head, x)))::bigint as only_body,
  len(list_intersect(head, body)) = len(head) as head_inside from s""")
def set_columns(t):
    sets = t.documents.select("doc_id", X.title_key(F.substring_index("text", "\n", 1), STOP).alias("head"),
                              X.title_key("text", STOP).alias("body"))
    return sets.select(
        "doc_id", F.size(F.array_intersect("head", "body")).cast("long").alias("shared"),
        F.size("body").cast("long").alias("n_body"), F.size(F.array_except("body", "head")).cast("long").alias("only_body"),
        (F.size(F.array_except("head", "body")) == 0).alias("head_inside"))
