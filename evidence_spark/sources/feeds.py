"""Landed search payloads to candidate rows: feed documents and encyclopedia answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidence_spark.functions import dates, urls
from evidence_spark.sources.pages import decode, plain_text

FORBIDDEN = r"<!(ENTITY|DOCTYPE)"
ITEM = r"(?s)<item(?:\s[^>]*)?>(.*?)</item>"


def _field(item: Column, tag: str) -> Column:
    body = F.regexp_extract(item, rf"(?is)<(?:[a-z]+:)?{tag}(?:\s[^>]*)?>(.*?)</(?:[a-z]+:)?{tag}>", 1)
    bare = F.regexp_replace(F.regexp_replace(body, r"^\s*<!\[CDATA\[", ""), r"\]\]>\s*$", "")
    return F.trim(F.when(body.contains("<![CDATA["), bare).otherwise(decode(bare)))


def read_feed_items(feeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, quarantine) from rows (query, xml). Documents with entity or doctype declarations, or that are not a
    feed, are refused: they go to quarantine with a reason instead of looking like an empty answer."""
    reason = (F.when(F.col("xml").rlike(FORBIDDEN), F.lit("doctype_or_entity"))
              .when(~F.col("xml").rlike("(?i)<(rss|channel)[ >]"), F.lit("not_a_feed"))
              .when(F.regexp_count("xml", F.lit("<item[ >]")) != F.regexp_count("xml", F.lit("</item>")), F.lit("broken_xml")))
    marked = feeds.withColumn("reason", reason)
    items = marked.filter(F.col("reason").isNull()).select(
        "query", F.posexplode(F.regexp_extract_all("xml", F.lit(ITEM), F.lit(1))).alias("pos", "item"))
    item = F.col("item")
    rows = items.select(
        "query", "pos", *[_field(item, tag).alias(name) for tag, name in (
            ("title", "title"), ("link", "link"), ("description", "description"), ("pubDate", "pub_date"), ("source", "source"))],
        decode(F.regexp_extract(item, r"(?is)<source\s[^>]*url\s*=\s*[\"']([^\"']*)", 1)).alias("source_url"))
    return rows, marked.filter(F.col("reason").isNotNull()).select("query", "reason", "xml")


def unwrap_redirect(link: Column) -> Column:
    """Target of a search redirect (``url=`` parameter); other links stay."""
    target = F.try_url_decode(F.parse_url(link, F.lit("QUERY"), F.lit("url")))
    return F.when(urls.host(link).endswith("bing.com"), F.coalesce(target, F.lit(""))).otherwise(link)


def feed_to_candidates(items: DataFrame, provider: str, limit: int | None = None) -> DataFrame:
    """Candidate rows of one provider: google_news, bing_news or bing_web; the first ``limit`` items of a feed, or all."""
    title, source = plain_text(F.col("title")), F.col("source")
    if provider == "google_news":
        suffix = F.concat(F.lit(" - "), source)
        without = F.trim(F.substr(title, F.lit(1), F.length(title) - F.length(suffix)))
        title = F.when((source != "") & F.endswith(title, suffix), without).otherwise(title)
        link, snippet = F.col("link"), F.lit("")
        domain = urls.domain("source_url")
        outlet = F.when(source != "", source).otherwise(F.lit("(veículo não informado)"))
    else:
        link, snippet = unwrap_redirect(F.col("link")), plain_text(F.col("description"))
        domain = urls.domain(link)
        outlet = F.when(source != "", source).otherwise(domain)
    # The date of the web search feed is the crawl date, not the publication date.
    published = dates.parse_timestamp("pub_date") if provider != "bing_web" else F.lit(None).cast("timestamp")
    rows = (items.filter(F.col("pos") < limit) if limit else items).select(
        "query", "pos", title.alias("title"), link.alias("url"), outlet.alias("outlet"), F.lit(provider).alias("origin"),
        published.alias("published"), snippet.alias("snippet"),
        F.when(snippet != "", F.lit("trecho")).otherwise(F.lit("titulo")).alias("content_kind"), domain.alias("domain"))
    return rows.filter((F.col("title") != "") & F.col("url").rlike("^https?://[^/]+"))


ENCYCLOPEDIA = T.StructType([T.StructField("query", T.StructType([T.StructField("pages", T.MapType(T.StringType(), T.StructType([
    T.StructField("index", T.IntegerType()), T.StructField("title", T.StringType()), T.StructField("fullurl", T.StringType()),
    T.StructField("extract", T.StringType()),
    T.StructField("pageprops", T.MapType(T.StringType(), T.StringType()))])))]))])


def encyclopedia_to_candidates(answers: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Candidate rows from JSON answers (query, json), in index order; extracts are whole unless ``max_chars`` is given."""
    pages = answers.select("query", F.explode(F.from_json("json", ENCYCLOPEDIA)["query"]["pages"]).alias("id", "p"))
    extract = F.trim(F.regexp_replace(F.coalesce("p.extract", F.lit("")), r"\s+", " "))
    return pages.filter((F.col("p.title") != "") & F.col("p.fullurl").rlike("^https?://")).select(
        "query", F.coalesce("p.index", F.lit(99)).alias("pos"), F.col("p.title").alias("title"), F.col("p.fullurl").alias("url"),
        F.lit("Wikipédia").alias("outlet"), F.lit("wikipedia").alias("origin"), F.lit(None).cast("timestamp").alias("published"),
        (F.substring(extract, 1, max_chars) if max_chars else extract).alias("snippet"), F.lit("resumo").alias("content_kind"),
        F.lit("pt.wikipedia.org").alias("domain"),
        F.coalesce(F.map_contains_key("p.pageprops", "disambiguation"), F.lit(False)).alias("disambiguation"))
