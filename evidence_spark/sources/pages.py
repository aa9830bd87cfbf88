"""Web pages to article and paragraph tables. Page text is data: text that addresses automated systems is dropped and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_spark.functions import dates, urls
from evidence_spark.functions.text import _col

# --- fixed values ---------------------------------------------------------------------------------------------------
SKIP_TAGS = ("script style noscript nav footer header aside form svg button iframe template figure figcaption").split()
BLOCK_TAGS = ("p div article section main body html ul ol li table tr td h1 h2 h3 h4 h5 h6 blockquote pre hr").split()
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&copy;", "©"), ("&middot;", "·"), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"), ("&amp;", "&")]
INJECTION = (r"(?iu)(ignore|ignora|desconsidere|disregard|forget)[^\p{L}\p{N}_]+(?:[\p{L}\p{N}_]+[^\p{L}\p{N}_]+){0,5}"
             r"(instru|instruct|prompt|regras|rules)|system\s+prompt|you\s+are\s+(?:an?\s+)?(?:ai|assistant|language model|chatgpt)"
             r"|voc[eê]\s+(?:é|e)\s+(?:um|uma)\s+(?:ia|assistente|modelo)|as\s+an\s+ai|</?\s*(?:system|assistant|user)\s*>"
             r"|responda\s+(?:apenas|somente)\s+(?:com|que)")
CITATION = r"\[(?:nota\s+|note\s+|carece[^\]]*|[\p{L}\p{N}_]\s*)?[0-9]*\]"

SKIPPED = "(?is)<!--.*?-->|" + "|".join(rf"<{t}(?:\s[^>]*)?>.*?</{t}\s*>" for t in SKIP_TAGS)
BLOCK_END = r"(?is)</?(?:" + "|".join(BLOCK_TAGS) + r")(?:\s[^>]*)?>.*$"
P_OPEN = r"(?i)<p(?:\s[^>]*)?>"


def decode(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def plain_text(fragment: Column) -> Column:
    """Visible text of an HTML fragment with single spaces."""
    flat = F.regexp_replace(F.regexp_replace(fragment, r"(?i)<br\s*/?>", " "), "<[^>]*>", "")
    return F.trim(F.regexp_replace(decode(flat), r"\s+", " "))


def paragraph_text(fragment: Column) -> Column:
    """Paragraph text without citation markers and without space before punctuation."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(plain_text(fragment), CITATION, ""), r"\s+", " "))
    return F.regexp_replace(bare, r"\s+([.,;:!?])", "$1")


def raw_paragraphs(html: Column) -> Column:
    """Contents of ``<p>`` outside skipped blocks; a new ``<p>`` or a block tag closes the open one."""
    pieces = F.split(F.regexp_replace(html, SKIPPED, " "), P_OPEN)
    inside = F.slice(pieces, 2, 1_000_000_000)
    return F.transform(inside, lambda p: paragraph_text(F.regexp_replace(p, BLOCK_END, "")))


def meta(html: Column, key: str) -> Column:
    """Content of a meta tag by property, name or itemprop; either attribute order; null when absent or blank."""
    attr = rf"(?:property|name|itemprop)\s*=\s*[\"']{key}[\"']"
    first = F.regexp_extract(html, rf"(?is)<meta\s[^>]*{attr}[^>]*?content\s*=\s*[\"']([^\"']*)[\"']", 1)
    second = F.regexp_extract(html, rf"(?is)<meta\s[^>]*content\s*=\s*[\"']([^\"']*)[\"'][^>]*{attr}", 1)
    blank_to_null = lambda c: F.when(F.trim(c) != "", F.trim(decode(c)))
    return F.coalesce(blank_to_null(first), blank_to_null(second))


def json_ld(html: Column, field: str) -> Column:
    """A text field of the embedded linked data at any depth, or the ``name`` of its (first) object value."""
    blobs = F.array_join(F.regexp_extract_all(
        html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1)), "\n")
    value = F.regexp_extract(blobs, rf'(?s)"{field}"\s*:\s*(?:\[\s*)?(?:"([^"]+)"|\{{[^{{}}]*?"name"\s*:\s*"([^"]+)")', 1)
    name = F.regexp_extract(blobs, rf'(?s)"{field}"\s*:\s*(?:\[\s*)?(?:"([^"]+)"|\{{[^{{}}]*?"name"\s*:\s*"([^"]+)")', 2)
    return F.coalesce(F.when(value != "", value), F.when(name != "", name))


def pages_to_articles(pages: DataFrame, min_chars: int = 40) -> DataFrame:
    """page_id, url -> title, site, description, published, author, paragraphs, injection_dropped."""
    html = F.col("html")
    title = F.coalesce(meta(html, "og:title"), plain_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    times = F.regexp_extract(html, r"(?is)<time\s[^>]*datetime\s*=\s*[\"']([^\"']*)[\"']", 1)
    published = F.coalesce(meta(html, "article:published_time"), meta(html, "og:published_time"), meta(html, "datepublished"),
                           json_ld(html, "datePublished"), F.when(F.trim(times) != "", times))
    base = pages.select(
        "page_id", "url", F.trim(F.regexp_replace(title, r"\s+", " ")).alias("title"), meta(html, "og:site_name").alias("site"),
        F.coalesce(meta(html, "og:description"), meta(html, "description")).alias("description"),
        dates.parse_timestamp(published).alias("published"),
        F.coalesce(meta(html, "author"), json_ld(html, "author")).alias("author"), raw_paragraphs(html).alias("_raw"))
    long = base.withColumn("_long", F.filter("_raw", lambda p: F.length(p) >= min_chars)).drop("_raw")
    kept = long.withColumn("paragraphs", F.filter("_long", lambda p: ~p.rlike(INJECTION)))
    return kept.withColumn("injection_dropped", F.size("_long") - F.size("paragraphs")).drop("_long").withColumn(
        "domain", urls.domain("url"))


def paragraph_rows(articles: DataFrame) -> DataFrame:
    return articles.select("page_id", F.posexplode("paragraphs").alias("pos", "paragraph"))


def article_body_text(articles: DataFrame, min_paragraph_words: int = 8, min_words: int = 60) -> DataFrame:
    """Bodies from paragraphs of enough words; short bodies are dropped."""
    words = lambda p: F.size(F.split(p, " "))
    body = F.array_join(F.filter("paragraphs", lambda p: words(p) >= min_paragraph_words), "\n")
    sized = articles.select("page_id", "domain", body.alias("body")).withColumn("n_words", F.size(F.split("body", r"\s+")))
    return sized.filter((F.col("body") != "") & (F.col("n_words") >= min_words))


def source_texts(candidates: DataFrame) -> DataFrame:
    """Texts a candidate offers, strongest first: page if read, else summary or snippet, and always the title."""
    body = (F.when((F.col("content_kind") == "completo") & (F.col("page_text") != ""), F.struct(
        F.lit("completo").alias("kind"), F.col("page_text").alias("text")))
        .when(F.col("snippet") != "", F.struct(F.when(F.col("origin") == "wikipedia", "resumo").otherwise("trecho").alias("kind"),
                                               F.col("snippet").alias("text"))))
    title = F.struct(F.lit("titulo").alias("kind"), F.col("title").alias("text"))
    keys = [c for c in ("claim_id", "url", "cluster_id", "origin", "title") if c in candidates.columns]
    return candidates.select(*keys, F.inline(F.filter(F.array(body, title), lambda s: s.isNotNull())))


def is_injection(c) -> Column:
    return _col(c).rlike(INJECTION)
