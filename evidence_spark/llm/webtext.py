"""Main text of web pages: structure first, then repeated runs of a host's pages.

Structure: scripts, styles, forms, menus, headers, footers, sidebars, adverts, notices and comments go, by element, role
or name. Names (class, id) count for block elements only: outside articles any part of a hyphenated name, inside one
only whole names, so that "share-of-market" stays. A ``<header>`` inside an article is the article's own heading and stays.
Of several articles the one with most text is the page's text, whole, however often it recurs; ``<main>`` is it if it holds more
text outside its articles, or no article. Only pages without either are left to the host's repetition.

Host suffix array: what pages of one host have outside their articles is cut into tokens and concatenated, one separator
per page; suffixes are sorted by their first ``RUN`` tokens (prefix doubling). Runs of equal suffixes that come from at
least ``PAGES`` different pages are boilerplate; every token they cover is removed from undecided blocks, unique runs stay.

At scale: pages are counted per run over the whole host, as sums by host and run that are combined before the shuffle, so
that no host meets in one task; ``covered`` says the same of pages at hand. A page that its structure decides never moves
itself, only its tokens outside the article do, and those only if its host has undecided pages. Equal streams count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_spark.llm.common import WordHashes, shingle_hashes, word_hashes
from evidence_spark.llm.urlfilter import host_and_path

RUN = 8
PAGES = 3
SALTS = 8
# Elements and names by what they hold.
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "svg", "math", "object", "title")
CUT = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "head"}
CUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
CUT_NAMES = set("""ad ads adbox advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies
copyright disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promotion related
reply replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget""".split())
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp",
          "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
# Whole names that mark what is no part of an article's text, inside it.
CUT_INSIDE = CUT_NAMES - {"header", "alert", "notice", "respond", "modal", "menu", "widget", "consent", "login", "signup", "copyright"} | set("""
ad-slot ad-container ad-banner advert-slot banner-ad social-share share-buttons share-bar sharing-buttons related-posts related-articles related-links
comment-list comments-area comment-form comment-respond post-comments cookie-notice cookie-banner cookie-consent newsletter-signup newsletter-form
subscribe-form site-footer site-header article-footer post-navigation breadcrumb-nav sponsored-content promo-box""".split())
OUTSIDE, OPEN, MAIN, ARTICLE = 0, 1, 2, 3


def _zone(tag: str, attributes: str, zone: int) -> int:
    """Zone inside an element, from the zone around it."""
    if tag in ("html", "body"):
        return zone
    if zone == OUTSIDE or tag in CUT and not (tag == "header" and zone == ARTICLE):
        return OUTSIDE
    role, whole = "", set()
    if "=" in attributes:
        for kind, *values in _NAMES.findall(attributes):
            value = "".join(values).lower()
            if kind.lower() == "role":
                role = value
            else:
                whole.update(value.split())
    if role in CUT_ROLES:
        return OUTSIDE
    if whole and tag not in INLINE:
        parts = {p for name in whole for p in re.split(r"[^a-z0-9]+", name)}
        if tag in ("article", "main"):
            if parts & {"comment", "comments", "ad", "ads"}:
                return OUTSIDE
        elif whole & CUT_INSIDE if zone == ARTICLE else parts & CUT_NAMES:
            return OUTSIDE
    if tag == "article":
        return ARTICLE
    if tag == "main" or role == "main":
        return max(zone, MAIN)
    return zone


def blocks(html: str) -> list[tuple[int, str, int]]:
    """(zone, text, number of the outermost article, or 0) of each block in page order: references decoded, white space made one
    space, ends trimmed, empty ones left out."""
    out: list[tuple[int, str, int]] = []
    article = 0
    stack: list[tuple[str, int]] = []
    held: list[str] = []
    open_tags: dict[str, int] = {}
    zone, at, size = OPEN, 0, len(html)

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                out.append((zone, text, article if zone == ARTICLE else 0))
            held.clear()

    def pop_to(tag: str) -> None:
        nonlocal zone
        while stack:
            name, before = stack.pop()
            open_tags[name] -= 1
            if before != zone:
                flush()
                zone = before
            if name == tag:
                return

    while at < size:
        begin = html.find("<", at)
        if begin < 0:
            held.append(html[at:])
            break
        if begin > at:
            held.append(html[at:begin])
        if html.startswith("<!--", begin):
            end = html.find("-->", begin + 4)
            at = size if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), begin):
            end = html.find(">", begin)
            at = size if end < 0 else end + 1
            continue
        m = _TAG.match(html, begin) or _LOOSE.match(html, begin)
        if not m:
            held.append("<")
            at = begin + 1
            continue
        at, tag = m.end(), m[2].lower()
        if tag not in INLINE:
            flush()
        if m[1]:
            if open_tags.get(tag):
                pop_to(tag)
            continue
        if tag in _RAW_END:
            end = _RAW_END[tag].search(html, at)
            at = end.end() if end else size
            continue
        if tag in VOID:
            continue
        if tag not in INLINE and open_tags.get("p") and tag not in ("html", "body"):
            pop_to("p")
        for other in CLOSES.get(tag, ()):
            if stack and stack[-1][0] == other:
                pop_to(other)
        inner = _zone(tag, m[3], zone)
        if inner != zone:
            flush()
            if inner == ARTICLE:
                article += 1
        stack.append((tag, zone))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        zone = inner
    flush()
    return out


def decided_text(parts: list[tuple[int, str, int]]) -> str | None:
    """Text of the article with most of it, or of the main element where that says more beside its articles; None if the page has neither."""
    articles: dict[int, list[str]] = {}
    for zone, text, article in parts:
        if zone == ARTICLE:
            articles.setdefault(article, []).append(text)
    best = max((" ".join(texts) for texts in articles.values()), key=len, default=None)  # of equals the first
    main = " ".join(text for zone, text, _ in parts if zone == MAIN)
    return best if best is not None and len(best) >= len(main) else main or best


def covered(streams: list[list[str]], run: int = RUN, pages: int = PAGES) -> list[np.ndarray]:
    """For each token stream, which tokens lie in a run of ``run`` tokens found in at least ``pages`` different streams."""
    sizes = [len(s) for s in streams]
    flat = [t for s in streams for t in s]
    marks = [np.zeros(n, bool) for n in sizes]
    if len(flat) < run:
        return marks
    distinct: dict[tuple, int] = {}
    text_of = np.array([distinct.setdefault(tuple(s), len(distinct)) for s in streams])  # equal streams count once
    owner = np.repeat(np.arange(len(streams)), sizes)
    _, rank = np.unique(np.array(flat, dtype=object).astype(str), return_inverse=True)
    rank = rank.astype(np.int64) + 1
    left = np.concatenate([np.arange(n, 0, -1) for n in sizes if n])  # tokens to the end of the own stream
    done = 1
    while done < run:  # ranks of the first 2^k tokens; a suffix that ends before counts as 0 from there on
        step = min(done, run - done)
        tail = np.zeros_like(rank)
        tail[:-step] = np.where(left[:-step] > step, rank[step:], 0)
        _, rank = np.unique(rank * (rank.max() + len(rank) + 2) + tail, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        done += step
    order = np.argsort(rank, kind="stable")
    order = order[left[order] >= run]
    if not len(order):
        return marks
    groups = rank[order]
    pairs = np.unique(np.stack([groups, text_of[owner[order]]]), axis=1)
    values, counts = np.unique(pairs[0], return_counts=True)
    starts = order[np.isin(groups, values[counts >= pages])]
    hit = np.zeros(len(flat) + 1, np.int64)
    np.add.at(hit, starts, 1)
    np.add.at(hit, starts + run, -1)
    mark = np.cumsum(hit)[:-1] > 0
    cuts = np.cumsum([0, *sizes])
    return [mark[cuts[i]:cuts[i + 1]] for i in range(len(streams))]


def _run_hashes(stream: str, cache: WordHashes) -> np.ndarray:
    """One hash per run of ``RUN`` tokens, in order."""
    tokens = stream.encode().split(b" ") if stream else []
    return shingle_hashes(word_hashes(tokens, cache), RUN) if len(tokens) >= RUN else np.zeros(0, np.uint64)


def _distinct_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, print, undecided, run) of each distinct run of a stream."""
    cache = WordHashes()
    for batch in batches:
        runs = [np.unique(_run_hashes(s, cache)).view(np.int64) for s in batch.column(3).to_pylist()]
        of = pa.array(np.repeat(np.arange(len(runs)), [len(x) for x in runs]))
        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(of) for i in range(3)), pa.array(np.concatenate([np.zeros(0, np.int64), *runs]))],
                                         names=["host", "print", "undecided", "run"])


def _without_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stream without the tokens that the listed runs cover."""
    cache = WordHashes()
    for batch in batches:
        texts = []
        for stream, listed in zip(batch.column(2).to_pylist(), batch.column(3)):
            starts = np.flatnonzero(np.isin(_run_hashes(stream, cache), listed.values.to_numpy().view(np.uint64))) if listed.is_valid else []
            tokens = stream.split(" ") if stream else []
            hit = np.zeros(len(tokens) + 1, np.int64)
            np.add.at(hit, starts, 1)
            np.add.at(hit, np.asarray(starts, np.int64) + RUN, -1)
            texts.append(" ".join(t for t, m in zip(tokens, np.cumsum(hit)) if not m))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row. A null, empty or textless html gives the empty text.

    Rows that repeat an id or an html are rows of their own; other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decided_text(blocks(h or "")) for h in batch.column(2).to_pylist()]
            kept = pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=["page_id", "url", "text"])
            yield kept.filter(pa.array([t is not None for t in texts], pa.bool_()))

    def loose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, undecided = [], []
            for h in batch.column(2).to_pylist():
                own = blocks(h or "")
                undecided.append(decided_text(own) is None)
                # An undecided page is judged by its open blocks; what a decided one has around its text is evidence.
                parts.append([t for z, t, _ in own if z == OPEN] if undecided[-1] else [t for z, t, _ in own if z <= OPEN])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(parts, pa.list_(pa.string())), pa.array(undecided, pa.bool_())],
                                             names=["page_id", "url", "parts", "undecided"])

    host = F.coalesce(host_and_path(F.col("url"))[0], F.lit(""))
    stream = F.array_join("parts", " ")
    streams = (rows.mapInArrow(loose, "page_id bigint, url string, parts array<string>, undecided boolean")
               .select("page_id", "url", "undecided", host.alias("host"), stream.alias("stream")).withColumn("print", F.md5("stream")))
    asked = streams.filter("undecided")
    hosts = asked.select("host").distinct()
    distinct = streams.join(hosts, "host", "left_semi").groupBy("host", "print").agg(F.max("undecided").alias("undecided"), F.first("stream").alias("stream"))
    runs = distinct.select("host", "print", "undecided", "stream").mapInArrow(_distinct_runs, "host string, print string, undecided boolean, run bigint")
    common = runs.groupBy("host", "run").agg(F.count("*").alias("n"), F.max("undecided").alias("asked")).filter((F.col("n") >= PAGES) & F.col("asked"))
    common = common.select("host", "run", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = runs.filter("undecided").withColumn("salt", F.pmod(F.xxhash64("print"), F.lit(SALTS)).cast("int"))
    listed = salted.join(common, ["host", "run", "salt"]).groupBy("host", "print").agg(F.collect_list("run").alias("runs"))
    rest = asked.join(listed, ["host", "print"], "left").select("page_id", "url", "stream", "runs").mapInArrow(_without_runs, "page_id bigint, url string, text string")
    out = rows.mapInArrow(decided, "page_id bigint, url string, text string").unionByName(rest)
    return out.withColumn("n_chars", F.char_length("text").cast("bigint"))
