"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidence_spark.functions.text import _col
from evidence_spark.lexicons import DOMAIN_NOISE, SCIENCE_DOMAINS, SOCIAL_DOMAINS
from evidence_spark.functions.text import words_array

_HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host(url) -> Column:
    return F.lower(F.regexp_extract(_col(url), _HOST, 1))


def domain(url) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def plain_host(url) -> Column:
    """Host without ``www.`` and without the mobile and amp labels."""
    return F.regexp_replace(domain(url), r"(^|\.)(m|mobile|amp)\.", "$1")


def url_path(url) -> Column:
    return F.regexp_extract(_col(url), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def canonical_url(url, keep_case: str = "news.google.com") -> Column:
    """Host plus path without query and fragment; the path keeps its case on the redirecting aggregator only."""
    path = F.regexp_replace(url_path(url), "/+$", "")
    return F.concat(plain_host(url), F.when(plain_host(url).endswith(keep_case), path).otherwise(F.lower(path)))


def source_type(dom: Column, origin: Column) -> Column:
    ends = lambda names: dom.rlike("(" + "|".join(n.replace(".", r"\.") for n in names) + ")$")
    return (F.when(origin == "wikipedia", F.lit("enciclopedia"))
            .when(dom.rlike(r"\.(gov|gob|mil|leg|jus|mp|def)(\.[a-z]{2})?$"), F.lit("instituicao_publica"))
            .when(dom.rlike(r"\.edu(\.[a-z]{2})?$|\.ac\.[a-z]{2}$") | ends(SCIENCE_DOMAINS)
                  | dom.rlike(r"(^|\.)u[a-z]{1,8}\.br$"), F.lit("cientifica"))
            .when(ends(SOCIAL_DOMAINS), F.lit("rede_social"))
            .when(dom.endswith(".int"), F.lit("organismo_internacional"))
            .when(origin.isin("google_news", "bing_news"), F.lit("noticia"))
            .otherwise(F.lit("web")))


def domain_labels(dom: Column) -> Column:
    return F.filter(F.split(dom, r"\."),
                    lambda label: (label != "") & ~F.array_contains(words_array(DOMAIN_NOISE), label))
