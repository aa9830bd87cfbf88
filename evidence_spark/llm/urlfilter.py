"""URL filter: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` with the literal tokens that any match must contain. One pass counts
how many URLs hold each rule token (a map-side combined count over all rows); each rule is then filed under its rarest
one. The second pass looks the tokens of each URL up in that index and runs only the regular expressions it finds.
Neither pass moves URLs between executors; the index has one entry per rule, so it goes out with the task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import evidence_spark.llm.common  # noqa: F401  (sends this folder with the tasks)

TOKEN = r"[A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``name`` is reported if ``listed``; of all rules that match the one with the highest ``weight`` decides, then the smaller name."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    weight: int
    listed: bool = False


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """``host`` and its subdomains, paths that start with ``path``; longer rules win, and any of them before a pattern."""
    regex = rf"^(?:[^/]*\.)?{re.escape(host)}(?={re.escape(path)})"
    tokens = tuple(re.findall(TOKEN, host.lower()))
    # A path segment closed by "/" is a whole token of the URL.
    tokens += tuple(re.findall(TOKEN, path[:path.rfind("/")]))
    return Rule(host + path, verdict, regex, tokens, 1_000_000 + len(host + path), True)


def pattern_rule(name: str, regex: str, *tokens: str) -> Rule:
    return Rule(name, "block", regex, tokens, 1)


SITE_RULES = [site_rule("allow", "com", "/"), site_rule("block", "example.com", "/en/"), site_rule("allow", "www.example.com", "/en/"),
              site_rule("block", "net", "/es/"), site_rule("block", "net", "/fr/")]
# Pages without prose, and hosts that only serve adverts or counters.
PATTERN_RULES = [
    pattern_rule("login", r"/(?:user/)?login(?:/|$)", "login"), pattern_rule("signup", r"/signup(?:/|$)", "signup"),
    pattern_rule("cart", r"/cart(?:/|$)", "cart"), pattern_rule("checkout", r"/checkout(?:/|$)", "checkout"),
    pattern_rule("tag-list", r"/tag/[^/]+/page/[0-9]+", "tag", "page"), pattern_rule("wp-admin", r"/wp-admin(?:/|$)", "wp", "admin"),
    pattern_rule("ads-host", r"^(?:ads|adserver)[.]", "ads"), pattern_rule("adserver-host", r"^adserver[.]", "adserver"),
    pattern_rule("tracker-host", r"^(?:[^/]*[.])?tracker[.]", "tracker"), pattern_rule("casino", r"(?:^|[./-])casino(?:[./-]|$)", "casino"),
    pattern_rule("xxx", r"(?:^|[./-])xxx(?:[./-]|$)", "xxx"), pattern_rule("feed-xml", r"/feed[.]xml$", "feed", "xml"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty when it is null or has no ``://``."""
    text = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(text, "://") > 0, F.regexp_extract(text, r"(?s)://(.*)$", 1)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def token_frequencies(urls: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """URLs that hold each token named by a rule; at most one entry per rule token comes back."""
    wanted = sorted({t for r in rules for t in r.tokens})
    tokens = F.explode(F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", "host", "path"), F.lit(f"({TOKEN})"), F.lit(1))))
    counts = urls.select(tokens.alias("token")).filter(F.col("token").isin(wanted)).groupBy("token").count()
    return {r["token"]: r["count"] for r in counts.collect()}


def rarest_token_index(rules: list[Rule], frequency: dict[str, int]) -> tuple[dict[str, list[Rule]], list[Rule]]:
    """Rules by their rarest token; those without a literal token are tried on every URL."""
    index: dict[str, list[Rule]] = {}
    rest = []
    for rule in rules:
        if rule.tokens:
            index.setdefault(min(rule.tokens, key=lambda t: (frequency.get(t, 0), t)), []).append(rule)
        else:
            rest.append(rule)
    return index, rest


def judge(pages: DataFrame, rules: list[Rule] | None = None, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row. A null or odd URL has no host and gets ``default``."""
    rules = SITE_RULES + PATTERN_RULES if rules is None else rules
    host, path = host_and_path(F.col("url").cast("string"))
    urls = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
    index, rest = rarest_token_index(rules, token_frequencies(urls, rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(TOKEN).findall
        compiled = {r.name: re.compile(r.regex).search for r in rules}
        for batch in batches:
            names, verdicts = [], []
            for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = h + p
                found = [r for t in set(find(f"{h} {p}")) if t in index for r in index[t]] + rest
                hits = [r for r in found if compiled[r.name](text)]
                best = min(hits, key=lambda r: (-r.weight, r.name)) if hits else None
                names.append(best.name if best and best.listed else None)
                verdicts.append(best.verdict if best else default)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(names, pa.string()), pa.array(verdicts, pa.string())],
                                             names=["page_id", "host", "path", "rule", "verdict"])

    return urls.mapInArrow(run, "page_id bigint, host string, path string, rule string, verdict string")
