"""URL filters: pattern rules indexed by their rarest literal token.

Site rules (a host and the start of a path) and patterns (a regular expression) are both filed under a literal token that
every URL they fit must hold whole. Token frequencies over the table choose each rule's rarest one; the tokens of a URL
fetch the rules filed under them, and only those are tried. A rule that has no such token is tried on every URL.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile("[a-z0-9]+")
#: Fixed rules (host, path): verdict. The longest that fits a URL decides.
SITE_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


@dataclass(frozen=True)
class Pattern:
    """A regular expression over the lower-cased URL, and the whole tokens that every match has in it."""

    regex: str
    tokens: tuple[str, ...]


#: Pattern rules of the query: spam shops, adult pages, betting, trackers and advertising.
PATTERNS = (
    Pattern(r"://([a-z0-9-]+\.)*cheap-pills\.", ("cheap", "pills")),
    Pattern(r"://([a-z0-9-]+\.)*adult-x\.", ("adult", "x")),
    Pattern(r"://([a-z0-9-]+\.)*free-bets\.", ("free", "bets")),
    Pattern(r"://([a-z0-9-]+\.)*ads-track\.", ("ads", "track")),
    Pattern(r"://([a-z0-9-]+\.)*casino\.", ("casino",)),
    Pattern(r"[?&]utm_source=ads(&|#|$)", ("utm", "source", "ads")),
    Pattern(r"/popup/[^?#]*\.(gif|js)", ("popup",)),
    Pattern(r"/banner/[^?#]*\.(gif|js)", ("banner",)),
    Pattern(r"://[^/?#]*/[^?#]*/wp-login\.php", ("wp", "login")),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty where the URL is null or has no ://."""
    rest = F.when(url.contains("://"), F.expr("substring(u, instr(u, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_tokens(rule: str) -> tuple[str, ...]:
    """The whole tokens of every URL that a site rule fits: those of its host, and of the path segments that it closes."""
    host, _, path = rule.partition("/")
    return tuple(dict.fromkeys(TOKEN.findall(host.lower()) + TOKEN.findall(path.rpartition("/")[0].lower()))) if host.isascii() and path.isascii() else ()


def fits(rule: str, host: str, path: str) -> bool:
    """Whether the host is that of the rule or under it, and the path starts with the rule's."""
    at, _, start = rule.partition("/")
    return (host == at or host.endswith("." + at)) and path.startswith("/" + start)


def token_counts(urls: DataFrame, tokens: Iterable[tuple[str, ...]]) -> dict[str, int]:
    """How many URLs have each token that a rule names: as many rows as the rules have tokens."""
    named = sorted({t for some in tokens for t in some})
    if not named:
        return {}
    found = urls.select(F.explode(F.array_distinct(F.expr("regexp_extract_all(lower(u), '[a-z0-9]+', 0)"))).alias("t"))
    return {r.t: r["count"] for r in found.where(F.col("t").isin(named)).groupBy("t").count().collect()}


def token_index(tokens: Iterable[tuple[str, ...]], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rule numbers by rarest token, and those without a token, which every URL tries."""
    by: dict[str, list[int]] = defaultdict(list)
    rest = []
    for k, some in enumerate(tokens):
        if some:
            by[min(some, key=lambda t: (counts.get(t, 0), t))].append(k)
        else:
            rest.append(k)
    return dict(by), rest


def judge_urls(pages: DataFrame, site_rules: dict[str, str] | None = None, patterns: tuple[Pattern, ...] = PATTERNS, url: str = "url", key: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict, n_candidates, pattern for each row of pages.

    rule is the longest fixed rule that fits (its host or a subdomain, and the path's start), else null; verdict is its
    verdict, else block where a pattern matches (pattern: the number of the first), else allow. n_candidates counts the
    patterns whose regular expression ran. A null URL, or one without ://, has an empty host and path, and no pattern
    matches a null. Very long URLs are judged whole. Repeated rows stay; other columns are ignored, whatever their names;
    an empty table gives an empty result. The rules are arguments, thousands of them at will, and so have a known size.
    """
    rules = SITE_RULES if site_rules is None else site_rules
    urls = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("u"))
    # the longest rule first; of equal length, at most one fits the same host and path
    sites = sorted(rules, key=lambda r: (-len(r), r))
    of_sites, of_patterns = [rule_tokens(r) for r in sites], [p.tokens for p in patterns]
    counts = token_counts(urls, of_sites + of_patterns)
    by_site, every_site = token_index(of_sites, counts)
    by, rest = token_index(of_patterns, counts)
    sources = [p.regex for p in patterns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, re.Pattern] = {}

        def found(k: int, low: str) -> bool:
            if k not in made:
                made[k] = re.compile(sources[k])
            return made[k].search(low) is not None

        for b in batches:
            ran, hit, rule = [], [], []
            for host, path, u in zip(*(b.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                low = (u or "").lower()
                tokens = set(TOKEN.findall(low))
                tried = sorted({k for t in tokens for k in by.get(t, ())} | set(rest)) if u is not None else []
                ran.append(len(tried))
                hit.append(next((k for k in tried if found(k, low)), None))
                near = sorted({k for t in tokens for k in by_site.get(t, ())} | set(every_site))
                rule.append(next((sites[k] for k in near if fits(sites[k], host, path)), None))
            yield pa.record_batch([*b.columns[:3], pa.array(rule, pa.string()), pa.array([rules.get(r) for r in rule], pa.string()), pa.array(ran, pa.int32()), pa.array(hit, pa.int32())], names=["page_id", "host", "path", "rule", "said", "n_candidates", "pattern"])

    host, path = url_parts(F.col("u"))
    placed = urls.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), "u")
    judged = placed.mapInArrow(run, "page_id long, host string, path string, rule string, said string, n_candidates int, pattern int")
    verdict = F.coalesce("said", F.when(F.col("pattern").isNotNull(), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "n_candidates", "pattern")
