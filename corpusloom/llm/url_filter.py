"""URL filters: host rules by longest match and pattern rules indexed by their rarest literal token.
DataFrame functions only.

A pattern rule in the filter-list style names literal characters, `*` (anything), `^` (a separator or the end) and a
leading `||` (start of a host label). Its literal tokens must all be tokens of a URL it matches, so the rule is filed
under the one that is rarest over all URLs, and only URLs with that token run its regular expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, BROADCAST_ROWS, lower_ascii, materialize, table

#: Rules (host and path, verdict) of the query.
HOST_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Pattern rules of the query.
PATTERN_RULES = (
    ("||spam-farm.", "block"),
    ("||cheap-pills.", "block"),
    ("||casino^", "block"),
    ("||free-*-now.", "block"),
    ("/adserver/", "block"),
    ("/viagra^", "block"),
    ("?sessionid=", "block"),
    ("&affiliate=*&click=", "block"),
    ("/adserver/policy.html", "allow"),
)
_TOKEN = "[^a-z0-9]+"
#: So many host rules are one expression; more are joined.
EXPRESSION_RULES = 64


@dataclass(frozen=True)
class PatternRule:
    pattern: str
    verdict: str

    @property
    def regex(self) -> str:
        body = self.pattern[2:] if self.pattern.startswith("||") else self.pattern
        parts = {"*": ".*", "^": "(?:[^a-z0-9_.%-]|$)"}
        made = "".join(parts.get(c) or re.escape(c) for c in body)
        return (r"^[a-z0-9+.-]+://(?:[^/?#]*\.)?" if body is not self.pattern else "") + made

    @property
    def tokens(self) -> list[str]:
        """Literal runs that are whole tokens of any URL matched: a separator or a literal edge stands on both sides. A rule
        without any is compared with every URL."""
        whole = self.pattern.startswith("||")
        body = self.pattern[2:] if whole else self.pattern
        found = []
        for m in re.finditer("[a-z0-9]+", body):
            left = whole if m.start() == 0 else body[m.start() - 1] != "*"
            right = m.end() < len(body) and body[m.end()] != "*"
            if left and right:
                found.append(m[0])
        return found


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_rule(host: Column, path: Column, rules) -> Column:
    """struct(rule, verdict) of the longest rule whose host or parent domain and path prefix fit; else null."""
    chain = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return chain if chain is not None else F.lit(None).cast("struct<rule: string, verdict: string>")


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(lower_ascii(F.coalesce(url, F.lit(""))), _TOKEN), lambda t: t != ""))


def rule_index(urls: DataFrame, rules: list[PatternRule]) -> DataFrame:
    """(token, regex, verdict): each rule under its token that is rarest over all rows of urls (url)."""
    spark = urls.sparkSession
    wanted = spark.createDataFrame(sorted({(t,) for r in rules for t in r.tokens}), "token string")
    seen = urls.select(F.explode_outer(url_tokens(F.col("url"))).alias("token"))
    seen = seen.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, "token").groupBy("token").count()
    counts = dict(map(tuple, seen.collect()))  # no more rows than the rules have tokens
    rows = [(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), r.regex, r.verdict) for r in rules if r.tokens]
    return spark.createDataFrame(rows, "token string, regex string, verdict string")


def pattern_verdicts(urls: DataFrame, rules: list[PatternRule]) -> DataFrame:
    """(url, pattern_verdict) for the distinct urls that some rule matches; an allow rule outweighs a block rule."""
    index = rule_index(urls, rules)
    tokens = urls.select("url", F.explode_outer(url_tokens(F.col("url"))).alias("token"))
    candidates = tokens.join(F.broadcast(index) if len(rules) <= BROADCAST_ROWS else index, "token")
    hits = candidates.where(F.regexp_like(lower_ascii(F.col("url")), F.col("regex")))
    hits = hits.select("url", "verdict")
    if loose := [r for r in rules if not r.tokens]:
        found = F.array(*[F.when(F.regexp_like(lower_ascii(F.col("url")), F.lit(r.regex)), F.lit(r.verdict)) for r in loose])
        hits = hits.unionByName(urls.select("url", F.array_min(found).alias("verdict")).where("verdict IS NOT NULL"))
    return hits.groupBy("url").agg(F.min("verdict").alias("pattern_verdict"))


def hosts_rules(urls: DataFrame, rules) -> DataFrame:
    """(url, rule, rule_verdict) for the distinct urls that one of many host rules fits: each host's own name and parent
    domains are joined with the rules, and the longest rule wins."""
    spark = urls.sparkSession
    table_ = spark.createDataFrame([(r.partition("/")[0], "/" + r.partition("/")[2], r, v) for r, v in dict(rules).items()], "name string, start string, rule string, rule_verdict string")
    labels = F.split("host", r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    named = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("labels", labels).select("url", "path", F.explode(names).alias("name"))
    fits = named.join(F.broadcast(table_) if len(rules) <= BROADCAST_ROWS else table_, "name").where(F.col("path").startswith(F.col("start")))
    best = F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.length("rule"), "rule"))
    return fits.groupBy("url").agg(best.alias("x")).select("url", "x.*")


def judge_urls(pages: DataFrame, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """pages (url and any others) with host, path, rule and verdict, which replace columns of these names.

    A host rule decides; without one, a pattern rule; without either the URL is allowed. A null url or one without
    :// has an empty host and path.
    """
    urls = pages.select("url")
    own = [free_name(pages, n) for n in ("matched_url", "pattern_verdict", "host_rule", "ruled_url")]
    url_, pattern_, rule_, ruled_ = own
    matched, _ = materialize(pattern_verdicts(urls, [PatternRule(*r) for r in pattern_rules]).select(F.col("url").alias(url_), F.col("pattern_verdict").alias(pattern_)), "url-verdicts")
    named = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    if len(host_rules) <= EXPRESSION_RULES:
        named = named.withColumn(rule_, host_rule(F.col("host"), F.col("path"), host_rules))
    else:
        ruled, _ = materialize(hosts_rules(urls, host_rules).select(F.col("url").alias(ruled_), F.struct("rule", F.col("rule_verdict").alias("verdict")).alias(rule_)), "url-rules")
        named = named.join(ruled, F.col("url") == F.col(ruled_), "left")
    joined = named.join(matched, F.col("url") == F.col(url_), "left")
    verdict = F.coalesce(f"{rule_}.verdict", pattern_, F.lit("allow"))
    return joined.withColumn("rule", F.col(f"{rule_}.rule")).withColumn("verdict", verdict).drop(*own)


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages; null urls are allowed, with empty host and path."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    hosts = sorted(HOST_RULES, key=lambda r: (-len(r[0]), r[0]))

    def case(value) -> str:
        arms = ""
        for rule, verdict in hosts:
            name, slash, start = rule.partition("/")
            arms += f" WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{start}') THEN '{value(rule, verdict)}'"
        return f"CASE{arms} END"

    low = "translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    any_of = lambda v: " OR ".join(f"coalesce(regexp_matches({low}, '{PatternRule(*r).regex}'), false)" for r in PATTERN_RULES if r[1] == v)
    return rf"""
WITH p AS (SELECT page_id, url,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, path, {case(lambda r, v: r)} AS rule,
    coalesce({case(lambda r, v: v)}, CASE WHEN {any_of("allow")} THEN 'allow' WHEN {any_of("block")} THEN 'block' ELSE 'allow' END) AS verdict
FROM p"""


SQL = {"op2_url_filter": _sql()}
