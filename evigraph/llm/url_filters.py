r"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a host and path prefix (``example.net/en/``: the host and all its
subdomains, if the path starts so) or a pattern in the usual filter-list syntax
(``||host^`` anchors at a host, ``|`` at an end, ``*`` is anything, ``^`` a
separator or the end, ``@@`` marks an exception). Each rule becomes one regular
expression and the list of literal tokens that any matching URL must hold whole.
It is filed under the token that is rarest among the URLs themselves. The tokens
of a URL fetch the candidate rules, and only those run their expressions.

The verdict is that of the longest fitting host rule; without one, a pattern
exception allows, else a pattern blocks, else the URL is allowed.

The rule index is broadcast only while the list is at most ``BROADCAST_RULES``
long; beyond that it is an ordinary join on the token. Verdicts are computed per
distinct URL and joined back. Only DataFrame functions are used.

Rules may come as a table (rule, verdict): a verdict makes a row a host rule,
none a pattern.

Defined results: a null URL or one without "://" has empty host and path and
the default verdict; a very long URL is judged whole; of host rules of equal
length the greatest text counts (a tie); repeated rows are judged alike; an empty
table gives no rows; other columns pass through, but those that bear a result's
name give way to it.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .runtime import free_name

BROADCAST_RULES = 100_000
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Host rules of the standard set (fixed values).
HOST_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Patterns of the standard set: advert and tracking hosts and paths, adult and gambling words, downloads, and repeated views of a page.
PATTERNS = (
    "||doubleclick^", "||adservice.", "||adserver.", "||ads.", "||track.", "||analytics.", "/ads/", "/adserver/", "/banner/", "/popup/", "/pixel.gif", "/tracking/", "/affiliate/",
    "/casino/", "/porn/", "/xxx/", "/betting/", ".exe|", ".zip|", ".apk|", "?page=*&ref=", "&sessionid=", "/wp-login.", "/cgi-bin/", "@@/ads/policy", "@@||analytics.example.org^",
)


@dataclass(frozen=True)
class Rule:
    """One rule: its text, kind (host, block or allow), verdict, expression, and literal tokens."""

    text: str
    kind: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]


def host_rule(text: str, verdict: str) -> Rule:
    """A rule on a host, its subdomains, and a path prefix; it runs on host and path joined."""
    host, slash, path = text.partition("/")
    host, path = host.lower(), slash + path
    tokens = re.findall(r"[a-z0-9]+", host)
    # the end of the path prefix may lie inside a token of the URL
    tokens += [m[0].lower() for m in re.finditer(r"[A-Za-z0-9]+", path) if m.end() < len(path)]
    return Rule(text, "host", verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path) if path else '(?:/|$)'}", tuple(dict.fromkeys(tokens)))


def pattern_rule(text: str) -> Rule:
    """A filter-list pattern; it runs on the lower-cased URL."""
    body = text.lower()
    verdict = "allow" if body.startswith("@@") else "block"
    body = body.removeprefix("@@")
    head, tail = "", ""
    at_host, at_start = body.startswith("||"), body.startswith("|") and not body.startswith("||")
    if at_host:
        head, body = r"^[^/?#]*://(?:[^/?#]*\.)?", body[2:]
    elif at_start:
        head, body = "^", body[1:]
    if body.endswith("|"):
        tail, body = "$", body[:-1]
    regex = head + "".join({"*": ".*", "^": "(?:[^a-z0-9_.%-]|$)"}.get(c, re.escape(c)) for c in body) + tail
    # a token counts only where the pattern itself fixes both its ends
    tokens = [
        m[0] for m in re.finditer(r"[a-z0-9]+", body)
        if (m.start() > 0 and body[m.start() - 1] != "*" or m.start() == 0 and head) and (m.end() < len(body) and body[m.end()] != "*" or m.end() == len(body) and tail)
    ]
    return Rule(text, verdict, verdict, regex, tuple(dict.fromkeys(tokens)))


def standard_rules() -> list[Rule]:
    return [host_rule(*r) for r in HOST_RULES] + [pattern_rule(p) for p in PATTERNS]


def rules_from(table: DataFrame) -> list[Rule]:
    """The rules of a table (rule, verdict), in the order of their texts; the list lies on the driver, as each rule is compiled there."""
    rows = table.where("rule is not null").select("rule", "verdict").distinct().orderBy("rule", "verdict").toLocalIterator()
    return [host_rule(r["rule"], r["verdict"]) if r["verdict"] else pattern_rule(r["rule"]) for r in rows]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without "://"."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWERED), F.lit("")), F.coalesce(path, F.lit(""))


def _tokens(url: Column) -> Column:
    """The distinct literal tokens of a URL, and the empty one under which rules without tokens are filed."""
    return F.array_union(F.regexp_extract_all(F.translate(url, UPPER, LOWERED), F.lit("[a-z0-9]+"), F.lit(0)), F.array(F.lit("")))


def token_counts(urls: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """In how many of the URLs each literal token of the rules occurs (one number a token comes back)."""
    spark = urls.sparkSession
    known = sorted({t for r in rules for t in r.tokens})
    if not known:
        return {}
    wanted = spark.createDataFrame([(t,) for t in known], "token string")
    if len(known) <= BROADCAST_RULES:
        wanted = F.broadcast(wanted)
    return {r["token"]: r["n"] for r in urls.select(F.explode(_tokens(F.col("url"))).alias("token")).join(wanted, "token").groupBy("token").agg(F.count("*").alias("n")).collect()}


def rule_index(spark: SparkSession, rules: list[Rule], counts: dict[str, int]) -> DataFrame:
    """(token, rule, kind, verdict, regex, length), each rule under its rarest token."""
    rows = [(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), r.text, r.kind, r.verdict, r.regex, len(r.text)) for r in rules]
    return spark.createDataFrame(rows, "token string, rule string, kind string, verdict string, regex string, length int")


def judge(pages: DataFrame, rules: list[Rule] | DataFrame | None = None) -> DataFrame:
    """pages with host, path, rule and verdict."""
    rules = standard_rules() if rules is None else rules_from(rules) if isinstance(rules, DataFrame) else rules
    spark = pages.sparkSession
    host, path = split_url(F.col("url"))
    own = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    urls = pages.where("url is not null").select("url")
    index = rule_index(spark, rules, token_counts(urls, rules))
    if len(rules) <= BROADCAST_RULES:
        index = F.broadcast(index)
    candidates = own.where("url is not null").select("url", F.concat("host", "path").alias("place"), F.explode(_tokens(F.col("url"))).alias("token"))
    target = F.when(F.col("kind") == "host", F.col("place")).otherwise(F.translate("url", UPPER, LOWERED))
    fits = candidates.join(index, "token").where((F.col("kind") != "host") | F.col("url").contains("://")).where(F.rlike(target, F.col("regex")))
    best, allow, block, spread, at = (free_name(own, x) for x in ("best", "allow", "block", "spread", "url_of"))
    found = fits.groupBy(F.col("url").alias(at)).agg(
        F.max(F.when(F.col("kind") == "host", F.struct("length", "rule", "verdict"))).alias(best), F.max(F.col("kind") == "allow").alias(allow), F.max(F.col("kind") == "block").alias(block)
    )
    # null urls fit nothing, so a number of their own spreads them over the tasks
    plain = ["page_id"] if "page_id" in own.columns else [x for x, t in own.dtypes if "map<" not in t and "variant" not in t]
    own = own.withColumn(spread, F.when(F.col("url").isNull(), F.xxhash64(*(F.col(f"`{x}`") for x in plain))).otherwise(0))
    verdict = F.coalesce(F.col(best)["verdict"], F.when(F.col(allow), F.lit("allow")).when(F.col(block), F.lit("block")).otherwise(F.lit("allow")))
    joined = own.join(found.withColumn(f"{spread}_", F.lit(0).cast("long")), (F.col("url") == F.col(at)) & (F.col(spread) == F.col(f"{spread}_")), "left")
    kept = [F.col(f"`{x}`") for x in own.columns if x != spread]
    return joined.select(*kept, F.col(best)["rule"].alias("rule"), verdict.alias("verdict"))


def verdict_sql(rules: list[Rule]) -> str:
    """The same verdicts in plain SQL, every expression run on every URL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    lower = f"translate(url, '{UPPER}', '{LOWERED}')"
    hosts = sorted((r for r in rules if r.kind == "host"), key=lambda r: (-len(r.text), r.text))
    case = lambda what: "".join(f" WHEN has AND regexp_matches(host || path, {quote(r.regex)}) THEN {quote(what(r))}" for r in hosts)
    some = lambda kind: " OR ".join(f"regexp_matches(low, {quote(r.regex)})" for r in rules if r.kind == kind) or "false"
    parts = f"""SELECT page_id, url, coalesce(strpos(url, '://') > 0, false) AS has, {lower} AS low,
        CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWERED}') ELSE '' END AS host,
        CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages"""
    return f"""WITH p AS ({parts}),
        j AS (SELECT *, CASE{case(lambda r: r.text)} END AS rule, CASE{case(lambda r: r.verdict)} END AS own FROM p)
        SELECT page_id, host, path, rule,
            coalesce(own, CASE WHEN low IS NULL THEN 'allow' WHEN {some("allow")} THEN 'allow' WHEN {some("block")} THEN 'block' ELSE 'allow' END) AS verdict
        FROM j"""
