"""URL filters: many rules, few of which are tried on each URL.

A URL is judged by its site, host and path in one string (see `parts`). Two kinds of rules:

* a site rule is `host` with a path, such as `example.net/en/`: it fits the host, all its subdomains and every path that
  starts with its own; the longest that fits decides,
* a pattern is literal text with `*` for any run of characters, `^` for a character that ends a token or the site's end,
  and `|` at either end for the site's start or end; patterns judge the sites no site rule fits, and block wins over allow.

Both become regular expressions. A rule can only fit if the whole tokens (runs of letters and digits) it spells out are
in the site, so each is filed under the one that the fewest sites of the table hold. The tokens of a site fetch the rules
filed under them, and only those expressions run. A rule that spells out no whole token is filed under the empty token,
which every site holds. Sites are judged once however often they occur; the join back to the rows splits hot sites.

Edge cases: a null URL, or one without `://`, has an empty host and path, no rule and the default verdict. Hosts match as
they stand, ports included. A path that is empty does not start with `/`. Rows that repeat an id or a URL each get a row;
null ids stay. Extra columns are ignored. Repeated rules count once; a rule text that is both allow and block blocks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.skew import salted_join
from millrace.session import settle

ALLOW, BLOCK = "allow", "block"
# Site rules as (rule, verdict).
SITE_RULES = [("net/", BLOCK), ("example.net/en/", ALLOW), ("example.com/de/", BLOCK), ("org/fr/", ALLOW)]
# Patterns of pages that hold no prose of their own, or that farms of links and bets serve.
PATTERNS = [
    ("/login^", BLOCK), ("/signin^", BLOCK), ("/register^", BLOCK), ("/wp-admin/", BLOCK), ("/wp-login.php", BLOCK),
    ("/cart^", BLOCK), ("/checkout^", BLOCK), ("/search/", BLOCK), ("/tag/*/feed/", BLOCK), ("/cgi-bin/", BLOCK),
    ("/ads/", BLOCK), ("/adserver/", BLOCK), (".exe|", BLOCK), (".zip|", BLOCK), (".iso|", BLOCK), (".apk|", BLOCK),
    ("spam-farm.", BLOCK), ("free-bets.", BLOCK), ("casino-", BLOCK), ("|ads.", BLOCK), ("|tracker.", BLOCK),
    ("/help/login^", ALLOW),
]
_TOKEN = "[A-Za-z0-9]+"
END = r"\z"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path (up to ? or #)."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _quoted(text: str) -> str:
    return "".join(c if c.isascii() and c.isalnum() else "\\" + c if c.isascii() else c for c in text)


def site_rule(rule: str) -> tuple[str, list[str]]:
    """The expression of a site rule and the whole tokens it spells out."""
    host, slash, path = rule.partition("/")
    tokens = re.findall(_TOKEN, host) + [t[1] for t in re.finditer(rf"({_TOKEN})(?=[^A-Za-z0-9])", slash + path)]
    return rf"^(?:[^/]*\.)?{_quoted(host)}{_quoted(slash + path) if slash else '(?:/|' + END + ')'}", tokens


def pattern_rule(rule: str) -> tuple[str, list[str]]:
    """The expression of a pattern and the whole tokens it spells out."""
    first, last = rule.startswith("|"), rule.endswith("|") and len(rule) > 1
    body = rule[first:len(rule) - last]
    spelled = ("^" if first else "") + "".join(
        ".*" if c == "*" else f"(?:[^A-Za-z0-9]|{END})" if c == "^" else _quoted(c) for c in body) + (END if last else "")
    tokens = [t[0] for t in re.finditer(_TOKEN, body)
              if (body[t.start() - 1] != "*" if t.start() else first)
              and (body[t.end()] != "*" if t.end() < len(body) else last)]
    return "(?s)" + spelled, tokens


def rules(spark: SparkSession, sites: list[tuple[str, str]], patterns: list[tuple[str, str]]) -> DataFrame:
    """(rule, verdict, site, regex, tokens) of site rules and patterns."""
    rows = [(r, v, True, *site_rule(r)) for r, v in sites] + [(r, v, False, *pattern_rule(r)) for r, v in patterns]
    return spark.createDataFrame(rows, "rule string, verdict string, site boolean, regex string, tokens array<string>")


def tokens(site: Column) -> Column:
    """The whole tokens of a site and the empty one."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(site, F.lit(_TOKEN), F.lit(0))))


def filed(known: DataFrame, sites: DataFrame) -> DataFrame:
    """Rules with the token they are filed under: of their own the one in the fewest of sites (site, tokens)."""
    wanted = known.select(F.explode("tokens").alias("token")).distinct()
    held = (sites.select(F.explode("tokens").alias("token")).join(wanted, "token", "left_semi")
            .groupBy("token").agg(F.count("*").alias("n")))
    choice = (known.select("rule", "site", F.explode("tokens").alias("token")).join(held, "token", "left")
              .groupBy("rule", "site").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("t")))
    return known.join(choice, ["rule", "site"], "left").select(
        "rule", "verdict", "site", "regex", F.coalesce("t.token", F.lit("")).alias("token"))


def judged(sites: DataFrame, known: DataFrame) -> DataFrame:
    """(url, rule, site_verdict, pattern, pattern_verdict) of the sites (url, site, tokens) some rule fits."""
    own = F.struct("rule", "verdict", "site", "regex")
    shelves = settle(filed(known, sites).groupBy("token").agg(F.collect_set(own).alias("filed")), "shelves")
    asked = sites.select("url", F.col("site").alias("text"), F.explode("tokens").alias("token"))
    fetched = salted_join(asked, shelves, ["token"], "inner", ["url"])  # a token may be in every site
    hits = fetched.select("url", "text", F.inline("filed")).where(F.expr("text rlike regex"))
    mine = F.col("site")
    best = F.struct(F.length("rule").alias("n"), F.col("verdict"), F.col("rule"))
    strict = F.struct(F.col("verdict"), F.length("rule").alias("n"), F.col("rule"))
    found = hits.groupBy("url").agg(F.max(F.when(mine, best)).alias("s"), F.max(F.when(~mine, strict)).alias("p"))
    return found.select("url", F.col("s.rule").alias("rule"), F.col("s.verdict").alias("site_verdict"),
                        F.col("p.rule").alias("pattern"), F.col("p.verdict").alias("pattern_verdict"))


def judge(pages: DataFrame, known: DataFrame, default: str = ALLOW) -> DataFrame:
    """page_id, host, path, rule, verdict and pattern (the pattern that decided, if one did) of every row."""
    host, path = parts(F.col("url"))
    site = F.concat(*parts(F.col("url")))
    urls = pages.select("url").where("url is not null").distinct()
    sites = settle(urls.withColumn("site", site).where("site <> ''").withColumn("tokens", tokens(F.col("site"))), "sites")
    told = settle(judged(sites, known), "verdicts")
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    joined = salted_join(rows, told, ["url"], "left", ["page_id"])
    return joined.select(
        "page_id", "host", "path", "rule",
        F.coalesce("site_verdict", "pattern_verdict", F.lit(default)).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("pattern")).alias("pattern"))


def oracle() -> str:
    """DuckDB SQL of the query: every rule is tried on every page."""
    listed = ", ".join(f"('{r}', '{v}', {s}, '{x}')" for s, own, make in
                       (("true", SITE_RULES, site_rule), ("false", PATTERNS, pattern_rule))
                       for r, v in own for x in [make(r)[0]])
    return f"""
WITH known(rule, verdict, site, regex) AS (VALUES {listed}),
rest AS (SELECT row_number() OVER () k, page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) r FROM pages),
p AS (SELECT k, page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                   'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
hit AS (SELECT k, n.* FROM p JOIN known n ON regexp_matches(p.host || p.path, n.regex) WHERE p.host || p.path <> ''),
s AS (SELECT k, max(struct_pack(n := length(rule), verdict := verdict, rule := rule)) t FROM hit WHERE site GROUP BY 1),
q AS (SELECT k, max(struct_pack(verdict := verdict, n := length(rule), rule := rule)) t FROM hit WHERE NOT site GROUP BY 1)
SELECT page_id, host, path, s.t.rule AS rule, coalesce(s.t.verdict, q.t.verdict, '{ALLOW}') AS verdict,
       CASE WHEN s.t IS NULL THEN q.t.rule END AS pattern
FROM p LEFT JOIN s USING (k) LEFT JOIN q USING (k)
"""
