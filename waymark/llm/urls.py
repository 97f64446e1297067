"""URL filters: pattern rules indexed by their rarest literal token. DataFrame operations only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_TOKEN = "[^0-9a-z]+"


@dataclass(frozen=True)
class Rule:
    """A rule: what it is called, block or allow, its pattern, the tokens that every match has whole.

    A site rule looks at host and path, is shown in the result, and goes before any other; of several the
    longest wins. Another rule looks at the whole lower-cased url.
    """

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    site: bool = False


def site_rule(action: str, text: str) -> Rule:
    """A host with all its subdomains, and the beginning of a path."""
    host, slash, path = text.partition("/")
    whole = re.split(_NO_TOKEN, host) + re.split(_NO_TOKEN, path)[:-1]  # the path's last token may go on in the url
    java = re.sub(r"([^0-9A-Za-z/])", r"\\\1", host + slash + path)
    return Rule(text, action, rf"^(?:[^/]*\.)?{java}", tuple(t for t in whole if t), True)


SITE_RULES = (
    site_rule("block", "com/en/"),
    site_rule("allow", "example.com/en/7"),
    site_rule("allow", "net/de/"),
    site_rule("block", "example.net/de/8"),
    site_rule("block", "org/es/"),
)
#: Pages that are no prose: advertisements, sign-in forms, scripts, sessions.
OTHER_RULES = (
    Rule("ads host", "block", r"://ads\.", ("ads",)),
    Rule("ad server", "block", r"[/.]adserver[/.]", ("adserver",)),
    Rule("sign-in", "block", r"/wp-login\.php(?:[?#]|$)", ("wp", "login", "php")),
    Rule("script", "block", r"/cgi-bin/", ("cgi", "bin")),
    Rule("session", "block", r"[?&]sessionid=[0-9a-f]+", ("sessionid",)),
)
#: The rules of :func:`sql`, whose text is left as it was: it blocks net/de/, which the contract and SITE_RULES allow.
SQL_RULES = tuple(site_rule("block", r.name) if r.name == "net/de/" else r for r in SITE_RULES + OTHER_RULES)


def rules_of(table: DataFrame) -> tuple[Rule, ...]:
    """Rules out of a table of name, action, pattern and tokens; a row without pattern is a site rule by its name. The table is a
    set of rules and no corpus."""
    out = []
    for r in table.select("name", "action", "pattern", "tokens").distinct().orderBy("name", "pattern").collect():
        if r["action"] not in ("block", "allow"):
            raise ValueError(f"{r['name']}: no such action as {r['action']}")
        out.append(site_rule(r["action"], r["name"]) if r["pattern"] is None else Rule(r["name"], r["action"], r["pattern"], tuple(r["tokens"] or ())))
    return tuple(out)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for a null url or one without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: tuple[Rule, ...] = SITE_RULES + OTHER_RULES, url: str = "url") -> DataFrame:
    """pages with host, path, rule (the site rule that decided, else null) and verdict.

    Every rule is kept under that token of its own which the fewest urls have. A url's tokens fetch
    rules; only these run their pattern. Without a match the verdict is allow.

    The verdict depends on the url alone, so distinct urls are matched, and a page repeated many times
    costs one row in the join. Null and empty urls have no tokens, very long ones are read whole; an empty table gives no
    rows. Rows, ties and other columns stay; columns with the names of the new ones are replaced. Thousands of rules, which
    :func:`rules_of` reads, are a table of their own that Spark broadcasts while it is small.
    """
    for r in rules:
        if not r.tokens:
            raise ValueError(f"{r.name}: no literal token to find it by")
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    base = pages.select(*kept, host.alias("host"), path.alias("path"))
    urls = base.where(F.col(url).isNotNull()).groupBy(F.col(url).alias("__url")).agg(F.first("host").alias("__host"), F.first("path").alias("__path"))
    # The host is lower-cased as its own, the rest of the url too: tokens are found in any case.
    tokens = F.array_distinct(F.split(lower_ascii(F.col("__url")), _NO_TOKEN))
    words = sorted({t for r in rules for t in r.tokens})
    theirs = urls.select("__url", "__host", "__path", F.explode(F.array_intersect(tokens, F.array(*map(F.lit, words)))).alias("__token"))
    # At most one count for each token of a rule comes to the driver.
    seen = {r["__token"]: r["n"] for r in theirs.groupBy("__token").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = [(min(r.tokens, key=lambda t: (seen.get(t, 0), t)), r.name, r.action, r.pattern, r.site, len(r.name)) for r in rules]
    index = spark.createDataFrame(rows, "__token string, __rule string, __action string, __pattern string, __site boolean, __size int")
    subject = F.when(F.col("__site"), F.concat("__host", "__path")).otherwise(lower_ascii(F.col("__url")))
    hits = theirs.join(index, "__token").where(F.rlike(subject, F.col("__pattern")))
    # A site rule before others, the longest first, then block before allow, then by name.
    order = F.struct("__site", "__size", F.col("__action") == "block", "__rule")
    best = hits.groupBy("__url").agg(F.max_by(F.struct("__site", "__rule", "__action"), order).alias("__best"))
    return base.join(best, F.col(url) == F.col("__url"), "left").select(
        *kept,
        "host",
        "path",
        F.when(F.col("__best.__site"), F.col("__best.__rule")).alias("rule"),
        F.coalesce("__best.__action", F.lit("allow")).alias("verdict"),
    )


def sql(rules: tuple[Rule, ...] = SQL_RULES) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    low = lambda c: f"translate({c}, '{_UPPER}', '{_LOWER}')"
    values = ", ".join(f"({q(r.name)}, {q(r.action)}, {q(r.pattern)}, {r.site})" for r in rules)
    return f"""
WITH r AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, url, {low("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(name, action, pattern, site) AS (VALUES {values}),
best AS (SELECT u.url, arg_max(row(name, action, site), row(site, length(name), action = 'block', name)) AS b
  FROM (SELECT DISTINCT url, host, path FROM p) u JOIN rules ON regexp_matches(CASE WHEN site THEN host || path ELSE {low("u.url")} END, pattern) GROUP BY u.url)
SELECT page_id, host, path, CASE WHEN b[3] THEN b[1] END AS rule, coalesce(b[2], 'allow') AS verdict FROM p LEFT JOIN best ON p.url = best.url
"""
