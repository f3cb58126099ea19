"""URL filters: pattern rules indexed by their rarest literal token.

Two kinds of rules judge a URL. Site rules name a host with all its subdomains and a path prefix, and the longest that
fits decides. Where none fits, pattern rules decide: each is filed under the one of its literal tokens that is rarest
among the URLs, a URL's distinct tokens fetch the rules filed under them, and only those run their regular expression;
a URL that any of them matches is blocked, any other allowed. Everything is DataFrame operations.

Rule tables are broadcast up to BROADCAST_RULES rules and joined by shuffle beyond. A row's number is its place in the
scan, so the URLs must come in the same order each time, as a table of files gives them.

Defined cases: of site rules of equal length that fit, block goes before allow; a URL of any length is judged whole; host and path are empty for a null URL or one without `://`; such a URL has no tokens unless its text
has, and is allowed if nothing matches; repeated rows are judged alike; an empty table gives an empty
result; input columns may have any name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules that may be broadcast.
BROADCAST_RULES = 50_000
#: The site rules, as (verdict, host, path).
SITE_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Pattern rules: a regular expression over the lower-cased URL, and whole tokens (runs of letters and digits) that every
#: match contains.
PATTERN_RULES = (
    (r"://([^/?#]*[.-])?casino[.-]", ("casino",)),
    (r"[./_-]casino[./_-]([^?#]*[./_-])?win[./_-]", ("casino", "win")),
    (r"://([^/?#]*[.-])?free-bets[.-]", ("free", "bets")),
    (r"://([^/?#]*[.-])?poker[.-]", ("poker",)),
    (r"[./_-]slots[./_-]", ("slots",)),
    (r"[./_-]jackpot[./_-]", ("jackpot",)),
    (r"://([^/?#]*[.-])?ads-track[.-]", ("ads", "track")),
    (r"://([^/?#]*[.-])?adserver\.", ("adserver",)),
    (r"[./_-]doubleclick[./_-]", ("doubleclick",)),
    (r"/pixel\.(gif|png)([?#]|$)", ("pixel",)),
    (r"://([^/?#]*[.-])?spam-farm[.-]", ("spam", "farm")),
    (r"://([^/?#]*[.-])?link-farm[.-]", ("link", "farm")),
    (r"://([^/?#]*[.-])?cheap-pills[.-]", ("cheap", "pills")),
    (r"[./_-]online-pharmacy[./_-]", ("online", "pharmacy")),
    (r"[./_-]viagra[./_-]", ("viagra",)),
    (r"[./_-]cialis[./_-]", ("cialis",)),
    (r"://([^/?#]*[.-])?adult[.-]", ("adult",)),
    (r"[./_-]porn[./_-]", ("porn",)),
    (r"://([^/?#]*[.-])?xxx[.-]", ("xxx",)),
    (r"[./_-]payday-loans[./_-]", ("payday", "loans")),
    (r"[./_-]replica-watches[./_-]", ("replica", "watches")),
    (r"[./_-]warez[./_-]", ("warez",)),
    (r"[./_-]torrent[./_-]", ("torrent",)),
    (r"[./_-]phishing[./_-]", ("phishing",)),
    (r"\.exe([?#]|$)", ("exe",)),
    (r"[?&]affid=", ("affid",)),
)
_TOKEN = re.compile(r"[a-z0-9]+")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def site_verdict(host: Column, path: Column, rules=SITE_RULES) -> tuple[Column, Column]:
    """(rule as host + path, verdict) of the longest rule that fits; nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, at, below in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(below)
        rule, verdict = F.when(fits, f"{at}{below}").otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column) -> Column:
    """Distinct runs of letters and digits of the lower-cased URL."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(url, F.lit(""))), F.lit("([a-z0-9]+)"), 1))


def rule_table(spark: SparkSession, rules=PATTERN_RULES) -> DataFrame:
    """(rule_id, pattern, literal): a row for each literal token of each rule. A large table can be given as such instead."""
    for pattern, literals in rules:
        if not literals or any(not _TOKEN.fullmatch(x) for x in literals):
            raise ValueError(f"a rule needs literal tokens: {pattern}")
        re.compile(pattern)
    rows = [(i, pattern, x) for i, (pattern, literals) in enumerate(rules) for x in literals]
    return spark.createDataFrame(rows, "rule_id int, pattern string, literal string")


def _sent(rules: DataFrame, few: bool) -> DataFrame:
    """A table of rules as a join takes it."""
    return F.broadcast(rules) if few else rules.hint("shuffle_merge")


def rarest_index(urls: DataFrame, url_col: str, rules: DataFrame, few: bool = True) -> DataFrame:
    """(token, rule_id, pattern): each rule under the literal token that the fewest URLs hold; few: rules may be broadcast."""
    wanted = rules.select(F.col("literal").alias("token")).distinct()
    tokens = urls.select(F.explode(tokens_of(F.col(url_col))).alias("token"))
    if not few:
        # One row for each token first, so that a token of all URLs is no row of the join for each.
        tokens = tokens.groupBy("token").agg(F.count("*").alias("n"))
    held = tokens.join(_sent(wanted, few), "token", "left_semi")
    if not few:
        return _rarest(rules, held)
    return _rarest(rules, held.groupBy("token").agg(F.count("*").alias("n")))


def _rarest(rules: DataFrame, counts: DataFrame) -> DataFrame:
    ranked = rules.join(counts, rules["literal"] == counts["token"], "left")
    rarest = F.min_by("literal", F.struct(F.coalesce("n", F.lit(0)), "literal"))
    return ranked.groupBy("rule_id", "pattern").agg(rarest.alias("token"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", site_rules=SITE_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict. `pages` is scanned again for each step.

    pattern_rules: pairs of pattern and literal tokens, or a table as `rule_table` makes it.
    """
    table = pattern_rules if isinstance(pattern_rules, DataFrame) else rule_table(pages.sparkSession, pattern_rules)
    few = (table.select("rule_id").distinct().count() if isinstance(pattern_rules, DataFrame) else len(pattern_rules)) <= BROADCAST_RULES
    url = F.col("__url")
    rule, verdict = site_verdict(F.col("host"), F.col("path"), site_rules)
    rows = (
        pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("__url"), F.monotonically_increasing_id().alias("__tag"))
        .withColumns({"host": host_of(url), "path": path_of(url)})
        .withColumns({"rule": rule, "__site": verdict})
    )
    index = rarest_index(pages, url_col, table, few)
    # Only what no site rule decides needs the patterns.
    fetched = rows.filter(F.col("rule").isNull()).select("__tag", F.lower("__url").alias("__low"), F.explode(tokens_of(url)).alias("token"))
    hits = fetched.join(_sent(index, few), "token").filter(F.expr("regexp_like(__low, pattern)"))
    blocked = hits.select("__tag").distinct().withColumn("__hit", F.lit(True))
    judged = rows.join(blocked, "__tag", "left")
    method = F.when(F.col("__hit"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("__site", method).alias("verdict"))
