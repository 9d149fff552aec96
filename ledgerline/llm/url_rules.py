"""URL filter: pattern rules indexed by their rarest literal token.

Every pattern rule is a regular expression with the literal tokens that any
matching URL must contain. The rules are indexed by the token that is rarest
among the URLs at hand (its document frequency is counted over all of them);
each URL's own tokens fetch the rules filed under them, and only those run
their regular expressions. A rule list of any length therefore costs a URL
only the few rules that share a rare token with it.

Everything is DataFrame expressions: explode, aggregate, join, ``rlike``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import pick
from ledgerline.plans.materialize import stage

#: (name, verdict, literal tokens that a match must contain, pattern over the
#: lower-cased URL). An ``allow`` pattern overrides ``block`` patterns.
PATTERN_RULES = [
    ("casino", "block", ["casino", "win"], r"://([^/?#]*\.)?casino-win\."),
    ("bets", "block", ["free", "bets"], r"://([^/?#]*\.)?free-bets\."),
    ("pills", "block", ["cheap", "pills"], r"://([^/?#]*\.)?cheap-pills\."),
    ("adult", "block", ["adult", "x"], r"://([^/?#]*\.)?adult-x\."),
    ("tracker", "block", ["ads", "track"], r"://([^/?#]*\.)?ads-track\."),
    ("farm", "block", ["spam", "farm"], r"://([^/?#]*\.)?spam-farm\."),
    ("explicit", "block", ["xxx"], r"[./-]xxx[./-]"),
    ("adult_host", "block", ["porn"], r"://[^/?#]*\bporn\b"),
    ("login", "block", ["login"], r"/login(/|\?|$)"),
    ("cart", "block", ["cart"], r"/cart(/|\?|$)"),
    ("session", "block", ["sessionid"], r"[?&;]sessionid="),
    ("archive", "allow", ["archive", "org"], r"://([^/?#]*\.)?archive\.org/"),
]

#: (host, path, verdict) of the domain rules, written host + path.
DOMAIN_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

_TOKEN = r"[^a-z0-9]+"


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` to ``/ ? #`` or end, A-Z lower-cased) and
    path (from there to ``? #`` or end); both empty without ``://`` or for null."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return _ascii_lower(host), path


def domain_rule(host: Column, path: Column, rules=None) -> tuple[Column, Column]:
    """Name and verdict of the longest domain rule that fits; nulls if none does.

    A rule fits its host and all subdomains if the path starts with the rule's.
    Rules are tried longest host first, then longest path.
    """
    rules = sorted(rules or DOMAIN_RULES, key=lambda r: (-len(r[0].split(".")), -len(r[1]), r))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, rule_verdict in reversed(rules):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(rule_verdict)).otherwise(verdict)
    return name, verdict


def _rules_frame(spark: SparkSession, rules) -> DataFrame:
    rows = [
        F.struct(
            F.lit(i).alias("rule_id"),
            F.lit(verdict).alias("verdict"),
            F.array(*map(F.lit, tokens)).alias("tokens"),
            F.lit(pattern).alias("pattern"),
        )
        for i, (_, verdict, tokens, pattern) in enumerate(rules)
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def pattern_verdicts(urls: DataFrame, rules=None) -> DataFrame:
    """``url`` and ``pattern_verdict`` for the distinct ``url`` values that a pattern rule matches.

    ``urls`` has a column ``url``. Distinct URLs are judged once. A rule without
    tokens cannot be indexed and is rejected with a ValueError.
    """
    spark = urls.sparkSession
    rules = PATTERN_RULES if rules is None else rules
    if not rules:
        return urls.select("url", F.lit("allow").alias("pattern_verdict")).limit(0)
    if any(not r[2] for r in rules):
        raise ValueError("every pattern rule needs a literal token")
    distinct = urls.where(F.col("url").isNotNull()).select("url").distinct()
    low = distinct.withColumn("low", _ascii_lower(F.col("url")))
    tokens = low.select("url", "low", F.explode(F.array_distinct(F.split("low", _TOKEN))).alias("token"))
    literals = _rules_frame(spark, rules).select(
        "rule_id", "verdict", "pattern", F.explode("tokens").alias("token")
    )
    # How many URLs hold each literal: counted over all URLs, kept for literals only.
    wanted = literals.select("token").distinct()
    frequency = tokens.join(wanted, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        literals.join(frequency, "token", "left")
        .groupBy("rule_id", "verdict", "pattern")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest"))
        .select("verdict", "pattern", F.col("rarest.token").alias("token"))
    )
    hits = tokens.join(rarest, "token").where(F.expr("low rlike pattern"))
    return hits.groupBy("url").agg(
        F.when(F.max(F.col("verdict") == "allow"), "allow").otherwise("block").alias("pattern_verdict")
    )


def judge_urls(pages: DataFrame, domain_rules=None, pattern_rules=None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``.

    The longest fitting domain rule decides; where none fits, the pattern rules
    do (allow over block), and a URL that no rule matches is allowed.

    Defined cases: a null URL or one without ``://`` has empty host and path,
    no domain rule, and is allowed unless a pattern matches its text; repeated
    rows are all returned; an empty table gives an empty result; other columns,
    whatever their names, are not read.
    """
    pages = pick(pages, "page_id", "url")
    host, path = host_and_path(F.col("url"))
    named = pages.withColumns({"host": host, "path": path})
    rule, ruled = domain_rule(F.col("host"), F.col("path"), domain_rules)
    named = named.withColumns({"rule": rule, "ruled": ruled})
    # written, so that the join below is of plain shuffles and a URL of very many rows is split
    matched = stage(pattern_verdicts(named.where(F.col("ruled").isNull()), pattern_rules), "url-verdicts")
    missing = named.where(F.col("url").isNull()).withColumn("pattern_verdict", F.lit(None).cast("string"))
    met = named.where(F.col("url").isNotNull()).join(matched, "url", "left")
    return met.unionByName(missing).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", "pattern_verdict", F.lit("allow")).alias("verdict"),
    )
