"""URL rules against a plain loop over all rules, and DuckDB."""

from __future__ import annotations

import re

import duckdb
import pytest
from llm_cases import CLASHING

from conftest import SF_SMALL
from ledgerline.llm import url_rules
from ledgerline.llm.queries import ORACLE, QUERIES

URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/en/x?y#z", "http://example.net/EN/", "https://net/", "https://a.net",
    "http://example.com/de/1", "http://xexample.com/de/1", "http://a.b.example.com/de/?q", "http://org/fr/", "http://x.org/fr",
    "ftp://casino-win.example.com/en/", "http://m.Casino-Win.example.org/x", "http://a.example.com/casino-win.html",
    "http://free-bets.example.org/en/1", "http://ads-track.example.com", "http://archive.org/cart/", "http://x.com/cart",
    "http://x.com/login?next=/", "http://x.com/blogin", "http://x.com/a?sessionid=1", "://x.org#a", "http://é.com/ü?://net/",
    "http://a.com://b.net/", "http://user@x.net:80/a\nb", "http://a.com\n/x",
]


def literal(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    lower = lambda s: re.sub("[A-Z]", lambda m: m.group().lower(), s)
    host = lower(host)
    fits = [(h, p, v) for h, p, v in url_rules.DOMAIN_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        h, p, v = max(fits, key=lambda r: len(r[0] + r[1]))
        return host, path, h + p, v
    hit = {v for _, v, _, pattern in url_rules.PATTERN_RULES if re.search(pattern, lower(url))}
    return host, path, None, "allow" if "allow" in hit or not hit else "block"


def test_every_url_like_a_loop_over_all_rules(spark):
    pages = spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(URLS + URLS[:5])], "page_id long, url string, html string")
    rows = {r["page_id"]: tuple(r)[1:] for r in url_rules.judge_urls(pages).collect()}
    assert rows == {i: literal(u) for i, u in enumerate(URLS + URLS[:5])}


def test_clashing_columns_and_empty_table(spark):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(1, "http://a.net/"), (None, None)], "page_id long, url string")
    extra = pages.select("*", *[F.lit(1).alias(c) for c in CLASHING + ["URL", "token", "low", "pattern"]])
    assert sorted(map(str, url_rules.judge_urls(extra).collect())) == sorted(map(str, url_rules.judge_urls(pages).collect()))
    assert url_rules.judge_urls(pages.limit(0)).collect() == []
    assert [r["verdict"] for r in url_rules.judge_urls(pages, pattern_rules=[]).orderBy("page_id").collect()] == ["allow", "block"]


def test_rules_without_tokens_are_refused(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    with pytest.raises(ValueError):
        url_rules.judge_urls(pages, pattern_rules=[("any", "block", [], ".")])


def test_only_candidate_rules_run(spark):
    plan = url_rules.judge_urls(spark.read.parquet(f"{SF_SMALL}/pages.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF_SMALL}/pages.parquet')")
    want = con.sql(ORACLE["op6_url_rules"])
    df = QUERIES["op6_url_rules"](spark, SF_SMALL)
    assert sorted(map(tuple, df.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_a_url_of_very_many_rows_is_split(spark):
    from pyspark.sql import functions as F

    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    url = F.when(F.col("id") % 3 == 0, "http://casino-win.example.com/x").when(F.col("id") % 3 == 1, F.concat(F.lit("http://a.com/"), F.col("id")))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        judged = url_rules.judge_urls(spark.range(9000).select(F.col("id").alias("page_id"), url.alias("url")).repartition(8))
        assert judged.where("verdict = 'block'").count() == 3000 and judged.count() == 9000
        query = judged._jdf.queryExecution()
        query.toRdd().count()
        assert "SortMergeJoin(skew=true)" in query.executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
