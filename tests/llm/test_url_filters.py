import random
import re

import pytest
from pyspark.sql import types as T

from foliate.llm import url_filters as U

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("key", T.StringType()), T.StructField("listed", T.BooleanType()), T.StructField("host", T.StringType())])
URLS = [None, "", "no scheme", "://", "http://", "http:///path", "HTTP://Example.ORG/es/x", "http://example.org/es", "http://www.example.org/en/12?q=/fr/", "http://a.com/fr/", "http://a.com/de/1#x", "http://com/fr/", "http://org", "http://org/"]
URLS += ["http://xorg/", "http://a.net://b.org/", "http://spam-farm.example.net/", "http://x.spam-farm.example.net?u=http://a.org/", "http://notspam-farm.example.net/", "http://ÄB.org/\n/x", "http://cheap-pills.example.com/fr/1", "http://a..org/", "http://.org/", "http://host.com", "http://user@h.org:80/p"]


def brute(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    inside = lambda h: host == h or host.endswith("." + h)
    fits = [(len(h), len(p), h + p, v) for v, rules in (("allow", U.ALLOW_RULES), ("block", U.BLOCK_RULES)) for h, p in rules if inside(h) and path.startswith(p)]
    if fits:
        return host, path, *max(fits)[2:]
    return host, path, None, "block" if any(map(inside, U.BLOCK_DOMAINS)) else "allow"


def rows(spark, urls):
    return spark.createDataFrame([(i, u, "clash", True, "h") for i, u in enumerate(urls)], PAGES)


@pytest.mark.parametrize("max_words", [U.MAX_FILTER_WORDS, 0])
def test_odd_urls_with_filters_and_with_the_join(spark, max_words):
    rng = random.Random(1)
    more = [f"https://{rng.choice(['www.', 'm.', ''])}{rng.choice(['a', 'b', 'free-bets', 'casino-win'])}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['es', 'en', 'fr', 'de'])}/{rng.randrange(30)}" for _ in range(300)]
    urls = URLS + more + more[:5]
    got = U.filter_urls(rows(spark, urls), max_words=max_words)
    many = spark.createDataFrame([(x,) for x in (*U.BLOCK_DOMAINS, None)], "d string")
    assert sorted(got.collect()) == sorted(U.filter_urls(rows(spark, urls), domains=many, max_words=max_words).collect())
    out = {r.page_id: (r["__host"], r["__path"], r["__rule"], r["__verdict"]) for r in got.collect()}
    assert out == {i: brute(u) for i, u in enumerate(urls)}


def test_empty(spark):
    assert U.filter_urls(rows(spark, [])).collect() == []


def test_cascade_is_exact_on_its_universe(spark):
    keys = spark.range(6000).selectExpr("concat('key', id) AS key", "id % 10 = 0 AS listed").cache()
    # The list also holds keys that the universe lacks.
    lists = keys.where("listed").select("key").unionByName(spark.range(100).selectExpr("concat('other', id) AS key"))
    levels = U.build_cascade(lists, keys.select("key"))
    assert len(levels) > 1
    assert keys.where(U.listed(U.F.col("key"), levels) != U.F.col("listed")).count() == 0
    assert U.build_cascade(lists, keys.select("key"), max_words=1) is None
    assert U.build_cascade(lists.limit(0), keys.select("key")) == []


@pytest.mark.parametrize("max_words", [1, 2, 4])
def test_small_filters_give_the_same(spark, max_words):
    """Some levels fit and others don't."""
    urls = [f"http://h{i}.example.com/{'de' if i % 3 else 'fr'}/{i}" for i in range(400)] + URLS
    got = U.filter_urls(rows(spark, urls), domains=tuple(f"h{i}.example.com" for i in range(0, 400, 7)), max_words=max_words)
    bad = {f"h{i}.example.com" for i in range(0, 400, 7)}
    for r in got.collect():
        want = brute(r.url)
        if want[2] is None:
            labels = want[0].split(".")
            want = (*want[:3], "block" if any(".".join(labels[k:]) in bad for k in range(len(labels))) else "allow")
        assert (r["__host"], r["__path"], r["__rule"], r["__verdict"]) == want


def test_rules_and_domains_beyond_the_filters(spark):
    got = U.filter_urls(rows(spark, URLS).withColumn("h", U.F.lit(1)), max_words=0)
    out = {r.page_id: (r["__host"], r["__path"], r["__rule"], r["__verdict"]) for r in got.collect()}
    assert out == {i: brute(u) for i, u in enumerate(URLS)} and "h" in got.columns
