"""URL filtering by Bloom filter cascades: exact membership of keys in lists, without a join.

A key is a domain and the start of a path, like `example.org/es/`. The corpus's URLs have a complete universe of keys:
every suffix of every host, with every path start of a length that the lists use. Level 1 of a cascade is a Bloom filter of
the listed keys, made from the list alone; only what it lets through is looked up in the list. Level 2 is a filter of the unlisted keys that level 1 lets through, level 3 one of the listed keys that level 2
lets through, and so on until a level lets nothing through that it should stop. For every key of the universe the first
level that stops it then tells exactly whether it is listed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash

#: (host, path) of the rules, whose verdicts come first.
ALLOW_RULES = (("org", "/"), ("com", "/fr/"))
BLOCK_RULES = (("example.org", "/es/"), ("example.org", "/en/1"), ("com", "/de/"))
#: Domains whose URLs are blocked where no rule fits, with all their subdomains.
BLOCK_DOMAINS = tuple(f"{name}.example.{top}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))
#: False positives of level 1, and of the others.
FIRST_RATE, RATE = 1 / 64, 1 / 2
#: 64-bit words of a level's bits that are sent to every task; a level that needs more makes the list be joined instead.
MAX_FILTER_WORDS = 1 << 17


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: tuple[int, ...]


def _probes(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * 64 + j)), F.lit(bits)) for j in range(hashes)]


def _passes(key: Column, number: int, level: Level) -> Column:
    """Whether a level lets the key through."""
    text = ",".join(map(str, level.words))
    words = F.split(F.lit(text), ",").cast("array<bigint>")  # folded into one literal before the query runs
    out = F.lit(True)
    for at in _probes(key, number, level.bits, level.hashes):
        word = F.get(words, F.floor(at / 64).cast("int"))
        out = out & (F.getbit(word, F.pmod(at, F.lit(64))) == 1)
    return out


def _level(keys: DataFrame, number: int, n: int, rate: float, max_words: int) -> Level | None:
    """A Bloom filter of n rows (key), None if it passes max_words."""
    hashes = max(1, round(-math.log2(rate)))
    bits = 64 * max(1, math.ceil(n * hashes / math.log(2) / 64))
    if bits // 64 > max_words:
        return None
    ones = keys.select(F.explode(F.array(*_probes(F.col("key"), number, bits, hashes))).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("at", F.lit(64)).cast("int"))
    rows = ones.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(bit).alias("bits")).collect()  # at most max_words
    found = dict(map(tuple, rows))
    return Level(bits, hashes, tuple(found.get(i, 0) for i in range(bits // 64)))


def build_cascade(lists: DataFrame, universe: DataFrame, first_rate: float = FIRST_RATE, rate: float = RATE, max_words: int = MAX_FILTER_WORDS) -> list[Level] | None:
    """The levels for listed keys (key) over a universe (key), each key once in both; None if a level passes max_words.

    The keys that level 1 lets through, of which about first_rate are not listed, are all that is ever looked up in the list.
    """
    n = lists.count()
    if not n:
        return []
    first = _level(lists, 1, n, first_rate, max_words)
    if first is None:
        return None
    levels = [first]
    passed = universe.where(_passes(F.col("key"), 1, first))
    known = lists.select(F.col("key").alias("listed_key"))
    left = stash(passed.join(known, F.col("key") == F.col("listed_key"), "left").select("key", F.col("listed_key").isNotNull().alias("listed")), "url-keys")
    while True:
        number = len(levels) + 1
        inside = F.col("listed") if number % 2 else ~F.col("listed")
        own = left.where(inside)
        n = own.count()
        if not n:
            return levels
        level = _level(own, number, n, rate, max_words)
        if level is None:
            return None
        levels.append(level)
        # What goes on: the keys that this level should stop and doesn't, and those it encodes.
        left = left.where(inside | _passes(F.col("key"), number, level))


def listed(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed."""
    out = F.lit(len(levels) % 2 == 1)
    for number in range(len(levels), 0, -1):
        out = F.when(~_passes(key, number, levels[number - 1]), F.lit(number % 2 == 0)).otherwise(out)
    return out


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or for no `://`."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rest = F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([\s\S]*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_extract(rest, r"^[^/?#]*([\s\S]*)$", 1), r"^[^?#]*", 0)
    return F.translate(host, upper, upper.lower()), path


def _keys(lengths: list[int]) -> Column:
    """All keys of __host and __path, longest domain first and longest path start first."""
    labels = F.split(F.col("__host"), r"\.")
    count = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(labels, i, count), "."))
    starts = [F.when(F.length("__path") >= n, F.substring("__path", 1, n)) for n in sorted(lengths, reverse=True)]
    starts = F.filter(F.array(*starts), lambda s: s.isNotNull())
    return F.when(F.col("__host") == "", F.array().cast("array<string>")).otherwise(F.flatten(F.transform(domains, lambda d: F.transform(starts, lambda s: F.concat(d, s)))))


def _rows(spark: SparkSession, keys: list[str]) -> DataFrame:
    return spark.createDataFrame([(k,) for k in keys], "listed_key string")


def filter_urls(pages: DataFrame, allow: tuple = ALLOW_RULES, block: tuple = BLOCK_RULES, domains: DataFrame | tuple = BLOCK_DOMAINS, max_words: int = MAX_FILTER_WORDS) -> DataFrame:
    """pages with the columns __host, __path, __rule and __verdict added, a row a page.

    A rule (host, path) fits its host and all subdomains if the URL's path starts with the rule's; the one with the longest
    host, then the longest path, wins and gives the verdict. Where none fits, URLs of a listed domain or a subdomain are
    blocked and all others allowed. `domains` may be a DataFrame with one string column, of any size. A null URL and one
    without `://` have an empty host, fit no rule and are allowed. Repeated URLs are judged each, empty tables give no
    rows, and columns of other names pass through.
    """
    spark = pages.sparkSession
    if not isinstance(domains, DataFrame):
        domains = _rows(spark, list(domains))
    base = pages.withColumn("__url", F.col("url"))
    host, path = url_parts(F.col("__url"))
    base = base.withColumn("__host", host).withColumn("__path", path).drop("__url")
    rules = {h + p: "allow" for h, p in allow} | {h + p: "block" for h, p in block}
    lengths = sorted({len(p) for _, p in (*allow, *block)} | {0})

    # The complete universe: keys of the distinct hosts and path starts.
    starts = F.substring("__path", 1, max(lengths))
    distinct = base.select("__host", starts.alias("__path")).distinct()
    universe = distinct.select(F.explode(_keys(lengths)).alias("key")).distinct()
    universe = stash(universe, "url-universe")
    lists = domains.select(F.col(domains.columns[0]).alias("key")).where("key is not null").distinct()
    rule_levels = build_cascade(spark.createDataFrame([(k,) for k in rules], "key string"), universe, max_words=max_words)
    domain_levels = build_cascade(lists, universe, max_words=max_words)

    keys = _keys(lengths)
    if rule_levels is None:  # too many keys that aren't rules pass level 1: the same exact answer from the rules themselves
        fitting = F.filter(keys, lambda k: k.isin(list(rules)))
    else:
        fitting = F.filter(keys, lambda k: listed(k, rule_levels)) if rule_levels else F.array().cast("array<string>")
    rule = F.get(fitting, 0)
    bare = _keys([0])
    if domain_levels is None:  # too many listed domains to send: the same exact answer from a join
        hosts = distinct.select("__host").distinct().withColumn("__path", F.lit("")).select(F.col("__host").alias("__h"), F.explode(bare).alias("__k"))
        bad = hosts.join(lists, F.col("__k") == F.col("key")).select("__h").distinct().withColumn("__bad", F.lit(True))
        base = base.join(bad, F.col("__host") == F.col("__h"), "left").drop("__h").withColumn("__bad", F.coalesce("__bad", F.lit(False)))
    else:
        base = base.withColumn("__bad", F.exists(bare, lambda k: listed(k, domain_levels)) if domain_levels else F.lit(False))
    verdict = F.when(F.col("__rule").isNotNull(), F.element_at(F.create_map(*[F.lit(x) for kv in (rules or {"": ""}).items() for x in kv]), F.col("__rule"))).otherwise(F.when(F.col("__bad"), "block").otherwise("allow"))
    return base.withColumn("__rule", rule).withColumn("__verdict", verdict).drop("__bad")
