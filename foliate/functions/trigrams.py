"""Trigram similarity of texts, as the pg_trgm functions define it.

Words are runs of letters and digits, lower-cased, with two blanks before and one after; a text's trigrams are those of its
words. `similarity` is the Jaccard similarity of two trigram sets and is built in; the word similarities look for the part
of a text that is nearest and run as Arrow UDFs.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = re.compile(r"[^\W_]+")


def trigrams(text: Column) -> Column:
    """The different trigrams of a text, null for null."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the trigram sets of two trigram arrays, as a float."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every > 0, both / every).otherwise(0.0).cast("float")


def _grams(text: str) -> tuple[list[str], list[int], list[int]]:
    """Trigrams in order, and for each the first and last position of its word."""
    grams, first, last = [], [], []
    for w in _WORD.findall(text.lower()):
        padded = f"  {w} "
        n = len(padded) - 2
        at = len(grams)
        grams += [padded[i : i + 3] for i in range(n)]
        first += [at] * n
        last += [at + n - 1] * n
    return grams, first, last


def best_extent(query: str, text: str, whole_words: bool = False) -> float:
    """The largest Jaccard similarity of the query's trigrams and those of a run of the text's; of whole words if asked.

    A best run begins and ends with trigrams of the query, or, for whole words, with the words that hold them.
    """
    wanted = set(_grams(query)[0])
    grams, first, last = _grams(text)
    hits = [i for i, g in enumerate(grams) if g in wanted]
    if not hits or not wanted:
        return 0.0
    starts = sorted({first[i] for i in hits}) if whole_words else hits
    ends = sorted({last[i] for i in hits}) if whole_words else hits
    best = 0.0
    for s in starts:
        seen, common, at = set(), 0, s
        for e in ends:
            if e < s:
                continue
            for i in range(at, e + 1):
                if grams[i] not in seen:
                    seen.add(grams[i])
                    common += grams[i] in wanted
            at = e + 1
            best = max(best, common / (len(wanted) + len(seen) - common))
            # Nothing longer can win: even with every wanted trigram it has too many others.
            if len(wanted) / (len(seen) + len(wanted) - common) <= best:
                break
    return best


def word_similarity(query: str, text: Column, whole_words: bool = False) -> Column:
    """Similarity of a query to the nearest part of each text, as a float; null for null."""

    @F.pandas_udf(T.FloatType())
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: best_extent(query, t, whole_words), na_action="ignore").astype("float32")

    return score(text)


def shares_trigram(query: str, text: Column) -> Column:
    """Whether a text can be similar at all: it holds a word's beginning, or three letters, of the query's. Cheap and exact."""
    inner = sorted({re.escape(g.strip()) for g in _grams(query)[0]})
    return F.lower(text).rlike("|".join(inner)) if inner else F.lit(False)


def similar_pairs(items: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """Pairs (a, b), a < b, of keys whose texts have a similarity of at least threshold.

    A set-similarity join: pairs meet on the rarest trigrams of each text, as many as any similar text must share one of
    (prefix filter), and are then compared exactly. Common trigrams make no pairs.
    """
    grams = items.select(F.col(key).alias("k"), trigrams(F.col(text)).alias("g")).where(F.size("g") > 0)
    frequency = grams.select(F.explode("g").alias("t")).groupBy("t").agg(F.count("*").alias("f"))
    ranked = grams.select("k", F.explode("g").alias("t")).join(frequency, "t").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("r"))
    sized = ranked.withColumn("n", F.size("r"))
    kept = sized.withColumn("p", (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))
    prefix = kept.select("k", "n", F.explode(F.slice("r", F.lit(1), F.col("p"))).alias("x")).select("k", "n", F.col("x.t").alias("t"))
    a, b = prefix.toDF("a", "na", "t"), prefix.toDF("b", "nb", "t")
    near_size = (F.col("na") >= F.col("nb") * threshold - 1e-9) & (F.col("nb") >= F.col("na") * threshold - 1e-9)
    pairs = a.join(b, "t").where((F.col("a") < F.col("b")) & near_size).select("a", "b").distinct()
    left, right = grams.toDF("a", "ga"), grams.toDF("b", "gb")
    return pairs.join(left, "a").join(right, "b").where(similarity(F.col("ga"), F.col("gb")) >= F.lit(threshold).cast("float")).select("a", "b")
