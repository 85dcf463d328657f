"""Comparing layouts of the same data for a query: a warm-up, timed runs, and results that must agree."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from statistics import mean, median

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fulltext


@dataclass(frozen=True)
class Timing:
    variant: str
    seconds: tuple[float, ...]
    rows: int
    signature: str

    @property
    def mean(self) -> float:
        return mean(self.seconds)

    @property
    def median(self) -> float:
        return median(self.seconds)


def signature(df: DataFrame) -> tuple[int, str]:
    """The number of rows and a digest of them that doesn't depend on their order. Rows stay on the executors."""
    row = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)
    halves = [F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    r = df.select(*[h.alias(f"h{i}") for i, h in enumerate(halves)]).agg(F.count("*"), *[F.sum(f"h{i}") for i in range(4)]).first()
    return r[0], hashlib.sha256(json.dumps([str(x) for x in r]).encode()).hexdigest()


def compare_variants(variants: dict[str, Callable[[], DataFrame]], runs: int = 3) -> list[Timing]:
    """Times every variant after a warm-up and raises ValueError if their results differ."""
    out = []
    for name, query in variants.items():
        rows, digest = signature(query())
        seconds = []
        for _ in range(runs):
            began = time.perf_counter()
            query().write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - began)
        out.append(Timing(name, tuple(seconds), rows, digest))
    if len({(t.rows, t.signature) for t in out}) > 1:
        raise ValueError(f"results differ: {[(t.variant, t.rows, t.signature[:12]) for t in out]}")
    return out


def plan_summary(df: DataFrame) -> list[str]:
    """The physical operators of a query, in the order of its formatted plan."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"^\(\d+\) (\w+)", text, re.M)


def inverted_index(docs: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(lexeme, key) of all texts as a table sorted by lexeme: a search reads the row groups that can hold it."""
    v = docs.select(F.col(key).alias("doc"), F.explode(fulltext.text_vector(F.col(text), fulltext.MAX_BYTES)).alias("x"))
    v.select(F.col("x.lexeme").alias("lexeme"), "doc").repartitionByRange("lexeme", "doc").sortWithinPartitions("lexeme", "doc").write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path)


def search_index(index: DataFrame, query: str) -> DataFrame:
    """Documents that have every lexeme of a query."""
    wanted = fulltext.query_lexemes(query)
    hits = index.where(F.col("lexeme").isin(wanted) if wanted else F.lit(False))
    return hits.groupBy("doc").agg(F.count_distinct("lexeme").alias("n")).where(F.col("n") == len(wanted)).select("doc")


def fulltext_layouts(spark: SparkSession, docs: DataFrame, key: str, text: str, query: str, folder: str) -> dict[str, Callable[[], DataFrame]]:
    """A search over raw texts, over stored vectors, and over an inverted index."""
    vectors = f"{folder}/vectors"
    docs.select(F.col(key).alias("doc"), fulltext.text_vector(F.col(text)).alias("v")).write.mode("overwrite").parquet(vectors)
    inverted_index(docs, key, text, f"{folder}/inverted")
    return {
        "raw": lambda: docs.where(fulltext.matches_text(F.col(text), query)).select(F.col(key).alias("doc")),
        "vectors": lambda: spark.read.parquet(vectors).where(fulltext.matches_vector(F.col("v"), query)).select("doc"),
        "inverted": lambda: search_index(spark.read.parquet(f"{folder}/inverted"), query),
    }
