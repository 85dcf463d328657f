"""The corpus pipeline: quality rules, near-duplicate removal, surrogates for personal data, mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm.common import table
from foliate.llm.mixing import repeat_rows
from foliate.llm.neardup import keep_one
from foliate.llm.packing import pack_documents
from foliate.llm.pii import pseudonymise
from foliate.llm.quality import fit, keep_good
from foliate.llm.queries import pii_key, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; the ratio is learnt from the documents at hand and the labels."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return keep_good(docs, fit(docs.select("doc_id", "text"), labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return keep_one(docs)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; n_chars follows a text that changed."""
    new = pseudonymise(docs, pii_key(spark)).drop("__kinds")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new = new.withColumn("n_chars", F.when(F.col("__entities") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return new.select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: up to three times, or not at all."""
    return repeat_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequences and offsets."""
    return pack_documents(docs.select("doc_id", "text"), tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("surrogates", surrogates),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL expresses none of hashed models, sampled signatures, keyed permutations and tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    from foliate.llm.common import stash

    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
