"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .oracles import ORACLE_SQL  # noqa: F401


def tokenizer_path() -> str:
    """The public tokenizer's file, which is installed beside the library and never copied."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_fair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import fair_mix

    mixed = fair_mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select(F.col("__doc_id").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op6_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    return shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filters import filter_urls

    judged = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.col("__verdict").alias("verdict"))


def op7_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    records = archive_round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op8_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, judge

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge(docs, fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", "threshold")


def op9_weighted_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "kept")


def op4_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import score_documents

    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def pii_key(spark: SparkSession) -> bytes:
    """The secret of surrogates: spark.foliate.pii.key, and one that is no secret where that is unset, as in tests."""
    return spark.conf.get("spark.foliate.pii.key", "not a secret: for tests").encode()


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymise

    clean = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))
    return clean.select("doc_id", "text", F.col("__entities").alias("n_entities"), F.col("__kinds").alias("kinds"))


QUERIES = {f.__name__: f for f in (op1_fair_mixing, op2_certified_packing, op3_pii_surrogates, op4_pitman_yor, op5_arc_to_warc, op6_histogram_sharding, op7_threshold_topk, op8_quality_ratio, op9_weighted_neardup, op10_url_cascade)}
