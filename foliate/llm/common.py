"""What the operators of this subpackage share: the shared folder, tables written to cut lineage, words."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import shared_dir, written

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: its lineage ends there, and no executor's loss undoes it."""
    return written(df, name)


def n_words(text: Column) -> Column:
    """Words of a text, as a long; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_place() -> Column:
    """A hash that differs from row to row of a stashed table and is the same on every reading, even for repeated rows.

    It tells rows apart by the number of the part that holds them and their index there, not by the part's random name, so
    it is the same from run to run where the table is written in the same parts.
    """
    part = F.regexp_replace(F.col("_metadata.file_name"), "-[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", "")
    return F.xxhash64(part, F.col("_metadata.row_index"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
