"""Reading tables and layers of shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.storage import exists, qualified


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shard_paths(root: str, layer: str, shards: int) -> list[str]:
    """The paths of a layer's numbered shards; parallel exports beside them aren't of the layer."""
    stem = layer.rpartition("/")[2]
    return [f"{root}/{layer}/{stem}-{i:05d}-of-{shards:05d}.parquet" for i in range(shards)]


def missing_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    return [p for p in paths if not exists(spark, p)]


def scan_layer(spark: SparkSession, paths: list[str], schema: T.StructType | None = None) -> DataFrame:
    """The rows of all shards, none of which may be missing."""
    if gone := missing_paths(spark, paths):
        raise FileNotFoundError(f"missing shards: {gone}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*paths)


def manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, sha256, bytes and rows of each file: rows of Parquet files, line feeds of others.

    A path is a file or a folder, of which all files count. file begins with the path's last part (`pages.parquet`, or
    `pages.parquet/part-0.parquet` in a folder). It is an error if a folder named as Parquet holds other files, or if a file
    has 2 GB or more.
    """
    paths = list(dict.fromkeys(paths))
    reader = spark.read.option("recursiveFileLookup", "true")
    files = reader.format("binaryFile").load(paths)
    given = F.get(F.filter(F.lit([qualified(spark, p) for p in paths]), lambda g: (F.col("path") == g) | F.col("path").startswith(F.concat(g, F.lit("/")))), 0)
    files = files.withColumns({"at": F.col("_metadata.file_path"), "name": F.element_at(F.split("path", "/"), -1), "given": given})
    file = F.coalesce(F.concat(F.element_at(F.split("given", "/"), -1), F.expr("substr(path, length(given) + 1)")), "name")
    lines = F.length(F.col("content")) - F.length(F.regexp_replace(F.decode("content", "ISO-8859-1"), "\n", ""))
    stray = F.raise_error(F.concat(F.lit("no Parquet file: "), "path"))
    lines = F.when(~F.col("name").endswith(".parquet"), F.when(F.col("given").endswith(".parquet"), stray).otherwise(lines).cast("long"))  # null of Parquet files
    hashed = files.select("at", file.alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), lines.alias("lines"))
    if files.where(F.col("name").endswith(".parquet")).isEmpty():
        return hashed.select("file", "sha256", "bytes", F.col("lines").alias("rows"))
    counts = reader.option("mergeSchema", "false").option("pathGlobFilter", "*.parquet").parquet(*paths).groupBy(F.col("_metadata.file_path").alias("at")).agg(F.count("*").alias("n"))
    return hashed.join(counts, "at", "left").select("file", "sha256", "bytes", F.coalesce("lines", "n", F.lit(0)).alias("rows"))
