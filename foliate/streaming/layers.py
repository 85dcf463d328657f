"""Layers as streams: each micro-batch of new files goes through the same acceptance as a batch import."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import Rules, classify
from ..operators.storage import exists


def stream_layer(spark: SparkSession, folder: str, schema: T.StructType, rules: Rules, target: str, checkpoint: str) -> StreamingQuery:
    """Follows a folder of Parquet files; target gets rows with their status, partitioned by it. Ends when all files are in.

    A batch is compared with what was accepted before, so a file that comes again adds nothing, and a batch that is run
    again after a failure replaces its own rows.
    """
    source = spark.readStream.schema(schema).parquet(folder).select("*", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.row_index").alias("source_row"))

    def accept(batch: DataFrame, number: int) -> None:
        old = None
        if exists(spark, target):
            old = spark.read.parquet(target).where((F.col("status") == "accepted") & (F.col("batch") != number)).select(*schema.names)
        rows = classify(batch, rules, old).withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    return source.writeStream.foreachBatch(accept).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
