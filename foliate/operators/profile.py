"""Profiles of tables: columns, categories, keys, references, formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import date_shape
from ..functions.parsing import json_type


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row a column, from one pass: rows, nulls, empty texts, longest text, least and greatest number, as text."""
    fields = [f for f in df.schema if columns is None or f.name in columns]
    exprs = [F.count("*").alias("rows")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        text, number = isinstance(f.dataType, T.StringType), isinstance(f.dataType, T.NumericType)
        exprs += [
            F.count_if(c.isNull()).alias(f"n{i}"),
            (F.count_if(c == "") if text else F.lit(None).cast("long")).alias(f"e{i}"),
            (F.max(F.char_length(c)) if text else F.lit(None).cast("int")).alias(f"l{i}"),
            (F.min(c).cast("double") + 0.0 if number else F.lit(None).cast("double")).alias(f"a{i}"),
            (F.max(c).cast("double") + 0.0 if number else F.lit(None).cast("double")).alias(f"z{i}"),
        ]
    rows = [F.struct(F.lit(f.name).alias("column_name"), F.col("rows"), F.col(f"n{i}").alias("null_count"), F.col(f"e{i}").alias("empty_count"), F.col(f"l{i}").cast("long").alias("max_chars"), F.col(f"a{i}").alias("min_value"), F.col(f"z{i}").alias("max_value")) for i, f in enumerate(fields)]
    return df.agg(*exprs).select(F.inline(F.array(*rows)))


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """The number of different values of each column; null counts as one."""
    exprs = [(F.count_distinct(F.col(c)) + F.max(F.when(F.col(c).isNull(), 1).otherwise(0))).alias(c) for c in columns]
    counts = df.agg(*exprs)
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("distinct_count")) for c in columns])))


def category_counts(df: DataFrame, column: str, top: int = 30) -> DataFrame:
    """The most frequent values with their counts, null included, and the number of different values."""
    counts = df.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.count("*").alias("distinct_count"))
    best = counts.orderBy(F.col("n").desc(), F.col("label").asc_nulls_first()).limit(top)
    return best.join(F.broadcast(total), how="cross")  # one row


def reference_coverage(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows with a reference, rows whose reference the parent doesn't have, and how many different references those are."""
    refs = child.select(F.col(column).alias("ref")).where("ref is not null")
    known = parent.select(F.col(key).alias("ref")).distinct().withColumn("known", F.lit(True))
    marked = refs.groupBy("ref").agg(F.count("*").alias("n")).join(known, "ref", "left")
    lost = F.col("known").isNull()
    return marked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nonnull_rows"), F.coalesce(F.sum(F.when(lost, F.col("n"))), F.lit(0)).alias("unmatched_rows"), F.count_if(lost).alias("unmatched_values"))


def candidate_key(df: DataFrame, columns: list[str]) -> DataFrame:
    """Different combinations of the columns, nulls included, beside the number of rows."""
    per = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_keys"), F.count_if(F.col("n") > 1).alias("repeated_keys"))


def json_types(df: DataFrame, column: str) -> DataFrame:
    """How many non-null values have each top-level JSON type, or are invalid. Each different value is read once."""
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    return values.select(json_type(F.col("v")).alias("json_type"), "n").groupBy("json_type").agg(F.sum("n").alias("n"))


def date_shapes(df: DataFrame, column: str) -> DataFrame:
    """How many non-null values look like ISO dates, valid or not, or like something else."""
    return df.where(F.col(column).isNotNull()).groupBy(date_shape(F.col(column)).alias("shape")).agg(F.count("*").alias("n"))


def orphans(child: DataFrame, columns: list[str], parent: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of child whose complete reference (several columns, none null) the parent doesn't have."""
    present = child
    for c in columns:
        present = present.where(F.col(c).isNotNull())
    known = parent.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).distinct()
    on = [F.col(c) == F.col(f"__k{i}") for i, c in enumerate(columns)]
    return present.join(known, on, "left_anti")


def overview(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """What a table looks like, as rows (part, position, content): its shape, a line for each column, its first n rows as JSON."""
    shape = df.agg(F.concat(F.count("*").cast("string"), F.lit(f" x {len(df.columns)}")).alias("content")).select(F.lit("shape").alias("part"), F.lit(0).alias("position"), "content")
    columns = df.sparkSession.createDataFrame([("column", i, f"{f.name}: {f.dataType.simpleString()}") for i, f in enumerate(df.schema)], "part string, position int, content string")
    first = df.orderBy(*order).limit(n)
    number = F.row_number().over(Window.orderBy(*order)) - 1  # over n rows
    rows = first.select(F.lit("row").alias("part"), number.alias("position"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("content"))
    return shape.unionByName(columns).unionByName(rows)
