"""Accepting rows: keys, conflicts, duplicates, constraints, and accounts that balance.

Every source row ends as accepted, quarantined or duplicate. Rows are taken in source order. A row that breaks a constraint
is quarantined and doesn't stand in the way of a later one; a row with the primary key of an accepted one is a duplicate if
all its values are equal and is quarantined if not; a row that shares another unique key with an accepted one is quarantined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parsing import has_nul
from .graph import connected_components
from .storage import written

ACCEPTED, QUARANTINED, DUPLICATE = "accepted", "quarantined", "duplicate"
CONFLICT = "Conflicting unique key"


@dataclass(frozen=True)
class Rules:
    """A target table: primary key, other unique keys, columns that can't be null, and checks that must not be false."""

    key: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    required: tuple[str, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)


def with_place(df: DataFrame) -> DataFrame:
    """Rows of files with source_file and source_row, from 0: their identity and order."""
    return df.withColumn("source_file", F.col("_metadata.file_name")).withColumn("source_row", F.col("_metadata.row_index"))


def ordinals(df: DataFrame) -> DataFrame:
    """Rows that have a place with source_ordinal, from 1 over all files in order: files' sizes are summed, rows not sorted."""
    counts = df.groupBy("source_file").agg(F.count("*").alias("n"))  # a row a file
    before = F.coalesce(F.sum("n").over(Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("source_file", before.alias("__before"))
    return df.join(starts, "source_file").withColumn("source_ordinal", F.col("__before") + F.col("source_row") + 1).drop("__before")


def broken_constraint(df: DataFrame, rules: Rules, extra: Column | None = None) -> Column:
    """The first constraint that a row breaks, else null. extra comes first: a reason found by the transformation."""
    reasons = [extra] if extra is not None else []
    reasons += [F.when(F.col(c).isNull(), F.lit(f"null value in {c}")) for c in (*rules.key, *rules.required)]
    reasons += [F.when(has_nul(F.col(f.name)), F.lit(f"NUL character in {f.name}")) for f in df.schema if isinstance(f.dataType, T.StringType)]
    reasons += [F.when(~F.expr(check), F.lit(name)) for name, check in rules.checks.items()]
    return F.coalesce(*reasons, F.lit(None).cast("string"))


def classify(df: DataFrame, rules: Rules, existing: DataFrame | None = None, reason: Column | None = None) -> DataFrame:
    """Rows with source_file and source_row to the same with status and reason.

    existing holds the rows of the target already; they come before all others. A set of colliding rows is found as a
    component of rows that share keys; only those with several unique keys at stake are replayed row by row, each set in a
    task of its own.
    """
    values = [c for c in df.columns if c not in ("source_file", "source_row")]
    rows = df.withColumn("reason", broken_constraint(df, rules, reason)).withColumn("stored", F.lit(False))
    if existing is not None:
        old = existing.select(*values).withColumn("source_file", F.lit("")).withColumn("source_row", F.monotonically_increasing_id())
        rows = rows.unionByName(old.withColumn("reason", F.lit(None).cast("string")).withColumn("stored", F.lit(True)))
    rows = rows.withColumn("digest", F.sha2(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}), 256))
    rows = written(rows, "ingest-rows")
    sound = rows.where("reason is null")
    order = [F.col("stored").desc(), "source_file", "source_row"]
    if not rules.unique:
        first = Window.partitionBy(*rules.key).orderBy(*order)
        ranked = sound.withColumn("i", F.row_number().over(first)).withColumn("winner", F.first("digest").over(first))
        status = F.when(F.col("i") == 1, ACCEPTED).when(F.col("digest") == F.col("winner"), DUPLICATE).otherwise(QUARANTINED)
        done = ranked.withColumn("status", status).withColumn("reason", F.when(F.col("status") == QUARANTINED, CONFLICT).cast("string")).drop("i", "winner")
    else:
        done = _replay(sound, rules, order)
    broken = rows.where("reason is not null").withColumn("status", F.lit(QUARANTINED))
    return done.unionByName(broken).where("not stored").drop("stored", "digest")


def _replay(rows: DataFrame, rules: Rules, order: list) -> DataFrame:
    """Decides rows with several unique keys."""
    keys = (rules.key, *rules.unique)
    marked = rows
    for i, key in enumerate(keys):
        whole = F.lit(True)
        for c in key:
            whole = whole & F.col(c).isNotNull()
        marked = marked.withColumn(f"k{i}", F.when(whole, F.sha2(F.to_json(F.struct(F.lit(i), *key)), 256)))
    names = [f"k{i}" for i in range(len(keys))]
    marked = marked.withColumn("row", F.concat_ws(":", F.col("stored").cast("string"), "source_file", F.col("source_row").cast("string")))
    marked = written(marked, "ingest-keys")
    held = marked.select("row", F.explode(F.array(*names)).alias("k")).where("k is not null")
    shared = held.groupBy("k").agg(F.count("*").alias("n"), F.min("row").alias("hub")).where("n > 1")
    edges = held.join(shared, "k").where("row <> hub").select(F.col("row").alias("a"), F.col("hub").alias("b")).distinct()
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = connected_components(edges, ends)
    grouped = marked.join(sets.withColumnRenamed("node", "row"), "row", "left").drop("row")
    free = grouped.where("group_id is null").withColumn("status", F.lit(ACCEPTED)).drop(*names, "group_id")
    small = grouped.where("group_id is not null").select("source_file", "source_row", "stored", "digest", "group_id", *names)

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["stored", "source_file", "source_row"], ascending=[False, True, True])
        owner: dict[str, str] = {}
        out = []
        for r in pdf.itertuples(index=False):
            own = [getattr(r, k) for k in names if isinstance(getattr(r, k), str)]
            taken = [k for k in own if k in owner]
            if not taken:
                owner.update(dict.fromkeys(own, r.digest))
                out.append((ACCEPTED, None))
            elif r.k0 in owner and owner[r.k0] == r.digest:
                out.append((DUPLICATE, None))
            else:
                out.append((QUARANTINED, CONFLICT))
        return pd.DataFrame({"source_file": pdf.source_file, "source_row": pdf.source_row, "stored": pdf.stored, "status": [s for s, _ in out], "why": [w for _, w in out]})

    decided = small.groupBy("group_id").applyInPandas(decide, "source_file string, source_row long, stored boolean, status string, why string")
    rest = grouped.where("group_id is not null").drop(*names, "group_id").join(decided, ["source_file", "source_row", "stored"]).withColumn("reason", F.col("why")).drop("why")
    return free.unionByName(rest)


def account(classified: DataFrame, by: tuple[str, ...] = ("source_file",)) -> DataFrame:
    """Rows read, accepted, quarantined and duplicate by file, or over all of them."""
    s = F.col("status")
    return classified.groupBy(*by).agg(F.count("*").alias("read"), F.count_if(s == ACCEPTED).alias("accepted"), F.count_if(s == QUARANTINED).alias("quarantined"), F.count_if(s == DUPLICATE).alias("duplicate"))


def check_counts(read: int, accepted: int, quarantined: int, duplicate: int) -> None:
    if min(read, accepted, quarantined, duplicate) < 0 or read != accepted + quarantined + duplicate:
        raise ValueError(f"{read} rows read, {accepted} accepted, {quarantined} quarantined and {duplicate} duplicate don't balance")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def lookup_ids(labels: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(label) to (label, id): ids follow the order of labels; labels that exist keep theirs and new ones come after."""
    fresh = labels.select("label").where("label is not null").distinct()
    if existing is None:
        return fresh.withColumn("id", F.row_number().over(Window.orderBy("label")))
    last = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    new = fresh.join(existing, "label", "left_anti").withColumn("n", F.row_number().over(Window.orderBy("label"))).join(F.broadcast(last), how="cross")
    return existing.select("label", "id").unionByName(new.select("label", (F.col("n") + F.col("last")).cast("int").alias("id")))


def resolve_label(df: DataFrame, column: str, lookup: DataFrame, out: str) -> tuple[DataFrame, Column]:
    """df with a label's id, and the reason to reject a label that the lookup doesn't have. Null stays null."""
    ids = lookup.select(F.col("label").alias("__label"), F.col("id").alias(out))
    joined = df.join(ids, F.col(column) == F.col("__label"), "left").drop("__label")
    return joined, F.when(F.col(column).isNotNull() & F.col(out).isNull(), F.concat(F.lit(f"Unknown {column} label "), F.col(column)))


def fail_on(df: DataFrame, reason: Column) -> DataFrame:
    """df, which can't be read if any row has the reason: the fail-fast form of a rejection."""
    checked = F.when(reason.isNull(), F.lit(True)).otherwise(F.raise_error(reason).cast("boolean"))
    return df.where(checked)


def resolve_parent(df: DataFrame, column: str, parents: DataFrame, key: str, value: str, out: str, required: bool = False) -> tuple[DataFrame, Column, Column]:
    """df with the parent's value for a key, its match status, and the reason to reject a required one that is absent."""
    known = parents.select(F.col(key).alias("__key"), F.col(value).alias("__value"))
    joined = df.join(known, F.col(column) == F.col("__key"), "left").drop("__key").withColumn(out, F.col("__value")).drop("__value")
    gone = F.col(out).isNull()
    status = F.when(gone, "unresolved").otherwise("matched")
    reason = F.when(gone, F.lit(f"Required {column} reference does not resolve")) if required else F.lit(None).cast("string")
    return joined, status, reason


def diagnostics(df: DataFrame, layer: str, found: dict[str, tuple[str, Column, Column]]) -> DataFrame:
    """A row for each value that failed or was only partly read: column to (kind, status, raw)."""
    one = [F.when(status.isin("failed", "partial", "unresolved"), F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("column"), status.alias("status"), raw.cast("string").alias("raw"))) for name, (kind, status, raw) in found.items()]
    return df.select("source_file", "source_row", F.explode(F.filter(F.array(*one), lambda x: x.isNotNull())).alias("d")).select(F.lit(layer).alias("layer"), "source_file", "source_row", "d.*")


def ingest(df: DataFrame, rules: Rules, existing: DataFrame | None, transform: Callable[[DataFrame], tuple[DataFrame, Column | None]] | None = None) -> DataFrame:
    """Transforms and classifies a layer; running it again over what it accepted accepts nothing and calls it duplicate."""
    reason = None
    if transform is not None:
        df, why = transform(df)
        if why is not None:
            df, reason = df.withColumn("__why", why), F.col("__why")
            old = None if existing is None else existing.withColumn("__why", F.lit(None).cast("string"))
            return classify(df, rules, old, reason).drop("__why")
    return classify(df, rules, existing, reason)


def iter_counts(rows: DataFrame) -> Iterator[dict]:
    """The accounts of files as dicts; files are few."""
    yield from (r.asDict() for r in account(rows).orderBy("source_file").collect())
