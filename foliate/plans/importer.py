"""Importing all layers: tables, vocabularies, lookups, transformations, acceptance, bridges, journal, verification.

A layer's table and bridge appear together, after its accounts balance and what was staged, read back, equals what was
accepted; an error or an interruption leaves everything as it was before the layer and says so in the journal. Accepted rows
are added to what is stored, which isn't rewritten. Running an import again accepts nothing new.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ingest import account, check_counts, classify, diagnostics, lookup_ids, ordinals, same_rows, with_place
from ..operators.profile import orphans
from ..operators.storage import Catalog, written
from ..sources.journal import EVENT
from ..sources.tables import scan_layer
from ..vocab import VOCABULARIES
from .layers import LAYERS, LOOKUPS, PARENTS, VECTORS, Draft, table_of, with_vector

#: What _shape() found, by layer.
_SHAPES: dict[str, tuple] = {}


class Importer:
    """An import from shards (layer to paths) into tables below a folder, with a journal of its own."""

    def __init__(self, spark: SparkSession, shards: dict[str, list[str]], target: str):
        self.spark, self.shards, self.target = spark, shards, target.rstrip("/")
        self.catalog = Catalog(spark, self.target)
        self.journal = f"{self.target}/journal/{uuid.uuid4().hex}"
        self.lookups: dict[str, DataFrame] = {}
        self.counts: dict[str, dict[str, int]] = {}

    def stored(self, table: str) -> DataFrame | None:
        return self.catalog.read(table)

    def source(self, layer: str) -> DataFrame:
        return scan_layer(self.spark, self.shards[layer], self.spark.createDataFrame([], LAYERS[layer].schema).schema)

    def tell(self, events: DataFrame) -> None:
        have = set(events.columns)
        row = [F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in EVENT]
        events.select(*[c.alias(f.name) for c, f in zip(row, EVENT, strict=True)]).write.mode("append").json(self.journal)

    def say(self, **event) -> None:
        self.tell(self.spark.createDataFrame([tuple(str(v) if not isinstance(v, int) else v for v in event.values())], list(event)))

    # Tables and vocabularies

    def _draft(self, layer: str, rows: DataFrame) -> Draft:
        if layer == "provenance/files":
            rows = ordinals(rows).withColumnRenamed("source_ordinal", "id").withColumns({"source_file_key": F.col("source_file"), "source_row_key": F.col("source_row")})
        return LAYERS[layer].transform(Draft(rows, self.lookups, self.parents()))

    def _shape(self, layer: str) -> tuple[dict[str, StructType], list[str], list[tuple[str, str]]]:
        """The schemas of a layer's table and bridge, the table's columns before its vector, and its columns with lookups.

        They follow from the code alone, so they are found once, by transforming no rows.
        """
        if layer not in _SHAPES:
            table = table_of(layer)
            draft = self._draft(layer, self.spark.createDataFrame([], LAYERS[layer].schema + ", source_file string, source_row long"))
            values = self._values(draft.df)
            schemas = {table: with_vector(draft.df.select(*values), table).schema}
            if "__links" in draft.df.columns:
                schemas[f"{table}_models"] = self._links(draft.df, table).schema
            _SHAPES[layer] = schemas, values, draft.labels
        return _SHAPES[layer]

    @staticmethod
    def _values(df: DataFrame) -> list[str]:
        return [c for c in df.columns if not c.startswith(("__told_", "__why_")) and c not in ("__links", "__reason", "source_file", "source_row")]

    def create_tables(self) -> None:
        """Every table, bridge and vocabulary that isn't there yet; those that are stay as they are."""
        have, new = self.catalog.parts(), {}
        for name, labels in VOCABULARIES.items():
            if name not in have:
                new[name] = self.catalog.stage(self.spark.createDataFrame([(i, x) for x, i in labels.items()], "id smallint, label string"), name)
        for name in LOOKUPS:
            if f"lookup_{name}" not in have:
                new[f"lookup_{name}"] = self.catalog.stage(self.spark.createDataFrame([], "label string, id int"), f"lookup_{name}")
        if new:
            self.catalog.publish(new)
        self.lookups = {name: self.stored(f"lookup_{name}") for name in LOOKUPS}
        for layer in LAYERS:
            table = table_of(layer)
            if table not in have:
                shapes = self._shape(layer)[0]
                self.catalog.publish({name: self.catalog.stage(self.spark.createDataFrame([], schema).coalesce(1), name) for name, schema in shapes.items()})

    def check_vocabularies(self) -> None:
        """The stored vocabularies have to be those of the code, whose ids the layers write."""
        for name, labels in VOCABULARIES.items():
            stored = {r.label: r.id for r in self.stored(name).collect()}  # a few labels
            if stored != labels:
                raise ValueError(f"{name}: stored are {stored}, expected {labels}")

    def populate_lookups(self) -> None:
        """Ids of all labels; labels that were there before keep theirs. What is stored then has to hold every label of the source."""
        for name, fields in LOOKUPS.items():
            own = [self.source(layer).select((form(F.col(column)) if form else F.col(column)).alias("label")) for layer, column, form in fields if layer in self.shards]
            table = f"lookup_{name}"
            if own:
                labels = reduce(DataFrame.unionByName, own)
                before = self.stored(table)
                fresh = lookup_ids(labels, before).join(before.select("label"), "label", "left_anti")
                folder = self.catalog.stage(fresh.select("label", "id"), table)
                if not self.catalog.staged(folder).isEmpty():
                    self.catalog.publish({table: folder})
                stored = self.stored(table)
                twice = stored.groupBy("id").count().unionByName(stored.groupBy(F.col("label").alias("id")).count().withColumn("id", F.lit(0))).where("count > 1")
                if not twice.isEmpty() or not labels.where("label is not null").join(stored, "label", "left_anti").isEmpty():
                    raise ValueError(f"{table}: the stored labels differ from the source's")
            self.lookups[name] = self.stored(table)

    def parents(self) -> dict[str, DataFrame]:
        return {table: df.select(*keys) for table, keys in PARENTS.items() if (df := self.stored(table)) is not None}

    @staticmethod
    def _links(df: DataFrame, table: str) -> DataFrame:
        key = "run_id" if table == "provenance_runs" else "id"
        return df.select(F.col(key).alias("parent_id"), F.explode("__links").alias("model_id"))

    def backfill_vectors(self, table: str) -> int:
        """Fills search vectors that stored rows lack; their number. Doing it again changes nothing."""
        vector, text, _ = VECTORS[table]
        df = self.stored(table)
        lacking = df.where(F.col(vector).isNull() & F.col(text).isNotNull()).count()
        if lacking:
            kept = df.withColumn("__old", F.col(vector))
            filled = with_vector(kept, table).withColumn(vector, F.coalesce("__old", vector)).select(*df.columns)
            folder = self.catalog.stage(filled, table)
            if self.catalog.staged(folder).count() != df.count():
                self.catalog.discard([folder])
                raise ValueError(f"{table}: rows were lost while vectors were filled")
            self.catalog.publish({}, {table: folder})
        return lacking

    # Layers

    def load(self, layer: str) -> dict[str, int]:
        """Imports one layer and returns its accounts."""
        staged: list[str] = []
        try:
            return self._load(layer, staged)
        except BaseException:
            self.catalog.discard(staged)
            raise

    def _load(self, layer: str, staged: list[str]) -> dict[str, int]:
        spec, table = LAYERS[layer], table_of(layer)
        source = with_place(self.source(layer))
        draft = self._draft(layer, source)
        reason = draft.reason()
        full = written(draft.df.withColumn("__reason", reason if reason is not None else F.lit(None).cast("string")), f"layer-{table}")
        values = self._values(full)
        old = self.stored(table)
        existing = 0 if old is None else old.count()
        plain = full.select(*values, "source_file", "source_row", F.col("__reason").alias("__why"))
        before = None if old is None else old.select(*values).withColumn("__why", F.lit(None).cast("string"))
        done = written(classify(plain, spec.rules, before, F.col("__why")).drop("__why"), f"classified-{table}")
        shards = account(done).collect()  # files are few
        for r in shards:
            check_counts(r["read"], r.accepted, r.quarantined, r.duplicate)
        total = account(done, ()).first().asDict()
        if total["read"] != self.source(layer).count():
            raise ValueError(f"{layer}: not every source row is accounted for")

        accepted = done.where("status = 'accepted'")
        expected = {table: with_vector(accepted.select(*values), table)}
        if "__links" in full.columns:
            expected[f"{table}_models"] = self._links(full.join(accepted.select("source_file", "source_row"), ["source_file", "source_row"], "left_semi"), table)
        folders = {}
        for name, df in expected.items():
            folders[name] = self.catalog.stage(df, name)
            staged.append(folders[name])
        self.check_staged(expected, folders)
        links = self.catalog.staged(folders[f"{table}_models"]).count() if f"{table}_models" in folders else 0
        self.catalog.publish(folders)
        stored = self.stored(table).count()
        if stored != existing + total["accepted"]:
            raise ValueError(f"{layer}: {existing} rows and {total['accepted']} accepted, but {stored} stored")

        if draft.told:
            kept = {name: (kind, F.col(f"__told_{name}.status"), F.col(f"__told_{name}.raw")) for name, (kind, _, _) in draft.told.items()}
            self.tell(diagnostics(full, layer, kept).withColumn("event", F.lit("diagnostic")))
        # What isn't stored is kept whole in the journal.
        record = source.select("source_file", "source_row", F.to_json(F.struct(*[c for c in source.columns if c not in ("source_file", "source_row")]), {"ignoreNullFields": "false"}).alias("record"))
        odd = done.where("status <> 'accepted'").select("source_file", "source_row", F.when(F.col("status") == "duplicate", "duplicate").otherwise("quarantine").alias("kind"), "reason")
        self.tell(odd.join(record, ["source_file", "source_row"]).withColumns({"event": F.lit("diagnostic"), "layer": F.lit(layer)}))
        if table in VECTORS and (limit := VECTORS[table][2]) is not None:
            large = accepted.where(F.octet_length(VECTORS[table][1]) > limit)
            self.tell(large.select("source_file", "source_row", F.lit("diagnostic").alias("event"), F.lit(layer).alias("layer"), F.lit("search_vector_skipped").alias("kind")))
        for r in shards:
            self.say(event="shard", layer=layer, source_file=r.source_file, read=r["read"], accepted=r.accepted, quarantined=r.quarantined, duplicate=r.duplicate)
        self.say(event="layer", layer=layer, status="committed", existing=existing, stored=stored, links=links, **total)
        return total

    def check_staged(self, expected: dict[str, DataFrame], folders: dict[str, str]) -> None:
        """What was staged, read back, has to be what was accepted."""
        for name, df in expected.items():
            if not same_rows(self.catalog.staged(folders[name]), df):
                raise ValueError(f"{name}: what was written differs from what was accepted")

    def run(self) -> dict[str, dict[str, int]]:
        self.say(event="run", status="started")
        self.create_tables()
        self.check_vocabularies()
        self.populate_lookups()
        for layer in LAYERS:
            if layer in self.shards:
                self.say(event="layer", layer=layer, status="started")
                try:
                    self.counts[layer] = self.load(layer)
                except BaseException:
                    self.say(event="layer", layer=layer, status="rolled_back")
                    raise
        for table in VECTORS:
            self.backfill_vectors(table)
        self.verify()
        self.say(event="run", status="completed", layers=len(self.counts))
        return self.counts

    def verify(self) -> int:
        """Checks every reference of every table to parents, lookups and vocabularies, and of every bridge; their number.

        An orphan is an error, and so is a key that repeats.
        """
        checks: list[tuple[str, str, str, str]] = []
        for layer, spec in LAYERS.items():
            table, (schemas, values, labels) = table_of(layer), self._shape(layer)
            checks += [(table, column, parent, key) for column, parent, key in spec.references]
            checks += [(table, column, lookup, "id") for column, lookup in labels]
            checks += [(table, c, "parse_statuses", "id") for c in values if c.endswith("_status") and f"{c.removesuffix('_status')}_raw" in values and not c.endswith("match_status")]
            checks += [(table, c, "match_statuses", "id") for c in values if c.endswith("match_status")]
            if f"{table}_models" in schemas:
                key = "run_id" if table == "provenance_runs" else "id"
                checks += [(f"{table}_models", "parent_id", table, key), (f"{table}_models", "model_id", "models", "id")]
            df = self.stored(table)
            for key in (spec.rules.key, *spec.rules.unique):
                whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
                if not df.where(whole).groupBy(*key).count().where("count > 1").isEmpty():
                    raise ValueError(f"{layer} repeats a key: {', '.join(key)}")
        tables = {t: self.stored(t) for t in {x for c in checks for x in (c[0], c[2])}}
        for table in dict.fromkeys(c[0] for c in checks):  # a job a table
            found = [orphans(tables[t], [column], tables[parent], [key]).select(F.lit(column).alias("column")) for t, column, parent, key in checks if t == table]
            if gone := reduce(DataFrame.unionByName, found).limit(1).collect():
                raise ValueError(f"{table}.{gone[0][0]} has orphans")
        return len(checks)
