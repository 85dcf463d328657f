"""The source layers of the corpus and their tables: schemas, transformations, constraints, references, order of import."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, fulltext, parsing
from ..operators.ingest import Rules, resolve_label, resolve_parent
from ..vocab import CURATED_STATUS, CURATED_TIER, FILE_STATUS, MATCH_STATUS, MODELS, PARSE_STATUS, RUN_STATUS, id_of

#: Lookup tables and the source fields whose labels they hold, with the form that labels take.
LOOKUPS: dict[str, list[tuple[str, str, Callable[[Column], Column] | None]]] = {
    "datasets": [("documents", "dataset", None), ("financial_transactions", "dataset", None)],
    "document_types": [("documents", "document_type", parsing.capitalize)],
    "ocr_sources": [("documents", "ocr_source", parsing.ocr_source)],
    "entity_types": [("entities", "entity_type", None)],
    "person_categories": [("persons", "category", None)],
    "kg_entity_types": [("kg_entities", "entity_type", None)],
    "relationship_types": [("kg_relationships", "relationship_type", None)],
    "event_tracks": [("derived_events", "track", None)],
    "event_types": [("derived_events", "event_type", None)],
    "event_confidences": [("derived_events", "confidence", None)],
    "participant_roles": [("event_participants", "role", None)],
    "curated_subjects": [("curated_docs", "subject", None)],
}


class Draft:
    """A layer being transformed: the columns so far, reasons to reject a row in order, and what the journal is told."""

    def __init__(self, df: DataFrame, lookups: dict[str, DataFrame], parents: dict[str, DataFrame]):
        self.df, self.lookups, self.parents = df, lookups, parents
        self.reasons: list[Column] = []
        self.told: dict[str, tuple[str, Column, Column]] = {}
        self.labels: list[tuple[str, str]] = []

    def _keep(self, kind: str, name: str, status: Column, raw: Column) -> None:
        self.df = self.df.withColumn(f"__told_{name}", F.struct(status.alias("status"), raw.cast("string").alias("raw")))
        self.told[name] = (kind, F.col(f"__told_{name}.status"), F.col(f"__told_{name}.raw"))

    def _reject(self, name: str, why: Column) -> None:
        self.df = self.df.withColumn(f"__why_{name}", why)
        self.reasons.append(F.col(f"__why_{name}"))

    def _triple(self, name: str, value: Column, status: Column) -> None:
        """raw, parsed and status columns in place of a source column."""
        self._keep("parse", name, status, F.col(name))
        self.df = self.df.withColumns({f"{name}_raw": F.col(name), f"{name}_parsed": value, f"{name}_status": id_of(status, PARSE_STATUS)}).drop(name)

    def category(self, name: str, target: str, lookup: str, form=None) -> Draft:
        self.labels.append((target, f"lookup_{lookup}"))
        label = form(F.col(name)) if form else F.col(name)
        self.df = self.df.withColumn("__own_label", label)
        if target == name:
            self.df = self.df.drop(name)
        self.df, why = resolve_label(self.df, "__own_label", self.lookups[lookup], target)
        self._reject(target, F.when(why.isNotNull(), F.concat(F.lit(f"Unknown {name} label "), F.col("__own_label"))))
        self.df = self.df.drop("__own_label") if target == name else self.df.drop("__own_label", name)
        return self

    def fixed(self, name: str, target: str, vocabulary: dict[str, int], lower: bool = False) -> Draft:
        label = F.lower(name) if lower else F.col(name)
        self.df = self.df.withColumn("__id", id_of(label, vocabulary))
        self._reject(target, F.when(F.col("__id").isNull(), F.concat(F.lit(f"Unknown {name} label "), F.coalesce(name, F.lit("NULL")))))
        self.df = self.df.drop(name).withColumnRenamed("__id", target)
        return self

    def date(self, name: str, kind: str = "date", keep_local: bool = False) -> Draft:
        self.df = dates.with_parsed(self.df, name)
        value, status, local = dates.as_kind(F.col("__parsed"), F.col(name), kind)
        if keep_local:
            self.df = self.df.withColumn(f"{name}_local_parsed", local)
        self._triple(name, value, status)
        self.df = self.df.drop("__parsed")
        return self

    def json(self, name: str, shape: str | None = None) -> Draft:
        self.df = self.df.withColumn("__status", parsing.json_status(F.col(name), shape))
        self._triple(name, F.when(F.col("__status") == "success", F.col(name)), F.col("__status"))
        self.df = self.df.drop("__status")
        return self

    def hash(self, name: str) -> Draft:
        self._triple(name, *parsing.hash_bytes(F.col(name)))
        return self

    def amount(self, name: str) -> Draft:
        value, bad = parsing.amount(F.col(name))
        self._reject(name, F.when(bad, F.lit(f"{name} is not finite")))
        self.df = self.df.withColumn(name, value)
        return self

    def models(self, name: str) -> Draft:
        """Links to models, as an array of ids, beside the raw list and its outcome."""
        known, status, _ = parsing.model_list(F.col(name))
        self._keep("parse", name, status, F.col(name))
        self.df = self.df.withColumns({"__links": parsing.model_ids(known), f"{name}_raw": F.col(name), f"{name}_status": id_of(status, PARSE_STATUS)}).drop(name)
        return self

    def model(self, name: str) -> Draft:
        number, gone = id_of(F.col(name), MODELS), parsing.missing(F.col(name))
        status = F.coalesce(gone, F.when(number.isNotNull(), "success").otherwise("failed"))
        self._keep("parse", name, status, F.col(name))
        self.df = self.df.withColumns({f"{name}_raw": F.col(name), f"{name}_id": number, f"{name}_status": id_of(status, PARSE_STATUS)}).drop(name)
        return self

    def parent(self, name: str, table: str, key: str = "id", value: str = "id", target: str | None = None, required: bool = False, status: str | None = None, null_passes: bool = False) -> Draft:
        """The accepted parent's value for a key. Absent: a reason to reject if required, else null and unresolved."""
        raw = F.col(name)
        self.df = self.df.withColumn("__raw", raw).withColumn("__ref", raw)
        self.df, match, why = resolve_parent(self.df, "__ref", self.parents[table].select(F.col(key).alias("__k"), F.col(value).alias("__v")), "__k", "__v", "__found", required)
        gone = (F.col("__found").isNull() & raw.isNotNull()) if null_passes else F.col("__found").isNull()
        self._keep("match", name, F.when(gone, "unresolved").otherwise("matched"), F.col("__raw"))
        if required:
            self._reject(target or name, F.when(gone, F.concat(F.lit(f"Required {name} reference does not resolve: "), F.coalesce(F.col("__raw").cast("string"), F.lit("NULL")))))
        if status:
            self.df = self.df.withColumn(status, id_of(match, MATCH_STATUS))
        self.df = self.df.withColumn(target or name, F.col("__found")).drop("__raw", "__ref", "__found")
        return self

    def document(self, required: bool = False) -> Draft:
        return self.parent("file_key", "documents", "file_key", "id", "document_id", required, None if required else "document_match_status")

    def rename(self, **names: str) -> Draft:
        self.df = self.df.withColumnsRenamed(names)
        return self

    def add(self, **columns: Column) -> Draft:
        self.df = self.df.withColumns(columns)
        return self

    def reason(self) -> Column | None:
        return F.coalesce(*self.reasons) if self.reasons else None


@dataclass(frozen=True)
class Layer:
    """A source layer: its columns, what is done to them, and the constraints of its table."""

    schema: str
    transform: Callable[[Draft], Draft]
    rules: Rules
    #: columns of the table, the parent table and its key
    references: tuple[tuple[str, str, str], ...] = field(default=())


def _search_vector(target: str, text: str, limit: int | None) -> dict[str, Column]:
    return {target: fulltext.text_vector(F.col(text), limit)}


def _rules(required: str, key: str = "id", unique: tuple = (), **checks: str) -> Rules:
    return Rules((key,), unique, tuple(required.split()), {k.replace("_", " "): v for k, v in checks.items()})


LAYERS: dict[str, Layer] = {
    "documents": Layer(
        "id long, file_key string, dataset string, full_text string, document_type string, date string, is_photo boolean, has_handwriting boolean, has_stamps boolean, ocr_source string, additional_notes string, page_number string, document_number string, char_count int, created_at string, email_fields string",
        lambda d: d.category("dataset", "dataset", "datasets").category("document_type", "document_type", "document_types", parsing.capitalize).category("ocr_source", "ocr_source", "ocr_sources", parsing.ocr_source).date("date").date("created_at", "timestamp").json("email_fields"),
        _rules("char_count dataset is_photo file_key full_text created_at_raw", unique=(("file_key",),), char_count_is_not_negative="char_count >= 0"),
    ),
    "persons": Layer(
        "id long, canonical_name string, slug string, category string, aliases string, search_terms string, sources string, notes string",
        lambda d: d.category("category", "category_id", "person_categories").json("aliases", "array").json("search_terms", "array").json("sources", "array"),
        _rules("category_id canonical_name slug aliases_raw search_terms_raw sources_raw"),
    ),
    "kg_entities": Layer(
        "id long, name string, entity_type string, description string, metadata string",
        lambda d: d.category("entity_type", "entity_type_id", "kg_entity_types").json("metadata", "object"),
        _rules("entity_type_id name metadata_raw"),
    ),
    "derived_events": Layer(
        "id long, event_date string, event_end_date string, event_type string, track string, headline string, location string, amount double, currency string, payer string, payee string, route_from string, route_to string, aircraft string, time_of_day string, confidence string, narrative string",
        lambda d: d.category("event_type", "event_type_id", "event_types").category("track", "track_id", "event_tracks").category("confidence", "confidence_id", "event_confidences").date("event_date").date("event_end_date").amount("amount").rename(time_of_day="time_of_day_raw"),
        _rules("event_type_id track_id confidence_id headline currency"),
    ),
    "provenance/runs": Layer(
        "run_id string, started_at string, completed_at string, status string, input_dir string, output_name string, model string, dpi int, workers int, rpm int, git_commit string, hostname string, total_files int, success_count int, fail_count int, input_tokens long, output_tokens long, cost_usd double, last_heartbeat string",
        lambda d: d.fixed("status", "run_status", RUN_STATUS).date("started_at", "timestamptz").date("last_heartbeat", "timestamptz").date("completed_at", "timestamptz", keep_local=True).amount("cost_usd").models("model"),
        _rules("input_tokens output_tokens dpi workers rpm total_files success_count fail_count started_at_raw completed_at_raw input_dir output_name model_raw cost_usd", key="run_id"),
    ),
    "chunks": Layer(
        "id long, document_id long, chunk_index int, content string, token_count int, char_start int, char_end int",
        lambda d: d.parent("document_id", "documents", required=True),
        _rules("document_id", unique=(("document_id", "chunk_index"),)),
        (("document_id", "documents", "id"),),
    ),
    "entities": Layer(
        "id long, document_id long, entity_type string, value string, normalized_value string",
        lambda d: d.category("entity_type", "entity_type_id", "entity_types").add(document_id_raw=F.col("document_id")).parent("document_id", "documents", status="document_match_status").rename(value="value_raw", normalized_value="normalized_value_raw").add(normalized_value_parsed=F.lit(None).cast("string"), normalization_rule=F.lit(None).cast("string")),
        _rules("document_id_raw entity_type_id value_raw"),
        (("document_id", "documents", "id"),),
    ),
    "kg_relationships": Layer(
        "id long, source_id long, target_id long, relationship_type string, weight double, evidence string, metadata string",
        lambda d: d.category("relationship_type", "relationship_type_id", "relationship_types").parent("source_id", "kg_entities", required=True).parent("target_id", "kg_entities", required=True).json("metadata", "object"),
        _rules("source_id target_id weight relationship_type_id metadata_raw"),
        (("source_id", "kg_entities", "id"), ("target_id", "kg_entities", "id")),
    ),
    "event_participants": Layer(
        "id long, event_id long, person_name string, role string",
        lambda d: d.category("role", "role_id", "participant_roles").parent("event_id", "derived_events", required=True),
        _rules("event_id role_id person_name"),
        (("event_id", "derived_events", "id"),),
    ),
    "event_sources": Layer(
        "id long, event_id long, file_key string",
        lambda d: d.parent("event_id", "derived_events", required=True).document(),
        _rules("event_id file_key"),
        (("event_id", "derived_events", "id"), ("document_id", "documents", "id")),
    ),
    "financial_transactions": Layer(
        "id long, file_key string, dataset string, transaction_date string, amount double, currency string, merchant_name string, merchant_raw string, merchant_category string, location string, cardholder string, description string, card_type string, account_digits string, statement_date string, flight_from string, flight_to string, flight_carrier string, flight_departure string, flight_ticket string, flight_passenger string, source_page int, extraction_model string, extraction_confidence double",
        lambda d: d.category("dataset", "dataset_id", "datasets").document(required=True).date("transaction_date").date("statement_date").date("flight_departure").amount("amount").model("extraction_model"),
        _rules("document_id dataset_id file_key currency extraction_model_raw"),
        (("document_id", "documents", "id"),),
    ),
    "curated_docs": Layer(
        "id long, file_key string, subject string, status string, tier string, category string, doc_date string, doc_from string, doc_to string, headline string, key_quote string, detail string, thread_value string, also_appears_as string",
        lambda d: d.category("subject", "subject_id", "curated_subjects").fixed("status", "curated_status", CURATED_STATUS).fixed("tier", "tier_id", CURATED_TIER, lower=True).document(required=True).date("doc_date").json("also_appears_as", "array"),
        _rules("document_id subject_id file_key category"),
        (("document_id", "documents", "id"),),
    ),
    "provenance/files": Layer(
        "file_key string, output_name string, pdf_path string, pdf_sha256 string, pdf_size_bytes long, status string, output_path string, output_sha256 string, first_seen_at string, processed_at string, run_id string, input_tokens long, output_tokens long, api_latency_ms long, attempts int, error_message string, model_used string, validation_score int",
        lambda d: d.fixed("status", "file_status", FILE_STATUS).hash("pdf_sha256").hash("output_sha256").date("first_seen_at", "timestamptz").date("processed_at", "timestamptz").parent("run_id", "provenance_runs", "run_id", "run_id", required=True, null_passes=True).document().models("model_used"),
        _rules("attempts file_key output_name pdf_path first_seen_at_raw processed_at_raw model_used_raw", unique=(("source_file_key", "source_row_key"),), validation_score_fits="validation_score BETWEEN -32768 AND 32767"),
        (("run_id", "provenance_runs", "run_id"), ("document_id", "documents", "id")),
    ),
}

#: Tables whose keys later layers look up.
PARENTS = {"documents": ("id", "file_key"), "kg_entities": ("id",), "derived_events": ("id",), "provenance_runs": ("run_id",)}
#: Vectors of a table: column, text and byte limit.
VECTORS = {"documents": ("full_text_searchvec", "full_text", fulltext.MAX_BYTES), "chunks": ("content_searchvec", "content", None)}


def table_of(layer: str) -> str:
    return layer.replace("/", "_")


def with_vector(df: DataFrame, table: str) -> DataFrame:
    return df.withColumns(_search_vector(*VECTORS[table])) if table in VECTORS else df
