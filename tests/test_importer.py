import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foliate.plans.importer import Importer
from foliate.plans.layers import LAYERS
from foliate.sources.journal import CATEGORIES, import_report, read_journal, write_report


def document(i, key, **k):
    return {"id": i, "file_key": key, "dataset": "set-a", "full_text": "The cats are running.", "document_type": "eMAIL", "date": "04/05/00", "is_photo": False, "char_count": 21, "created_at": "2000-02-13 15:01:02", "email_fields": '{"subject":"x"}', **k}


def run_row(i, **k):
    return {"run_id": i, "started_at": "2000-02-13T15:01:02+00:00", "completed_at": "2000-02-13T16:01:02", "status": "completed", "input_dir": "d", "output_name": "o", "model": "gpt-5-nano, deepseek-chat, gpt-5-nano, unlisted", "dpi": 1, "workers": 1, "rpm": 1, "total_files": 1, "success_count": 1, "fail_count": 0, "input_tokens": 1, "output_tokens": 1, "cost_usd": 0.5, **k}


def file_row(key, **k):
    return {"file_key": key, "output_name": "o", "pdf_path": "p", "pdf_sha256": "ab" * 32, "output_sha256": "xx", "status": "success", "first_seen_at": "2000-02-13T15:01:02Z", "processed_at": "2000-02-14T15:01:02Z", "attempts": 1, "model_used": "gpt-5-nano,what", **k}


SOURCES = {
    "documents": [document(1, "doc-one"), document(2, "doc-two", ocr_source=""), document(1, "doc-one"), document(3, "doc-three", full_text="a\x00b")],
    "persons": [{"id": 1, "canonical_name": "N", "slug": "n", "category": "c", "aliases": "[]", "search_terms": "{}", "sources": "[1]"}],
    "kg_entities": [{"id": 1, "name": "a", "entity_type": "t", "metadata": "{}"}, {"id": 2, "name": "b", "entity_type": "t", "metadata": "NaN"}],
    "derived_events": [{"id": 1, "event_date": "May 3, 2015", "event_type": "e", "track": "t", "headline": "h", "amount": 1.25, "currency": "USD", "confidence": "high"}, {"id": 2, "event_type": "e", "track": "t", "headline": "h", "amount": float("nan"), "currency": "USD", "confidence": "high"}],
    "provenance/runs": [run_row("r1")],
    "chunks": [{"id": 1, "document_id": 1, "chunk_index": 0, "content": "x"}, {"id": 1, "document_id": 1, "chunk_index": 0, "content": "x"}, {"id": 1, "document_id": 1, "chunk_index": 0, "content": "y"}, {"id": 2, "document_id": 999, "chunk_index": 0, "content": "z"}, {"id": 3, "document_id": 2, "chunk_index": 0, "content": "w"}],
    "entities": [{"id": 1, "document_id": 1, "entity_type": "t", "value": "v"}, {"id": 2, "document_id": 999, "entity_type": "t", "value": "v"}],
    "kg_relationships": [{"id": 1, "source_id": 1, "target_id": 2, "relationship_type": "r", "weight": 1.0, "metadata": "{}"}, {"id": 2, "source_id": 1, "target_id": 9, "relationship_type": "r", "weight": 1.0, "metadata": "{}"}],
    "event_participants": [{"id": 1, "event_id": 1, "person_name": "p", "role": "x"}],
    "event_sources": [{"id": 1, "event_id": 1, "file_key": "doc-one"}, {"id": 2, "event_id": 1, "file_key": "unmatched"}],
    "financial_transactions": [{"id": 1, "file_key": "doc-one", "dataset": "set-b", "transaction_date": "2006", "amount": -0.123456789, "currency": "USD", "extraction_model": "what"}],
    "curated_docs": [{"id": 1, "file_key": "doc-two", "subject": "s", "status": "gold", "tier": "HIGH", "category": "c", "also_appears_as": "[]"}, {"id": 2, "file_key": "doc-two", "subject": "s", "status": "silver", "tier": "HIGH", "category": "c"}],
    "provenance/files": [file_row("doc-one", run_id="r1"), file_row("unmatched", output_sha256=None)],
}


@pytest.fixture(scope="module")
def imported(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    shards = {}
    for layer, rows in SOURCES.items():
        schema = spark.createDataFrame([], LAYERS[layer].schema).schema
        path = str(folder / layer.replace("/", "_"))
        spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema).coalesce(1).write.parquet(path)
        shards[layer] = [path]
    importer = Importer(spark, shards, str(folder / "tables"))
    return importer, importer.run()


def test_accounts(imported):
    _, counts = imported
    short = {k: (v["read"], v["accepted"], v["quarantined"], v["duplicate"]) for k, v in counts.items()}
    assert short == {
        "documents": (4, 2, 1, 1), "persons": (1, 1, 0, 0), "kg_entities": (2, 2, 0, 0), "derived_events": (2, 1, 1, 0), "provenance/runs": (1, 1, 0, 0),
        "chunks": (5, 2, 2, 1), "entities": (2, 2, 0, 0), "kg_relationships": (2, 1, 1, 0), "event_participants": (1, 1, 0, 0), "event_sources": (2, 2, 0, 0),
        "financial_transactions": (1, 1, 0, 0), "curated_docs": (2, 1, 1, 0), "provenance/files": (2, 2, 0, 0),
    }


def test_values(imported, spark):
    importer, _ = imported
    one = lambda table, key=1: importer.stored(table).where(F.col("id") == key).first()
    d = one("documents")
    assert (str(d.date_parsed), d.date_status, str(d.created_at_parsed), d.email_fields_status) == ("2000-04-05", 1, "2000-02-13 15:01:02", 1)
    assert [(x.lexeme, x.positions) for x in d.full_text_searchvec] == [("cat", [2]), ("run", [4])]
    label = lambda lookup, i: importer.lookups[lookup].where(F.col("id") == i).first().label
    assert label("document_types", d.document_type) == "Email" and label("ocr_sources", d.ocr_source) == "gemini-2.5-flash-lite" and label("ocr_sources", one("documents", 2).ocr_source) == ""
    assert [one("entities", i).document_match_status for i in (1, 2)] == [1, 2] and one("entities", 2).document_id_raw == 999
    assert [one("event_sources", i).document_id for i in (1, 2)] == [1, None]
    t = one("financial_transactions")
    assert (str(t.amount), t.transaction_date_status, t.extraction_model_id, t.extraction_model_status) == ("-0.1234567890", 2, None, 4)
    assert one("curated_docs").tier_id == 3 and one("persons").search_terms_status == 4
    r = importer.stored("provenance_runs").first()
    assert (r.completed_at_parsed, str(r.completed_at_local_parsed), r.model_status) == (None, "2000-02-13 16:01:02", 2)
    assert importer.stored("provenance_runs_models").count() == 2 and importer.stored("provenance_files_models").count() == 2
    f = importer.stored("provenance_files").orderBy("id").collect()
    assert [x.id for x in f] == [1, 2] and [x.document_match_status for x in f] == [1, 2] and [x.output_sha256_status for x in f] == [4, 3]
    assert importer.verify() >= 10


def rows_of(importer):
    """Rows of each file of each layer, as a manifest has them."""
    return {layer: {r.f: r.n for r in importer.source(layer).groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count("*").alias("n")).collect()} for layer in importer.shards}


def test_journal_and_rerun(imported, spark, tmp_path):
    importer, counts = imported
    report = import_report(read_journal(spark, importer.journal), rows_of(importer))
    assert report["documents"]["diagnostics"]["duplicate"] == 1 and report["documents"]["errors"]["partial_date"] == 0
    assert report["financial_transactions"]["errors"] | {"other_parse": 0} == {c: 1 if c in ("partial_date", "unknown_model") else 0 for c in CATEGORIES}
    assert report["chunks"]["quarantine_reasons"] == {"Conflicting unique key": 1, "Required document_id reference does not resolve: 999": 1}
    assert report["provenance/runs"]["links"] == 2 and report["provenance/runs"]["errors"]["partial_timestamp"] == 1
    odd = read_journal(spark, importer.journal).where("kind = 'quarantine' and layer = 'documents'").first()
    assert "doc-three" in odd.record and odd.reason == "NUL character in full_text"
    write_report(spark, report, str(tmp_path / "report.json"))
    assert json.loads((tmp_path / "report.json").read_text())["documents"]["read"] == 4
    with pytest.raises(ValueError, match="manifest"):
        import_report(read_journal(spark, importer.journal), {k: v for k, v in rows_of(importer).items() if k != "persons"})
    snapshot = {t: importer.stored(t).count() for t in ("documents", "chunks", "provenance_files", "provenance_files_models")}
    second = Importer(spark, importer.shards, importer.target)
    again = second.run()
    assert all(c["accepted"] == 0 and c["duplicate"] == counts[k]["duplicate"] + counts[k]["accepted"] for k, c in again.items())
    assert snapshot == {t: importer.stored(t).count() for t in snapshot}
    assert import_report(read_journal(spark, second.journal), rows_of(importer))["documents"]["existing"] == 2


def test_broken_journal_lines_are_named(spark, tmp_path):
    (tmp_path / "j.json").write_text('{"event":"run","status":"started"}\n{"event":\n')
    with pytest.raises(ValueError, match="j.json, line 2"):
        read_journal(spark, str(tmp_path))


@pytest.fixture
def fresh(spark, tmp_path):
    shards = {}
    for layer in ("documents", "provenance/runs"):
        schema = spark.createDataFrame([], LAYERS[layer].schema).schema
        path = str(tmp_path / layer.replace("/", "_"))
        spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in SOURCES[layer]], schema).coalesce(1).write.parquet(path)
        shards[layer] = [path]
    return Importer(spark, shards, str(tmp_path / "tables"))


def test_a_layer_that_fails_leaves_nothing(spark, fresh, monkeypatch):
    check = fresh.check_staged

    def broken(expected, folders):
        if "provenance_runs" in folders:
            raise KeyboardInterrupt
        check(expected, folders)

    monkeypatch.setattr(fresh, "check_staged", broken)
    with pytest.raises(KeyboardInterrupt):
        fresh.run()
    # The layer before is there, and of the one that failed neither table nor bridge, nor a folder that nobody knows.
    assert fresh.stored("documents").count() == 2
    assert fresh.stored("provenance_runs").count() == fresh.stored("provenance_runs_models").count() == 0
    known = {f for own in fresh.catalog.parts().values() for f in own}
    assert {f"provenance_runs/{x.name}" for x in Path(fresh.target, "provenance_runs").iterdir()} <= known
    with pytest.raises(ValueError, match="rolled back"):
        import_report(read_journal(spark, fresh.journal), {"documents": {}, "provenance/runs": {}})
    monkeypatch.setattr(fresh, "check_staged", check)
    assert Importer(spark, fresh.shards, fresh.target).run()["provenance/runs"]["accepted"] == 1


def test_a_write_that_differs_is_not_published(fresh, monkeypatch):
    stage = fresh.catalog.stage
    monkeypatch.setattr(fresh.catalog, "stage", lambda df, table: stage(df.limit(1) if table == "documents" else df, table))
    with pytest.raises(ValueError, match="differs from what was accepted"):
        fresh.run()
    assert fresh.stored("documents").count() == 0


def test_vocabularies_and_vectors(spark, fresh):
    fresh.run()
    docs = fresh.stored("documents")
    fresh.catalog.publish({}, {"documents": fresh.catalog.stage(docs.withColumn("full_text_searchvec", F.lit(None).cast(docs.schema["full_text_searchvec"].dataType)), "documents")})
    assert fresh.backfill_vectors("documents") == 2 and fresh.backfill_vectors("documents") == 0
    assert fresh.stored("documents").where("full_text_searchvec is null").count() == 0
    fresh.catalog.publish({}, {"models": fresh.catalog.stage(spark.createDataFrame([(1, "other")], "id smallint, label string"), "models")})
    with pytest.raises(ValueError, match="models"):
        fresh.check_vocabularies()
