import hashlib

from cases import base_rows, frame
from oracle import DATA

import corpus_pipeline as C
from foliate.llm.mixing import fair_mix


def test_stages_take_effect(spark):
    folder = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "surrogates", "mixing", "packing"]
    kept = {}
    for name, stage in C.STAGES:
        out = stage(spark, docs, folder).cache()
        kept[name] = out
        if name != "packing":
            assert out.columns == docs.columns and 0 < out.count()
        docs = out
    ids = {n: [r.doc_id for r in df.select("doc_id").collect()] for n, df in kept.items()}
    assert set(ids["near_duplicates"]) < set(ids["quality"]) and ids["surrogates"] and sorted(ids["surrogates"]) == sorted(ids["near_duplicates"])
    taken = sum(r.repeats for r in fair_mix(kept["surrogates"]).collect())
    assert len(ids["mixing"]) == taken
    assert kept["packing"].where("piece = 0").count() == taken
    texts = {r.doc_id: r for r in kept["surrogates"].collect()}
    assert all(r.n_chars == len(r.text) for r in texts.values())


def test_run(spark):
    out = C.run(spark, f"{DATA}/sf0.001")
    assert out.count() > 0 and "sequence_id" in out.columns


def test_stages_on_odd_rows_and_empty_tables(spark):
    """Nulls, empty and very long texts, repeated rows, clashing column names, and no rows at all."""
    folder = f"{DATA}/sf0.001"
    for rows in (base_rows(), []):
        docs = frame(spark, rows)
        for name, stage in C.STAGES[:-1]:
            for given in (docs, frame(spark, rows)):  # what the stage before kept, and everything
                out = stage(spark, given, folder)
                assert out.columns == docs.columns, name
                count = out.count()
                assert count <= 3 * given.count()
            docs = stage(spark, docs, folder)
        for given in (docs, frame(spark, rows)):
            pieces = C.packing(spark, given, folder)
            assert pieces.where("piece = 0").count() == given.count()


def test_quality_learns_from_all_trusted(spark, tmp_path):
    """900 trusted documents whose ids have the largest digests of 5,900 have words of their own; all are kept, junk isn't."""
    ids = sorted(range(5900), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    text = lambda word, i: " ".join(f"{word}{(i * 13 + j * 7) % 61}" for j in range(55))
    rows = [(i, text("plain" if place < 5000 else "late", i)) for place, i in enumerate(ids)] + [(10_000 + i, text("$junk", i)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spark.createDataFrame([(i, int(i < 10_000), 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert sorted(r.doc_id for r in C.quality(spark, docs, str(tmp_path)).collect()) == list(range(5900))
