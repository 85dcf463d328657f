import json

import pytest
from pyspark.sql import functions as F

from foliate.operators import graph, ingest, profile
from foliate.operators.storage import MaterializedView, shared_dir
from foliate.plans import benchmark, queries
from foliate.plans.queries import daily_models, fulltext_ids, model_names
from foliate.sources import journal, tables


def rows(spark, data, schema):
    df = spark.createDataFrame([(*r, "f", i) for i, r in enumerate(data)], schema + ", source_file string, source_row long")
    return df.repartition(2)


def status(df):
    return [r.status[0] for r in df.orderBy("source_row").collect()]


CHUNKS = ingest.Rules(key=("id",), unique=(("document_id", "chunk_index"),), required=("document_id",), checks={"parent": "document_id < 900"})
SCHEMA = "id long, document_id long, chunk_index int, content string"


def test_chunks_mixed(spark):
    data = [(1, 1, 0, "a"), (1, 1, 0, "a"), (1, 1, 0, "b"), (2, 999, 0, "c"), (3, 1, 1, "n\x00l"), (4, 1, 2, "d")]
    assert status(ingest.classify(rows(spark, data, SCHEMA), CHUNKS)) == ["a", "d", "q", "q", "q", "a"]


def test_rerun_accepts_nothing(spark):
    data = [(1, 1, 0, "a"), (2, 1, 1, "b"), (2, 1, 1, "b")]
    stored = spark.createDataFrame([(1, 1, 0, "a")], SCHEMA)
    first = ingest.classify(rows(spark, data, SCHEMA), CHUNKS, stored)
    assert status(first) == ["d", "a", "d"]
    stored = stored.unionByName(first.where("status = 'accepted'").select(*stored.columns))
    assert status(ingest.classify(rows(spark, data, SCHEMA), CHUNKS, stored)) == ["d", "d", "d"]


def test_greedy_order_with_two_unique_keys(spark):
    """A quarantined row doesn't block later ones: 2 loses its place to 1, so 3, which collides only with 2, is taken."""
    data = [(1, 1, 0, "a"), (2, 1, 0, "b"), (2, 1, 5, "c"), (3, 1, 5, "d"), (4, 7, None, "e"), (5, 7, None, "f")]
    assert status(ingest.classify(rows(spark, data, SCHEMA), CHUNKS)) == ["a", "q", "a", "q", "a", "a"]


def test_single_key_and_reason(spark):
    data = [(1, 1, 0, "a"), (None, 1, 0, "a"), (1, 1, 0, "a"), (5, None, 1, "x")]
    out = ingest.classify(rows(spark, data, SCHEMA), ingest.Rules(key=("id",), required=("document_id",)))
    assert status(out) == ["a", "q", "d", "q"]
    assert {r.reason for r in out.where("status = 'quarantined'").collect()} == {"null value in id", "null value in document_id"}
    acc = ingest.account(out).first()
    ingest.check_counts(acc["read"], acc.accepted, acc.quarantined, acc.duplicate)
    with pytest.raises(ValueError):
        ingest.check_counts(5, 2, 1, 1)
    assert list(ingest.iter_counts(out)) == [{"source_file": "f", "read": 4, "accepted": 1, "quarantined": 2, "duplicate": 1}]


def test_ingest_with_transform(spark):
    labels = ingest.lookup_ids(spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "label string"))
    assert {r.label: r.id for r in labels.collect()} == {"a": 1, "b": 2}
    more = ingest.lookup_ids(spark.createDataFrame([("a",), ("0",)], "label string"), labels)
    assert {r.label: r.id for r in more.collect()} == {"a": 1, "b": 2, "0": 3}

    def transform(df):
        return ingest.resolve_label(df, "content", labels, "label_id")

    data = [(1, 1, 0, "a"), (2, 1, 1, "zz"), (3, 1, 2, None)]
    out = ingest.ingest(rows(spark, data, SCHEMA), ingest.Rules(key=("id",)), None, transform)
    assert [(r.status[0], r.label_id) for r in out.orderBy("id").collect()] == [("a", 1), ("q", None), ("a", None)]


def test_references(spark):
    child = spark.createDataFrame([(1, "k"), (2, "x"), (3, None)], "id long, key string")
    parents = spark.createDataFrame([("k", 10)], "key string, pid long")
    joined, match, reason = ingest.resolve_parent(child, "key", parents, "key", "pid", "parent", required=True)
    got = joined.select("id", "parent", match.alias("m"), reason.alias("r")).orderBy("id").collect()
    assert [(r.parent, r.m, r.r is None) for r in got] == [(10, "matched", True), (None, "unresolved", False), (None, "unresolved", False)]
    cover = profile.reference_coverage(child, "key", parents, "key").first()
    assert tuple(cover) == (2, 1, 1)
    assert profile.orphans(child, ["key"], parents, ["key"]).count() == 1


def test_profile(spark):
    df = spark.createDataFrame([(1, "a", 1.5), (2, "", None), (2, None, -3.0)], "i long, t string, x double")
    got = {r.column_name: tuple(r[1:]) for r in profile.column_profile(df).collect()}
    assert got == {"i": (3, 0, None, None, 1.0, 2.0), "t": (3, 1, 1, 1, None, None), "x": (3, 1, None, None, -3.0, 1.5)}
    assert {r.column_name: r.distinct_count for r in profile.distinct_values(df, ["i", "t"]).collect()} == {"i": 2, "t": 3}
    assert tuple(profile.candidate_key(df, ["i"]).first()) == (3, 2, 1)
    assert [(r.label, r.n, r.distinct_count) for r in profile.category_counts(df, "i").collect()] == [(2, 2, 2), (1, 1, 2)]
    j = spark.createDataFrame([("{}",), ("[]",), ("x",), (None,), ("{}",)], "j string")
    assert {r.json_type: r.n for r in profile.json_types(j, "j").collect()} == {"object": 2, "array": 1, "invalid": 1}
    d = spark.createDataFrame([("2000-01-01",), ("2000-13-01",), ("May",), (None,)], "d string")
    assert {r["shape"]: r.n for r in profile.date_shapes(d, "d").collect()} == {"valid_iso_date": 1, "invalid_iso_date": 1, "other_notation": 1}


def test_two_hops(spark):
    edges = [(1, "a", "b"), (2, "a", "b"), (3, "b", "c"), (4, "c", "d"), (5, "x", "x"), (6, "b", "z"), (7, "m", "z")]
    df = spark.createDataFrame(edges, "id long, source_id string, target_id string")
    got = sorted((r.first_edge_id, r.second_edge_id) for r in graph.two_hop_paths(df).collect())
    assert got == [(1, 6), (2, 6)]
    nodes = spark.createDataFrame([("b",)], "id string")
    assert graph.two_hop_paths(df, nodes).count() == 0


def test_components_and_similar_names(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (9, 8)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 8, 9)], "node long")
    assert {r.node: r.group_id for r in graph.connected_components(edges, nodes).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 8: 8, 9: 8}
    data = [("John Smith", 5), ("John Smithe", 7), ("JOHN SMITHES", 1), ("Ann Lee", 3), ("Debt", -4), ("Nothing", None), (None, 9)]
    items = spark.createDataFrame([(n, a) for n, a in data], "name string, amount long").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    got = sorted((r.names, float(r.total_amount), r.n) for r in graph.similar_name_groups(items, "name", "amount", 0.5).collect())
    assert got == [(["Ann Lee"], 3.0, 1), (["JOHN SMITHES", "John Smith", "John Smithe"], 13.0, 3)]


def test_fulltext_fixture(spark):
    docs = spark.createDataFrame([(1, "air"), (2, "water"), (3, None)], "doc_id long, text string")
    chunks = spark.createDataFrame([(1, "air"), (2, "air"), (3, None)], "doc_id long, content string")
    assert sorted(r.doc_id for r in fulltext_ids(docs, chunks, "air").collect()) == [1, 2]


def test_materialized_view_is_stale_until_refreshed(spark):
    events = spark.createDataFrame([("2020-01-01 10:00:00", 1)], "processed_at string, file_id long").withColumn("processed_at", F.col("processed_at").cast("timestamp"))
    source = {"e": events}
    bridge = spark.createDataFrame([(i, 1 + i % 3) for i in range(10)], "file_id long, model_id int")
    view = MaterializedView(spark, f"{shared_dir(spark)}/view-test", lambda: daily_models(source["e"], bridge, model_names(spark)))
    assert view.create().count() == 1
    with pytest.raises(FileExistsError):
        view.create()
    source["e"] = events.unionByName(events.withColumn("processed_at", F.expr("processed_at + interval 1 day")))
    assert view.read().count() == 1 and view.refresh().count() == 2 and view.drop()


def test_manifest_shards_and_scan(spark, tmp_path):
    d = spark.range(5)
    paths = tables.shard_paths(str(tmp_path), "provenance/files", 2)
    assert paths[1].endswith("provenance/files/files-00001-of-00002.parquet")
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "provenance/files").mkdir(parents=True)
    for i, p in enumerate(paths):
        pq.write_table(pa.table({"id": list(range(i * 3, i * 3 + 3))}), p)
    (tmp_path / "README").write_bytes(b"a\nb\n")
    got = {r.file: r for r in tables.manifest(spark, [*paths, str(tmp_path / "README")]).collect()}
    assert got["README"].rows == 2 and got["README"].bytes == 4 and got["files-00000-of-00002.parquet"].rows == 3
    layer = ingest.ordinals(ingest.with_place(tables.scan_layer(spark, paths)))
    assert sorted((r.id, r.source_ordinal) for r in layer.collect()) == [(i, i + 1) for i in range(6)]
    with pytest.raises(FileNotFoundError):
        tables.scan_layer(spark, [*paths, str(tmp_path / "gone.parquet")])
    assert ingest.same_rows(d, spark.range(5)) and not ingest.same_rows(d, spark.range(4))


def test_manifest_of_tables_in_folders(spark, tmp_path):
    """Folders of parts, in which names repeat, are as whole as files; a mixed folder is told apart file by file."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    root = tmp_path / "a b%20ü.parquet"
    sizes = {"nation.parquet": 2, "orders.parquet/part-0.parquet": 3, "orders.parquet/o=1/part-0.parquet": 4, "orders.parquet/o=1/part-1.parquet": 0, "pages.parquet/part-0.parquet": 5, "mixed/part-0.parquet": 6}
    for name, n in sizes.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        pq.write_table(pa.table({name[:2]: list(range(n))}), root / name)
    (root / "mixed/README").write_bytes(b"a\nb")
    (root / "orders.parquet/_SUCCESS").write_bytes(b"")
    got = tables.manifest(spark, [f"{root}/{t}" for t in ("nation.parquet", "orders.parquet", "pages.parquet", "mixed")]).collect()
    assert {r.file: r.rows for r in got} == sizes | {"mixed/README": 1} and len(got) == 7
    assert all(r.bytes == (root / r.file).stat().st_size for r in got)
    assert {r.file: r.rows for r in tables.manifest(spark, [f"{root}/mixed/README"]).collect()} == {"README": 1}
    assert sorted(map(tuple, queries.manifest_rows(spark, str(root)).collect())) == [("nation.parquet", 2), ("orders.parquet", 7), ("pages.parquet", 5)]
    (root / "pages.parquet/part-1").write_bytes(b"PAR1")
    with pytest.raises(Exception, match="no Parquet file"):
        queries.manifest_rows(spark, str(root)).collect()


def test_report_wants_a_whole_journal(spark, tmp_path):
    line = lambda **k: json.dumps(k)
    told = lambda **k: line(event="diagnostic", layer="layer", **k)
    counts = {"read": 3, "accepted": 1, "quarantined": 1, "duplicate": 1}
    good = [
        line(event="run", status="started"),
        line(event="layer", layer="layer", status="started"),
        line(event="shard", layer="layer", source_file="f", **counts),
        told(kind="parse", column="date", status="partial", raw="2006"),
        told(kind="quarantine", reason="NUL", record="{}"),
        told(kind="duplicate", record="{}"),
        line(event="layer", layer="layer", status="committed", existing=4, stored=5, links=0, **counts),
        line(event="run", status="completed", layers=1),
    ]

    def report(lines, n=3):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        path.write_text("\n".join(lines))
        return journal.import_report(journal.read_journal(spark, str(path)), {"layer": {"f": n}})

    found = report(good)["layer"]
    assert found["errors"]["partial_date"] == 1 and sum(found["errors"].values()) == 1
    assert found["quarantine_reasons"] == {"NUL": 1} and found["diagnostics"] == {"duplicate": 1, "parse": 1, "quarantine": 1}
    without = lambda i: good[:i] + good[i + 1 :]
    for bad in (*(without(i) for i in (0, 1, 2, 4, 5, 6, 7)), [*good, line(event="layer", layer="layer", status="rolled_back")], [*good, good[0]], [*good, told(kind="duplicate")], [x.replace('"stored": 5', '"stored": 6') for x in good]):
        with pytest.raises(ValueError):
            report(bad)
    with pytest.raises(ValueError, match="manifest"):
        report(good, 4)
    with pytest.raises(ValueError, match="line 9"):
        report([*good, "{broken"])


def test_diagnostics_and_safe_values(spark):
    from pyspark.sql import types as T

    df = rows(spark, [("x", "failed"), ("y", "success")], "raw string, status string")
    got = ingest.diagnostics(df, "layer", {"date": ("parse", F.col("status"), F.col("raw"))}).collect()
    assert [(r.layer, r.kind, r.column, r.status, r.raw) for r in got] == [("layer", "parse", "date", "failed", "x")]
    one = spark.range(1).select(journal.json_safe(F.lit(float("nan")), T.DoubleType()), journal.json_safe(F.lit(1.5), T.DoubleType()), journal.json_safe(F.lit(b"\xab"), T.BinaryType())).first()
    assert tuple(one) == ('{"nonfinite_float":"nan"}', "1.5", "ab")


def test_layouts_agree(spark, tmp_path):
    docs = spark.createDataFrame([(i, ["thin air", "airs", "fair", "the air air", ""][i % 5]) for i in range(40)], "id long, text string")
    timings = benchmark.compare_variants(benchmark.fulltext_layouts(spark, docs, "id", "text", "air", str(tmp_path)), runs=1)
    assert [t.rows for t in timings] == [24, 24, 24] and all(t.median > 0 for t in timings)
    with pytest.raises(ValueError):
        benchmark.compare_variants({"a": lambda: spark.range(3), "b": lambda: spark.range(4)}, 1)
    assert "Range" in benchmark.plan_summary(spark.range(3).where("id > 1"))


def test_stream_of_files_accepts_each_key_once(spark, tmp_path):
    from foliate.streaming.layers import stream_layer

    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([(1, 1, 0, "a"), (2, 1, 1, "b")], SCHEMA)
    rules = ingest.Rules(key=("id",))
    for batch in (df, df.unionByName(spark.createDataFrame([(3, 1, 2, "c"), (2, 1, 1, "other")], SCHEMA))):
        batch.coalesce(1).write.mode("append").parquet(source)
        stream_layer(spark, source, df.schema, rules, target, str(tmp_path / "check")).awaitTermination()
    got = sorted((r.id, r.status[0]) for r in spark.read.parquet(target).collect())
    assert got == [(1, "a"), (1, "d"), (2, "a"), (2, "d"), (2, "q"), (3, "a")]
