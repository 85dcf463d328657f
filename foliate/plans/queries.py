"""The engine's queries over the driver's tables: (spark, sf_dir) to a DataFrame."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, fulltext, parsing, trigrams
from ..operators import graph, ingest, profile
from ..operators.storage import MaterializedView, shared_dir, written
from ..sources.journal import error_category
from ..sources.tables import load, manifest
from ..vocab import MODELS, PARSE_STATUS, id_of

FUZZY_THRESHOLD, STRICT_THRESHOLD, NAME_THRESHOLD = 0.6, 0.5, 0.5
#: Searched words: near names of parts only; near names and types; too far from whole words; near by whole words only.
FUZZY_WORDS = ("gizmoo", "smal", "widgt", "economxy")


# Full text


def _sections(docs: DataFrame) -> DataFrame:
    """Chunks of documents: their lines."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    return lines


def fulltext_ids(docs: DataFrame, chunks: DataFrame, query: str) -> DataFrame:
    """Ids of documents that match, themselves or in a chunk."""
    own = docs.where(fulltext.matches_text(F.col("text"), query)).select("doc_id")
    parts = chunks.where(fulltext.matches_text(F.col("content"), query)).select("doc_id")
    return own.unionByName(parts).distinct()


def q1_fulltext(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return fulltext_ids(docs, _sections(docs), "air").orderBy("doc_id")


def q1_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    ids = q1_fulltext(spark, d)
    return ids.agg(F.sha2(F.expr("listagg(cast(doc_id as string), ', ') within group (order by doc_id)"), 256).alias("fingerprint"), F.count("*").alias("n"))


def _matching_lines(spark: SparkSession, d: str, word: str) -> DataFrame:
    lines = _sections(load(spark, d, "documents"))
    return lines.where(fulltext.matches_text(F.col("content"), word)).select("doc_id", "chunk_index").orderBy("doc_id", "chunk_index")


def c1_fulltext_lines(spark: SparkSession, d: str) -> DataFrame:
    return _matching_lines(spark, d, "air")


def c1_fulltext_flight(spark: SparkSession, d: str) -> DataFrame:
    return _matching_lines(spark, d, "flight")


def c1_substring(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").where(F.col("text").ilike("%air%")).select("doc_id", "source").orderBy("doc_id")


def _first_documents(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred documents, with a default for a null source."""
    return load(spark, d, "documents").select("doc_id", "source").orderBy("doc_id").limit(100).fillna({"source": "gemini"})


def c1_sample_documents(spark: SparkSession, d: str) -> DataFrame:
    """The sample's documents with the ids of their sources, which have to be known, and the rows of theirs that were written."""
    lookup = ingest.lookup_ids(load(spark, d, "documents").select(F.coalesce("source", F.lit("gemini")).alias("label")))
    sample, unknown = ingest.resolve_label(_first_documents(spark, d), "source", lookup, "source_id")
    sample = ingest.fail_on(sample, unknown)
    return written(sample.select("doc_id", "source", "source_id"), "sample-documents")


def c1_sample_semi(spark: SparkSession, d: str) -> DataFrame:
    return written(load(spark, d, "labels").join(_first_documents(spark, d), "doc_id", "left_semi").select("doc_id", "quality"), "sample-labels")


def text_vector_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """Lexemes of short texts; texts over a byte limit have none."""
    docs = load(spark, d, "benchmark")
    v = fulltext.text_vector(F.col("text"), 400)
    return docs.select("item_id", (F.octet_length("text") > 400).alias("too_large"), F.size(v).alias("n"), "text").select("item_id", "too_large", (F.col("n") > 0).alias("has_vector"))


# Fuzzy words


def _names(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id"))


def fuzzy_search(documents: DataFrame, chunks: DataFrame, word: str, threshold: float = FUZZY_THRESHOLD, strict_threshold: float = STRICT_THRESHOLD) -> DataFrame:
    """Documents (id, full_text) that are near a word, themselves or in a chunk (document_id, content), the best score of each.

    A text of a document is near if some part of it is, by `threshold`; a chunk if some of its whole words are, by
    `strict_threshold`. The score is the similarity to any part for both.
    """
    scored = lambda df, key, text: df.where(trigrams.shares_trigram(word, F.col(text))).select(F.col(key).alias("id"), F.col(text).alias("near"), trigrams.word_similarity(word, F.col(text)).alias("score"))
    own = scored(documents, "id", "full_text").where(F.col("score") >= F.lit(threshold).cast("float"))
    whole = trigrams.word_similarity(word, F.col("near"), True)
    parts = scored(chunks, "document_id", "content").where(whole >= F.lit(strict_threshold).cast("float"))
    best = own.unionByName(parts).groupBy("id").agg(F.max("score").alias("score"))
    found = best.join(documents, "id").select("id", F.round(F.col("score").cast("double"), 5).alias("score"), "full_text")
    return found.withColumns({"similarity_threshold": F.lit(threshold), "searched": F.lit(word), "method": F.lit("word_similarity")})


def q2_fuzzy_words(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts near some words, themselves or by the types that parts of the name have."""
    names = _names(spark, d).select("id", F.col("p_name").alias("full_text"))
    types = load(spark, d, "part").select("p_name", F.concat_ws(" ", "p_type", "p_brand").alias("content")).distinct()
    chunks = types.join(_names(spark, d).withColumnRenamed("id", "document_id"), "p_name").select("document_id", "content")
    found = reduce(DataFrame.unionByName, [fuzzy_search(names, chunks, w) for w in FUZZY_WORDS])
    return found.orderBy("searched", F.col("score").desc(), "id")


def name_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of every similar pair of names."""
    names = _names(spark, d).select("id", F.lower("p_name").alias("name"))
    pairs = trigrams.similar_pairs(names, "id", "name", NAME_THRESHOLD)
    a, b = names.toDF("a", "name_a"), names.toDF("b", "name_b")
    score = trigrams.similarity(trigrams.trigrams(F.col("name_a")), trigrams.trigrams(F.col("name_b")))
    return pairs.join(a, "a").join(b, "b").select("name_a", "name_b", F.round(score.cast("double"), 5).alias("similarity"))


def q4_entity_groups(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem").select("l_partkey", (F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount"))
    items = lines.join(load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    groups = graph.similar_name_groups(items, "p_name", "amount", NAME_THRESHOLD)
    return groups.select(F.array_join("names", "|").alias("names"), F.col("total_amount").cast("decimal(38,2)").alias("total_amount"), F.col("n").alias("transactions_count")).orderBy(F.col("total_amount").desc())


# Graph, provenance, JSON


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers to their nations, nations to their regions."""
    edge = lambda df, a, x, b, y, kind: df.select(F.concat(F.lit(kind), F.col(x).cast("string")).alias("id"), F.concat(F.lit(a), F.col(x).cast("string")).alias("source_id"), F.concat(F.lit(b), F.col(y).cast("string")).alias("target_id"))
    return reduce(DataFrame.unionByName, [edge(load(spark, d, "customer"), "c", "c_custkey", "n", "c_nationkey", "cn"), edge(load(spark, d, "supplier"), "s", "s_suppkey", "n", "s_nationkey", "sn"), edge(load(spark, d, "nation"), "n", "n_nationkey", "r", "n_regionkey", "nr")])


def q3_two_hop(spark: SparkSession, d: str) -> DataFrame:
    return graph.two_hop_paths(_edges(spark, d)).orderBy("start_node_id", "middle_node_id", "end_node_id")


def _processed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Processed files, the models that each file was given to, and the models' names.

    Every event is a file; it went to one or two models that follow from its user and its number.
    """
    events = load(spark, d, "events")
    files = events.select(F.col("event_id").alias("file_id"), F.col("ts").alias("processed_at"))
    given = F.array_distinct(F.array((F.col("user_id") % 8 + 1).cast("int"), (F.col("event_id") % 3 + 1).cast("int")))
    bridge = events.select(F.col("event_id").alias("file_id"), F.explode(given).alias("model_id")).where("model_id is not null")
    return files, bridge, model_names(spark)


def model_names(spark: SparkSession) -> DataFrame:
    """The vocabulary of models as a table (model_id, model_name), of eight rows."""
    return spark.createDataFrame([(number, name) for name, number in MODELS.items()], "model_id int, model_name string")


def _model_links(files: DataFrame, bridge: DataFrame, models: DataFrame) -> DataFrame:
    """A row for each processed file and model: files to bridge to lookup. The lookup is a closed vocabulary, so it is sent."""
    dated = files.where("processed_at is not null").select("file_id", F.to_date("processed_at").alias("processing_date"))
    return dated.join(bridge, "file_id").join(F.broadcast(models), "model_id")


def daily_models(files: DataFrame, bridge: DataFrame, models: DataFrame) -> DataFrame:
    """For each day the models that files were given to, sorted, and the number of these files."""
    per = _model_links(files, bridge, models).groupBy("processing_date")
    return per.agg(F.array_join(F.sort_array(F.collect_set("model_name")), ",").alias("models"), F.count_distinct("file_id").alias("files"))


def daily_links(files: DataFrame, bridge: DataFrame, models: DataFrame) -> DataFrame:
    """The same with the number of links in place of files."""
    per = _model_links(files, bridge, models).groupBy("processing_date")
    return per.agg(F.array_join(F.sort_array(F.collect_set("model_name")), ",").alias("models"), F.count("*").alias("links"))


def q5_daily_models(spark: SparkSession, d: str) -> DataFrame:
    return daily_models(*_processed(spark, d)).orderBy("processing_date")


def q5_mv(spark: SparkSession, d: str) -> DataFrame:
    """The daily aggregate from a materialised view."""
    return MaterializedView(spark, f"{shared_dir(spark)}/daily-{uuid.uuid4().hex}", lambda: daily_links(*_processed(spark, d))).refresh()


def q5_mv_refresh(spark: SparkSession, d: str) -> DataFrame:
    """The same after ten files with 21 links came and the view was refreshed; the view before shows them not yet."""
    files, bridge, models = _processed(spark, d)
    new_files = spark.range(10).select((-1 - F.col("id")).alias("file_id"), F.expr("timestamp_ntz'2026-10-10 12:00:00'").alias("processed_at"))
    new_links = spark.range(21).select((-1 - F.col("id") % 10).alias("file_id"), (F.col("id") % 7 + 1).cast("int").alias("model_id"))
    source = {"files": files, "bridge": bridge}
    view = MaterializedView(spark, f"{shared_dir(spark)}/daily-new-{uuid.uuid4().hex}", lambda: daily_links(source["files"], source["bridge"], models))
    before = view.refresh()
    if not before.where("processing_date = date'2026-10-10'").isEmpty():
        raise AssertionError("the new rows can't be there yet")
    source |= {"files": files.unionByName(new_files), "bridge": bridge.unionByName(new_links)}
    return view.refresh().orderBy("processing_date")


HIDDEN = ("%REDACTED%", r"%\_\_\_\_%")


def email_documents(documents: DataFrame, statuses: DataFrame, raw: str, keys: tuple[str, ...] = ("subject", "from", "to")) -> DataFrame:
    """Documents (with a JSON text `raw` and its outcome `status_id`) whose JSON was read, by the lookup of outcomes (id,
    label), and of which no value of `keys` is absent or hidden. An absent value counts as unknown and drops the row.
    """
    read = documents.join(F.broadcast(statuses.where("label = 'success'").select(F.col("id").alias("status_id"))), "status_id")
    for key in keys:
        value = F.get_json_object(raw, f"$.{key}")
        read = read.where(reduce(lambda a, b: a & b, [~value.ilike(p) for p in HIDDEN]))
    return read


def _emails(spark: SparkSession, d: str) -> DataFrame:
    """Documents with e-mail fields made from their columns: some not JSON, some without a field, some hidden."""
    n = F.col("doc_id")
    whole = F.concat(F.lit('{"subject":"'), "lang", F.lit('","from":"'), "source", F.lit('","to":"n'), n.cast("string"), F.lit('"}'))
    raw = (
        F.when(n % 7 == 0, '{"subject":').when(n % 9 == 0, None).when(n % 13 == 0, '{"subject":"s","from":"f"}').when(n % 5 == 0, '{"subject":"re: Redacted","from":"a","to":"b"}')
        .when(n % 11 == 0, '{"subject":"s","from":"a____b","to":"c"}').when(n % 17 == 0, '["subject","from","to"]').when(n % 19 == 0, '{"subject":"a_b","from":null,"to":"c"}').otherwise(whole)
    )
    return load(spark, d, "documents").select("doc_id", raw.alias("email_fields"))


def q6_json_filter(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose e-mail fields were read and hide neither subject nor sender nor recipient."""
    statuses = spark.createDataFrame(list(PARSE_STATUS.items()), "label string, id smallint")
    mails = _emails(spark, d).withColumn("status_id", id_of(parsing.json_status(F.col("email_fields")), PARSE_STATUS))
    return email_documents(mails, statuses, "email_fields").select("doc_id", "email_fields")


def json_filter_events(spark: SparkSession, d: str) -> DataFrame:
    """Events whose JSON has a value that none of several patterns hits; a missing value counts as unknown and drops the row."""
    events = load(spark, d, "events")
    value = F.get_json_object("props", "$.k")
    good = parsing.json_status(F.col("props"), "object") == "success"
    hit = value.ilike("%7%") | value.ilike(r"%\_\_\_\_%")
    return events.where(good & ~hit).select("event_id", "props")


def json_filter_native(spark: SparkSession, d: str) -> DataFrame:
    """The same predicate as one built-in expression, for trusted JSON: nothing leaves the JVM."""
    return load(spark, d, "events").where(r"get_json_object(props, '$.k') NOT ILIKE ALL ('%7%', '%\\_\\_\\_\\_%')").select("event_id", "props")


# Profiles


def profile_columns(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return profile.column_profile(load(spark, d, name))

    return query


def profile_categories(name: str, column: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return profile.category_counts(load(spark, d, name), column)

    return query


def distinct_keys(spark: SparkSession, d: str) -> DataFrame:
    return profile.distinct_values(load(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderpriority"])


def reference_check(child: str, column: str, parent: str, key: str, keep: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return profile.reference_coverage(load(spark, d, child), column, load(spark, d, parent).where(keep), key)

    return query


def orphan_rows(spark: SparkSession, d: str) -> DataFrame:
    return profile.orphans(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], load(spark, d, "lineitem").where("l_quantity < 40"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_quantity")


def candidate_keys(spark: SparkSession, d: str) -> DataFrame:
    return profile.candidate_key(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def json_types(spark: SparkSession, d: str) -> DataFrame:
    return profile.json_types(load(spark, d, "events"), "props")


def _order_notations(spark: SparkSession, d: str) -> DataFrame:
    """Order dates in several notations, by key."""
    orders = load(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    forms = ["yyyy-MM-dd", "MM/dd/yyyy", "M.d.yyyy", "MMddyyyy", "MMMM d, yyyy", "dd MMM yyyy", "yyyy", "MMM yyyy"]
    raw = F.lit(None).cast("string")
    for i, f in enumerate(forms):
        raw = F.when(F.col("o_orderkey") % 9 == i, F.date_format("day", f)).otherwise(raw)
    return orders.withColumn("raw", F.when(F.col("o_orderkey") % 9 == 8, F.lit("13/13/2000")).otherwise(raw))


def date_shapes(spark: SparkSession, d: str) -> DataFrame:
    return profile.date_shapes(_order_notations(spark, d), "raw")


def parse_dates(spark: SparkSession, d: str) -> DataFrame:
    parsed = dates.with_parsed(_order_notations(spark, d), "raw")
    value, status, _ = dates.as_kind(F.col("__parsed"), F.col("raw"), "date")
    return parsed.select("o_orderkey", value.alias("day"), status.alias("status"))


def parse_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Amounts to ten decimals; what isn't finite is rejected."""
    amount = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") / F.lit(1024.0)).otherwise(F.col("o_totalprice"))
    orders = load(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, F.lit(float("nan"))).when(F.col("o_orderkey") % 10 == 1, F.lit(float("-inf"))).otherwise(amount).alias("raw"))
    value, bad = parsing.amount(F.col("raw"))
    return orders.select("o_orderkey", value.cast("string").alias("amount"), bad.alias("rejected"))


def parse_hashes(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 5 == 0, F.lit("ab")).when(F.col("c_custkey") % 5 == 1, F.lit("")).when(F.col("c_custkey") % 5 == 2, F.lit(None)).otherwise(F.upper(F.sha2("c_name", 256)))
    value, status = parsing.hash_bytes(F.col("raw"))
    return load(spark, d, "customer").select("c_custkey", raw.alias("raw")).select("c_custkey", F.lower(F.hex(value)).alias("hash"), status.alias("status"))


def parse_models(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    raw = F.when(k % 4 == 0, " gpt-5-nano,deepseek-chat,gpt-5-nano,unlisted ").when(k % 4 == 1, "unlisted").when(k % 4 == 2, "gpt-4o-mini, gpt-5-nano")
    known, status, unknown = parsing.model_list(F.col("raw"))
    return load(spark, d, "supplier").select("s_suppkey", raw.alias("raw")).select("s_suppkey", F.array_join(parsing.model_ids(known).cast("array<string>"), ",").alias("ids"), status.alias("status"), F.array_join(unknown, ",").alias("unknown"))


def label_forms(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").select(parsing.capitalize(F.col("c_mktsegment")).alias("label"), parsing.ocr_source(F.when(F.col("c_nationkey") > 9, F.col("c_mktsegment"))).alias("source")).distinct()


# Ingest


def lookup_ids(spark: SparkSession, d: str) -> DataFrame:
    docs, orders = load(spark, d, "documents"), load(spark, d, "orders")
    labels = docs.select(F.col("lang").alias("label")).unionByName(docs.select(F.col("source").alias("label"))).unionByName(orders.select(F.col("o_orderpriority").alias("label")))
    return ingest.lookup_ids(labels)


LINE_RULES = ingest.Rules(key=("l_orderkey", "l_linenumber"), required=("l_partkey",), checks={"quantity below 50": "l_quantity < 50"})


def _classified_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = ingest.with_place(spark.read.parquet(f"{d}/lineitem.parquet"))
    return ingest.classify(lines, LINE_RULES)


def ingest_accounting(spark: SparkSession, d: str) -> DataFrame:
    return ingest.account(_classified_lines(spark, d), ())


def ingest_accepted(spark: SparkSession, d: str) -> DataFrame:
    return _classified_lines(spark, d).where("status = 'accepted'").select("l_orderkey", "l_linenumber", "l_partkey", F.col("source_row").cast("long").alias("source_row"))


def ingest_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _classified_lines(spark, d).groupBy("status", "reason").agg(F.count("*").alias("n"))


def ordinals(spark: SparkSession, d: str) -> DataFrame:
    rows = ingest.ordinals(ingest.with_place(spark.read.parquet(f"{d}/supplier.parquet")))
    return rows.select("s_suppkey", F.col("source_ordinal").cast("long").alias("source_ordinal"))


def resolve_references(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their customers, of which some weren't accepted."""
    parents = load(spark, d, "customer").where("c_acctbal > 0")
    joined, status, _ = ingest.resolve_parent(load(spark, d, "orders"), "o_custkey", parents, "c_custkey", "c_custkey", "customer_id")
    return joined.select("o_orderkey", "customer_id", status.alias("match_status"))


def required_references(spark: SparkSession, d: str) -> DataFrame:
    """Orders that are rejected as their customer wasn't accepted, with the reason."""
    parents = load(spark, d, "customer").where("c_acctbal > 0")
    joined, _, reason = ingest.resolve_parent(load(spark, d, "orders"), "o_custkey", parents, "c_custkey", "c_custkey", "customer_id", required=True)
    return joined.where(reason.isNotNull()).select("o_orderkey", reason.alias("reason"))


def resolve_labels(spark: SparkSession, d: str) -> DataFrame:
    """Orders with the ids of their priorities, of which the lookup lacks one."""
    orders = load(spark, d, "orders")
    lookup = ingest.lookup_ids(orders.where("o_orderpriority <> '5-LOW'").select(F.col("o_orderpriority").alias("label")))
    joined, reason = ingest.resolve_label(orders, "o_orderpriority", lookup, "priority_id")
    return joined.select("o_orderkey", "priority_id", reason.alias("reason"))


def ingest_rerun(spark: SparkSession, d: str) -> DataFrame:
    """The accounts of reading lines again that were accepted before: all of them are duplicates."""
    lines = ingest.with_place(spark.read.parquet(f"{d}/lineitem.parquet"))
    stored = _classified_lines(spark, d).where("status = 'accepted'").drop("status", "reason")
    return ingest.account(ingest.classify(lines, LINE_RULES, written(stored, "accepted-lines")), ())


def ingest_two_keys(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers under two unique keys: a row with a stored supplier's number and one with another's name collide."""
    rows = ingest.with_place(spark.read.parquet(f"{d}/supplier.parquet"))
    key = F.col("s_suppkey")
    rows = rows.withColumn("s_name", F.when(key % 10 == 3, F.concat(F.lit("Supplier#"), F.lpad((key - 1).cast("string"), 9, "0"))).otherwise(F.col("s_name")))
    rules = ingest.Rules(key=("s_suppkey",), unique=(("s_name",),))
    stored = rows.where("s_suppkey % 10 = 5").drop("source_file", "source_row").withColumn("s_acctbal", F.when(F.col("s_suppkey") % 20 == 5, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")))
    return ingest.classify(rows, rules, stored).select("s_suppkey", "status", "reason")


def import_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Categories of diagnostics, counted: dates and references of orders as an import would tell of them."""
    orders = dates.with_parsed(_order_notations(spark, d), "raw")
    day, status, _ = dates.as_kind(F.col("__parsed"), F.col("raw"), "date")
    orders = orders.select(F.lit("f").alias("source_file"), F.col("o_orderkey").alias("source_row"), "raw", status.alias("status"))
    told = ingest.diagnostics(orders, "orders", {"event_date": ("parse", F.col("status"), F.col("raw"))})
    parents = load(spark, d, "customer").where("c_acctbal > 0")
    joined, match, _ = ingest.resolve_parent(load(spark, d, "orders"), "o_custkey", parents, "c_custkey", "c_custkey", "customer_id")
    joined = joined.select(F.lit("f").alias("source_file"), F.col("o_orderkey").alias("source_row"), "o_custkey", match.alias("status"))
    told = told.unionByName(ingest.diagnostics(joined, "orders", {"o_custkey": ("match", F.col("status"), F.col("o_custkey"))}))
    return told.groupBy(error_category().alias("category"), "column", "status").agg(F.count("*").alias("n"))


def manifest_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of three tables, as the manifest of their files has them; it is an error if one has no digest or no bytes."""
    found = manifest(spark, [f"{d}/{t}.parquet" for t in ("nation", "orders", "pages")])
    sound = (F.length("sha256") == 64) & (F.col("bytes") > 0)
    rows = F.when(sound, F.col("rows")).otherwise(F.raise_error(F.lit("no digest"))).cast("long")
    return found.groupBy(F.element_at(F.split("file", "/"), 1).alias("file")).agg(F.sum(rows).alias("rows"))


def overview(spark: SparkSession, d: str) -> DataFrame:
    """Shape, columns and first five rows of the orders, a line of text each."""
    return profile.overview(load(spark, d, "orders"), ["o_orderkey"], 5)


QUERIES = {
    "q1_fulltext": q1_fulltext,
    "q1_fingerprint": q1_fingerprint,
    "c1_fulltext_lines": c1_fulltext_lines,
    "c1_fulltext_flight": c1_fulltext_flight,
    "c1_sample_documents": c1_sample_documents,
    "c1_substring": c1_substring,
    "c1_sample_semi": c1_sample_semi,
    "text_vector_cutoff": text_vector_cutoff,
    "q2_fuzzy_words": q2_fuzzy_words,
    "name_similarity": name_similarity,
    "q3_two_hop": q3_two_hop,
    "q4_entity_groups": q4_entity_groups,
    "q5_daily_models": q5_daily_models,
    "q5_mv": q5_mv,
    "q5_mv_refresh": q5_mv_refresh,
    "q6_json_filter": q6_json_filter,
    "json_filter_events": json_filter_events,
    "json_filter_native": json_filter_native,
    "profile_columns_documents": profile_columns("documents"),
    "profile_columns_orders": profile_columns("orders"),
    "profile_columns_lineitem": profile_columns("lineitem"),
    "profile_categories_lang": profile_categories("documents", "lang"),
    "profile_categories_source": profile_categories("documents", "source"),
    "profile_categories_priority": profile_categories("orders", "o_orderpriority"),
    "distinct_keys": distinct_keys,
    "reference_check_labels": reference_check("labels", "doc_id", "documents", "doc_id", "n_chars > 500"),
    "reference_check_orders": reference_check("orders", "o_custkey", "customer", "c_custkey", "c_acctbal > 0"),
    "reference_check_lineitem": reference_check("lineitem", "l_partkey", "part", "p_partkey", "p_size > 10"),
    "orphan_rows": orphan_rows,
    "candidate_keys": candidate_keys,
    "json_types": json_types,
    "date_shapes": date_shapes,
    "parse_dates": parse_dates,
    "parse_amounts": parse_amounts,
    "parse_hashes": parse_hashes,
    "parse_models": parse_models,
    "label_forms": label_forms,
    "lookup_ids": lookup_ids,
    "ingest_accounting": ingest_accounting,
    "ingest_accepted": ingest_accepted,
    "ingest_reasons": ingest_reasons,
    "ordinals": ordinals,
    "resolve_references": resolve_references,
    "required_references": required_references,
    "resolve_labels": resolve_labels,
    "ingest_rerun": ingest_rerun,
    "ingest_two_keys": ingest_two_keys,
    "import_diagnostics": import_diagnostics,
    "manifest_rows": manifest_rows,
    "overview": overview,
}
