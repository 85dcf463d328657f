"""Mixing sources to target weights by weighted fair queueing.

Every source is a flow; its documents, shuffled by a keyed hash, queue up to `max_epochs` times over. A document's
virtual finish time is the number of its source's words up to and including it, divided by the source's share. All
queues are served in order of finish time, so at any moment each source has been served in proportion to its share, and
the service stops at the total budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, stash

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
#: Documents that one task orders at a time.
BUCKET_ROWS = 2_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """Rows of (source, source_size) to (source, source_size, rank, target): water filling.

    The i-th source by code point (null last) weighs weights[i mod n]. The budget, `share` of all sizes, is dealt by
    weight; where a target passes max_epochs times its source's size it stops there and the rest is dealt again. With the
    sources sorted by cap / weight, the ones that stop are a prefix, so a running sum finds the level in closed form. A
    source has one row here, so this table is tiny next to the documents.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    up = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    level = (
        ranked.withColumn("budget", F.sum(F.col("source_size")).over(everything) * F.lit(float(share)))
        .withColumn("stopped", F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("stopped")) / F.col("open_weight"))
        .withColumn("is_open", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("final", F.max(F.when(F.col("is_open"), F.col("level"))).over(everything))
    )
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("weight")))
    return level.select("source", "source_size", "rank", target.alias("target"))


def _running(rows: DataFrame, keys: list[str], order: list[Column], size: str, out: str) -> DataFrame:
    """out: the sum of size up to and including each row, over the buckets of its key (all but the last of keys) in order.

    Buckets are summed first (a row per bucket), then prefix sums over buckets are joined back, so that no task holds more
    than a bucket, however large the key is.
    """
    sums = rows.groupBy(*keys).agg(F.sum(size).alias("__sum"))
    before = Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(offsets, keys).withColumn(out, F.col("__before") + F.sum(size).over(within)).drop("__before")


def _shuffled(doc_id: Column, text: Column, seed: int) -> Column:
    """The place in its source's queue: a keyed hash of a document's id and text."""
    return F.md5(F.concat_ws("/", F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(str(seed)), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))))


def fair_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 20250, share: float = 1.0) -> DataFrame:
    """(doc_id, source, text) to one row a document: __doc_id, __source, size, source_size, target, repeats, taken, __h.

    Documents queue in the order of a hash of doc_id and text, so rows without an id are spread like others. Rows that repeat
    with both are interchangeable: they stand next to each other in the queue and share out what they are taken. Texts that are null
    or have no word have size 0 and are taken 0 times. Columns other than doc_id, source and text are not looked at. No
    rows in, no rows out. Finish times are compared as doubles, ties by source, round and hash. The result depends on the
    rows alone, so reruns agree. A document goes in whole, up to max_epochs times: each source ends within one document
    of its target.
    """
    rows = docs.select(F.col("doc_id").alias("d"), F.col("source").alias("source"), n_words(F.col("text")).alias("size"), _shuffled(F.col("doc_id"), F.col("text"), seed).alias("h"))
    rows = stash(rows, "mix-sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = source_targets(sources.select("source", "source_size"), weights, max_epochs, share)
    targets = stash(targets.join(sources.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix-targets")
    total = targets.agg(F.sum("target")).first()[0] or 0.0

    # The words of each source up to each document, in hash order; the hash is uniform, so its leading digits are even buckets.
    placed = rows.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    buckets = F.ceil(F.col("n") / BUCKET_ROWS)
    placed = placed.withColumn("bucket", (F.conv(F.substring("h", 1, 7), 16, 10).cast("long") * buckets / (1 << 28)).cast("long"))
    cum = _running(placed, ["rank", "bucket"], [F.col("h"), F.col("d"), F.col("size")], "size", "cum")
    cum = stash(cum.select("d", "source", "size", "h", "source_size", "rank", "target", "cum"), "mix-queues")

    # Rounds of a source follow each other. What starts before virtual time 1, the end of the budget, is all that can be
    # served: everything that also ends by then fits the budget, and the one document a source that straddles it comes after.
    rounds = cum.where((F.col("size") > 0) & (F.col("target") > 0)).withColumn("round", F.explode(F.array(*[F.lit(i) for i in range(max_epochs)])))
    finish = (F.col("round") * F.col("source_size") + F.col("cum")) / F.col("target")
    rounds = rounds.withColumn("finish", finish).where(F.col("finish") - F.col("size") / F.col("target") < 1.0)

    # Words are even over virtual time by construction, so equal slices of it are the splitters of the global range sort.
    slices = max(1, round(cum.count() / BUCKET_ROWS))
    rounds = rounds.withColumn("slice", F.least(F.floor(F.col("finish") * slices), F.lit(slices)).cast("long")).withColumn("all", F.lit(0))
    order = [F.col("finish"), F.col("rank"), F.col("round"), F.col("h"), F.col("d")]
    served = _running(rounds.select("d", "h", "size", "rank", "round", "finish", "slice", "all"), ["all", "slice"], order, "size", "served")
    taken = served.where(F.col("served") <= F.lit(total + 1e-6)).groupBy("rank", "h", "size").agg(F.count("*").alias("k"))
    # Repeated rows share a key here: they finish one after another, so the k rounds are dealt to them in turn.
    turn = Window.partitionBy("rank", "h", "size").orderBy("cum")
    same = Window.partitionBy("rank", "h", "size")
    out = cum.withColumn("i", F.row_number().over(turn) - 1).withColumn("m", F.count("*").over(same)).join(taken, ["rank", "h", "size"], "left")
    repeats = F.floor((F.coalesce("k", F.lit(0)) + F.col("m") - 1 - F.col("i")) / F.col("m")).cast("long")
    return out.select(F.col("d").alias("__doc_id"), F.col("source").alias("__source"), "size", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).alias("taken"), F.col("h").alias("__h"))


def repeat_rows(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 20250) -> DataFrame:
    """docs with every row as often as the mix takes it, all columns as they are.

    Each source is served its queue in order, so what is taken of it are whole rounds and then the rows up to some hash: a
    row a source tells that to all, and no text moves. Where the service ends among rows that repeat with one doc_id, source
    and text, the first of them get the last round.
    """
    mixed = stash(fair_mix(docs.select("doc_id", "source", "text"), weights, max_epochs, seed).where("size > 0").select("__source", "__h", "repeats"), "mix-repeats")
    last = F.max(F.struct("repeats", "__h"))
    cuts = mixed.groupBy(F.col("__source").alias("s")).agg(F.min("repeats").alias("full"), last["repeats"].alias("most"), last["__h"].alias("cut"))
    at_cut = mixed.join(cuts, F.col("__source").eqNullSafe(F.col("s")) & (F.col("__h") == F.col("cut"))).groupBy(F.col("s").alias("c")).agg(F.count_if(F.col("repeats") == F.col("most")).alias("served"), F.count("*").alias("of"))
    cuts = stash(cuts.join(at_cut, F.col("s").eqNullSafe(F.col("c"))).drop("c"), "mix-cuts")
    # The rows go along as one column, so that no name of theirs meets one of these.
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").alias("source"), n_words(F.col("text")).alias("size"), _shuffled(F.col("doc_id"), F.col("text"), seed).alias("h"))
    joined = whole.where("size > 0").join(cuts, F.col("source").eqNullSafe(F.col("s")))
    split = (F.col("h") == F.col("cut")) & (F.col("served") < F.col("of"))
    clear = joined.where(~split).withColumn("k", F.when(F.col("h") <= F.col("cut"), F.col("most")).otherwise(F.col("full")))
    turn = F.row_number().over(Window.partitionBy("s").orderBy("row.doc_id"))
    shared = joined.where(split).withColumn("k", F.when(turn <= F.col("served"), F.col("most")).otherwise(F.col("most") - 1))
    return clear.unionByName(shared).withColumn("i", F.explode(F.array_repeat(F.lit(0), F.col("k").cast("int")))).select("row.*")
