"""Quality rules: a hashed n-gram log-likelihood ratio between trusted documents and the whole corpus.

Unigrams and bigrams of words are hashed into buckets. Two multinomials over the buckets, one of documents that labels
call good and one of all documents, give every bucket a log ratio, and a document's score is the sum of its n-grams' ratios
divided by its number of words. Every document is compared with one threshold: the lowest scores that trusted documents get
from the other half of the trusted documents, less a margin. Beside it stand two plain rules on length and repetition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.storage import drop
from .common import fresh_path, stash
from .neardup import maybe_in
from .words import Batch, slices, split, tidy, windows

BUCKETS = 1 << 16
SMOOTHING = 0.5
#: Trusted documents that are halved together, more or less.
GROUP_ROWS = 5000
#: The share of trusted documents that may score below the threshold, before the margin is taken off.
LOWEST_SHARE, MARGIN = 0.001, 0.05
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"

_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
#: Bytes that begin a character and are no white space.
_IS_LETTER = ((np.arange(256) & 0xC0) != 0x80) & ~np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


@dataclass(frozen=True)
class Model:
    """Log ratio of every bucket, and the threshold."""

    ratio: np.ndarray
    threshold: float


def _spread(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set between bounds."""
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return np.diff(sums[bounds])


def _again(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every item, whether its document has an equal one at all, and whether it has one earlier."""
    order = np.lexsort((hashes, doc)) if len(doc) else np.zeros(0, np.int64)
    same = (hashes[order][1:] == hashes[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    earlier = np.zeros(len(doc), bool)
    earlier[order[1:][same]] = True  # the sort is stable, so the first of equals comes first
    any_ = earlier.copy()
    any_[order[:-1][same]] = True
    return any_, earlier


def base_counts(b: Batch, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every text."""
    n = len(b.bounds) - 1
    three, starts = windows(hashes, b.first, 3)
    doc = np.repeat(np.arange(n), np.diff(starts))
    repeated, _ = _again(doc, three)
    covered = np.zeros(len(hashes), bool)
    at = np.arange(len(three)) - np.repeat(starts[:-1], np.diff(starts)) + np.repeat(b.first[:-1], np.diff(starts))
    for i in range(3):
        covered[at[repeated] + i] = True
    # Lines: cut at every line feed and at the texts' ends; those without a word don't count.
    feeds = np.flatnonzero(b.data == 10)
    begin = np.sort(np.concatenate((feeds + 1, b.bounds[:-1])))
    line_doc = np.searchsorted(b.bounds, begin, "right") - 1
    # A text may be empty, or end with a line feed; its empty last line has no word.
    text_end = np.sort(np.concatenate((feeds, b.bounds[1:])))
    has_word = np.searchsorted(b.start, text_end) > np.searchsorted(b.start, begin)
    begin, text_end, line_doc = begin[has_word], text_end[has_word], line_doc[has_word]
    _, earlier = _again(line_doc, b.span_hash(begin, text_end))
    return {
        "n_words": b.counts().astype(np.int64),
        "word_chars": _spread(_IS_LETTER[b.data], b.bounds),
        "n_symbols": _spread(_IS_SYMBOL[b.data], b.bounds),
        "n_dup_lines": np.bincount(line_doc[earlier], minlength=n).astype(np.int64),
        "n_repeat_words": _spread(covered, b.first),
    }


def _features(b: Batch, hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams, and the text of each."""
    two, starts = windows(hashes, b.first, 2)
    at = np.concatenate((hashes, two)) % np.uint64(buckets)
    return at.astype(np.int64), np.concatenate((b.doc(), np.repeat(np.arange(len(b.bounds) - 1), np.diff(starts))))


def _scores(b: Batch, hashes: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    at, doc = _features(b, hashes, len(ratio))
    return np.bincount(doc, ratio[at], minlength=len(b.bounds) - 1) / np.maximum(b.counts(), 1)


def _log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    share = lambda x: np.log((x + SMOOTHING) / (x.sum() + SMOOTHING * len(x)))
    return share(target) - share(raw) if target.sum() else np.zeros(len(raw))


def _halves(labels: DataFrame) -> DataFrame:
    """(id, fold) of every trusted document, one with quality 1 that isn't toxic: even halves in the order of its id's digest."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    good = good.select(F.col("doc_id").cast("long").alias("id")).distinct()
    group = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-good.count() // GROUP_ROWS))))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.md5(F.col("id").cast("string")), "id"))
    return good.select("id", ((place - 1) % 2).alias("fold"))


def _sortable(x: np.ndarray) -> np.ndarray:
    """Floats as integers of the same order; its own inverse on their bits."""
    bits = x.view(np.int64)
    return np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)


def _at_place(keys: DataFrame, place: int) -> int:
    """The key at a place of the ascending (key long), sixteen bits a pass: at most 65,536 counts come to the driver."""
    for shift in (48, 32, 16, 0):
        part = F.shiftright("key", shift)
        for value, n in sorted(map(tuple, keys.groupBy(part).agg(F.count("*")).collect())):
            if place < n:
                break
            place -= n
        keys = keys.where(part == value)
    return value


def _id_digest(doc_id: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))))


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> Model:
    """The model of all (doc_id, text), by labels (doc_id, quality, toxic).

    All documents are counted, and all trusted ones are used, those with quality 1 that aren't toxic; their texts are written
    to the shared folder until they are scored. What comes to the driver is a count for each bucket and, to find the
    threshold, counts of leading bits of the scores. Without a trusted document every score is 0 and the threshold is below it.
    """
    spark = docs.sparkSession
    trusted = stash(_halves(labels), "quality-trusted")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    maybe = maybe_in(trusted.select(_id_digest(F.col("id")).alias("digest")))  # only texts that may be trusted move
    # The same join at every size, so that disk and time grow in proportion.
    own = rows.where(maybe(_id_digest(F.col("doc_id")))).join(trusted.hint("merge"), F.col("doc_id") == F.col("id")).select("fold", "text")

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, buckets), np.int64)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            b = split(batch.column("text"))
            at, doc = _features(b, b.hashes(), buckets)
            fold = batch.column("fold").to_numpy()
            for i in range(3):
                sums[i] += np.bincount(at[fold[doc] == i], minlength=buckets)
        some = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(x[some]) for x in sums)], names=["bucket", "a", "b", "c"])

    @tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            b = split(batch.column("text"))
            at, doc = _features(b, b.hashes(), buckets)
            fold = batch.column("fold").to_numpy()
            scores = np.bincount(doc, folds[fold[doc], at], minlength=len(fold)) / np.maximum(b.counts(), 1)
            yield pa.RecordBatch.from_arrays([pa.array(_sortable(scores[b.counts() >= MIN_WORDS]))], names=["key"])

    path = fresh_path(spark, "quality-own")
    try:
        own.write.option("compression", "zstd").parquet(path)
        own = spark.read.schema(own.schema).parquet(path)
        # Every document counts as one of all, and a trusted one once more in its half.
        counted = rows.select(F.lit(2).alias("fold"), "text").unionByName(own).mapInArrow(count, "bucket long, a long, b long, c long")
        sums = np.zeros((3, buckets))
        for r in counted.groupBy("bucket").agg(*[F.sum(x).alias(x) for x in "abc"]).collect():  # at most a row a bucket
            sums[:, r.bucket] = r.a, r.b, r.c
        folds = np.stack([_log_ratio(sums[1], sums[2]), _log_ratio(sums[0], sums[2])])  # a half is scored by the other
        keys = stash(own.mapInArrow(score, "key long"), "quality-scores")
    finally:
        drop(spark, path)
    n, threshold = keys.count(), -1.0
    if n:
        lowest = np.array([_at_place(keys, int(LOWEST_SHARE * (n - 1)))], np.int64)
        threshold = float(_sortable(lowest.view(np.float64)).view(np.float64)[0]) - MARGIN
    return Model(_log_ratio(sums[0] + sums[1], sums[2]), threshold)


def _judge(texts: pa.Array, model: Model) -> dict[str, np.ndarray]:
    b = split(texts)
    hashes = b.hashes()
    out = base_counts(b, hashes)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    out["score"] = _scores(b, hashes, model.ratio)
    out["kept"] = ~out["base_failed"] & (out["score"] >= model.threshold)
    return out


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) to doc_id, the base counts, base_failed, score, threshold and kept, a row a document.

    A null text has no words and fails; so does an empty one. Long texts are read whole. Repeated rows are judged each,
    equal texts alike. Empty tables give no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the buckets, whatever the corpus
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            found = _judge(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[n]) for n in names)], names=["doc_id", *names])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"
    return rows.mapInArrow(run, schema).withColumn("threshold", F.lit(model.threshold))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, place)):
            yield batch.filter(pa.array(_judge(batch.column(place), shared.value)["kept"]))

    return docs.mapInArrow(run, docs.schema)
