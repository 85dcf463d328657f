"""Near-duplicate detection by improved consistent weighted sampling.

A text is a set of five-word shingles weighted by TF-IDF. Improved consistent weighted sampling (Ioffe 2010) draws, for each of
a set of hash functions, one shingle and a level of its weight, so that two texts draw the same with a probability equal to
their weighted Jaccard similarity. Samples are banded; texts that agree on a whole band are candidates and are verified by
the exact weighted Jaccard similarity of their whole texts. Linked texts form classes.

Inverse document frequencies are the same for all shingles in fewer than one of `RARE` documents, so the exact ones of the
few others, of which there can be at most RARE times the shingles of a mean document, are all that tasks must know.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash
from .components import components
from .words import Batch, mix, slices, split, tidy, windows

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 12, 4
#: A shingle in at most one of so many documents has the largest weight.
RARE = 100
#: Rows and bytes of texts that are compared with as many others in one task.
BLOCK_ROWS, BLOCK_BYTES = 512, 4 << 20
#: 64-bit words of the filter that spares texts a join: about eight bits a key, and no more than these, past which it lets
#: more and more texts through that it needn't.
LEAST_WORDS, MOST_WORDS = 1 << 10, 1 << 19
#: Documents over which a task looks for frequent shingles at a time.
CHUNK_DOCS = 2000

_rng = np.random.Generator(np.random.PCG64(90210))
_ODD = _rng.integers(0, 1 << 62, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_LEVELS = 1 << 16


def _gamma_table() -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution, whose distribution function is 1 - (1 + x) exp(-x), by bisection."""
    u = (np.arange(_LEVELS) + 0.5) / _LEVELS
    low, high = np.zeros(_LEVELS), np.full(_LEVELS, 64.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < u
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


_GAMMA = _gamma_table()
_R, _LOG_C = _GAMMA.astype(np.float32), np.log(_GAMMA).astype(np.float32)
_BETA = ((np.arange(_LEVELS) + 0.5) / _LEVELS).astype(np.float32)


@dataclass(frozen=True)
class Weights:
    """Hashes of the frequent shingles, sorted, and their inverse document frequencies; the others have `rare`."""

    hashes: np.ndarray
    idf: np.ndarray
    rare: float

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), self.rare)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.idf[at], self.rare)


def idf(share: np.ndarray | float, rare: int = RARE) -> np.ndarray:
    """1 for a shingle of all documents, 2 for one in at most one of `rare`; in between it follows the logarithm."""
    return 1 + np.log(np.minimum(1 / np.asarray(share), rare)) / np.log(rare)


def shingles(b: Batch) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every shingle; a text of one to four words is one shingle, one without words has none."""
    hashes = b.hashes()
    found, starts = windows(hashes, b.first, WORDS)
    doc = np.repeat(np.arange(len(b.bounds) - 1), np.diff(starts))
    n = b.counts()
    short = np.flatnonzero((n > 0) & (n < WORDS))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for i in range(WORDS - 1):
            has = n[short] > i
            whole[has] = mix(whole[has] * np.uint64(3) + hashes[b.first[short[has]] + i])
        order = np.argsort(doc := np.concatenate((doc, short)), kind="stable")
        return doc[order], np.concatenate((found, whole))[order]
    return doc, found


def weighted_sets(texts: pa.Array, weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, weight) of every different shingle of every text, by text."""
    doc, hashes = shingles(split(texts, lower=True))
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1]))) if len(doc) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    count = np.diff(np.concatenate((at, [len(doc)])))
    return doc[at], hashes[at], count * weights.of(hashes[at])


def sample(doc: np.ndarray, hashes: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """The samples of n sets, a row a hash function, as 32-bit names of what was drawn; sets without members keep 0."""
    out = np.zeros((len(_ODD), n), np.uint64)
    if not len(doc):
        return out.astype(np.uint32)
    log_weight = np.log(weight).astype(np.float32)
    starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    ends = np.concatenate((starts[1:], [len(doc)]))
    # Whole sets at a time, about as many members as fit a cache.
    cut = np.searchsorted(ends, np.arange(1 << 15, len(doc) + (1 << 15), 1 << 15))
    for first, last in zip([0, *(cut + 1).tolist()], [*(cut + 1).tolist(), len(starts)], strict=True):
        first, last = min(first, len(starts)), min(last, len(starts))
        if first >= last:
            continue
        s, e = starts[first], ends[last - 1]
        h, lw = hashes[s:e], log_weight[s:e]
        for j, odd in enumerate(_ODD):
            x = h * odd
            r = _R[x >> np.uint64(48)]
            beta = _BETA[(x >> np.uint64(16)) & np.uint64(_LEVELS - 1)]
            level = np.floor(lw / r + beta)
            # log a = log c - r (t - beta) - r; 128 is added so that the order of floats is that of their bits.
            key = _LOG_C[(x >> np.uint64(32)) & np.uint64(_LEVELS - 1)] - r * (level - beta + np.float32(1)) + np.float32(128)
            name = (x ^ (level.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(20) & np.uint64(0xFFFFFFFF)
            both = (np.maximum(key, np.float32(0)).view(np.uint32).astype(np.uint64) << np.uint64(32)) | name
            out[j, doc[starts[first:last]]] = np.minimum.reduceat(both, starts[first:last] - s)
    return (out & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def frequent_weights(docs: DataFrame, rare: int = RARE) -> Weights:
    """Exact document frequencies of all shingles in at least one of `rare` documents.

    A chunk of documents names the shingles that at least 1 / (2 rare) of it hold, with their counts. One that is frequent
    in the corpus is missed by less than half its count over all chunks, so the sums of what was named leave at most
    2 rare times the shingles of a mean document as candidates; these are then counted exactly.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"))

    def distinct(texts_: pa.Array) -> np.ndarray:
        doc, hashes = shingles(split(texts_, lower=True))
        order = np.lexsort((hashes, doc))
        doc, hashes = doc[order], hashes[order]
        return hashes[np.concatenate(([True], (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])))[: len(doc)]]

    def rows(hashes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts.astype(np.int64))], names=["shingle", "n"])

    @tidy
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts * 2 * rare >= size
            # Under 4 * rare documents that share is less than two of them; every shingle is then named that two hold.
            return rows(found[often], counts[often])

        for batch in (part for whole in batches for part in slices(whole, 0)):
            held.append(distinct(batch.column(0)))
            size += batch.num_rows
            if size >= CHUNK_DOCS:
                yield close()
                held, size = [], 0
        if size:
            yield close()

    n = docs.count()
    named = texts.mapInArrow(name, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    candidates = np.sort(np.array([r[0] for r in named.where(F.col("n") * (2 * rare) >= F.lit(n)).select("shingle").collect()], np.int64).view(np.uint64))
    if not len(candidates):
        return Weights(np.zeros(0, np.uint64), np.zeros(0), 2.0)
    shared = docs.sparkSession.sparkContext.broadcast(candidates)

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(shared.value), np.int64)
        for batch in (part for whole in batches for part in slices(whole, 0)):
            found = distinct(batch.column(0))
            at = np.minimum(np.searchsorted(shared.value, found), len(sums) - 1)
            sums += np.bincount(at[shared.value[at] == found], minlength=len(sums))
        yield rows(shared.value[sums > 0], sums[sums > 0])

    exact = texts.mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") * rare >= F.lit(n)).collect()
    exact.sort(key=lambda r: np.int64(r[0]).view(np.uint64))
    return Weights(np.array([r[0] for r in exact], np.int64).view(np.uint64), idf(np.array([r[1] for r in exact]) / max(n, 1), rare) if exact else np.zeros(0), 2.0)


def similarities(a: pa.Array, b: pa.Array, weights: Weights) -> np.ndarray:
    """Weighted Jaccard similarity of a[i] and b[i]."""
    doc_a, hash_a, weight_a = weighted_sets(a, weights)
    doc_b, hash_b, weight_b = weighted_sets(b, weights)
    doc, hashes, weight = (np.concatenate(x) for x in ((doc_a, doc_b), (hash_a, hash_b), (weight_a, weight_b)))
    order = np.lexsort((hashes, doc))
    doc, hashes, weight = doc[order], hashes[order], weight[order]
    same = np.flatnonzero((doc[1:] == doc[:-1]) & (hashes[1:] == hashes[:-1]))
    n = len(a)
    total = np.bincount(doc, weight, minlength=n)
    inside = np.bincount(doc[same], np.minimum(weight[same], weight[same + 1]), minlength=n)
    return inside / np.maximum(total - inside, 1e-300)


def _verified(pairs: DataFrame, texts: DataFrame, weights, threshold: float) -> DataFrame:
    """The pairs (a, b) of texts whose similarity reaches the threshold."""
    left = texts.select(F.col("digest").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("digest").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2)):
            near = similarities(batch.column(2), batch.column(3), weights.value) >= threshold - 1e-9
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return stash(joined.mapInArrow(run, "a binary, b binary"), "neardup-links")


def _near_within(texts: pa.Array, bucket: np.ndarray, label: np.ndarray, weights: Weights, threshold: float) -> list[tuple[int, int]]:
    """Rows to links between rows of one bucket whose labels differ and whose similarity reaches the threshold.

    Of all such links enough are returned to connect what they connect. Shared weight is summed over the shingles' lists of
    rows, so texts are compared exactly and no pair is made that isn't a link.
    """
    n = len(bucket)
    parts, at = [], 0
    for part in slices(pa.record_batch([texts], names=["text"]), 0):
        doc, hashes, weight = weighted_sets(part.column(0), weights)
        parts.append((doc + at, hashes, weight))
        at += part.num_rows
    doc, hashes, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    total = np.bincount(doc, weight, minlength=n)
    order = np.lexsort((hashes, bucket[doc]))
    doc, hashes, weight = doc[order], hashes[order], weight[order]
    own = bucket[doc]
    starts = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (hashes[1:] != hashes[:-1]))))
    sizes = np.diff(np.concatenate((starts, [len(doc)])))
    shared = np.zeros((n, n), np.float32)
    for size in np.unique(sizes[(sizes > 1) & (sizes <= 16)]).tolist():
        rows = starts[sizes == size][:, None] + np.arange(size)
        for i in range(size):
            for j in range(i + 1, size):
                a, b = doc[rows[:, i]], doc[rows[:, j]]
                np.add.at(shared, (np.minimum(a, b), np.maximum(a, b)), np.minimum(weight[rows[:, i]], weight[rows[:, j]]))
    for s, size in zip(starts[sizes > 16].tolist(), sizes[sizes > 16].tolist(), strict=True):
        rows, w = doc[s : s + size], weight[s : s + size].astype(np.float32)
        by = np.argsort(rows)
        shared[np.ix_(rows[by], rows[by])] += np.minimum.outer(w[by], w[by])
    a, b = np.nonzero(np.triu(shared, 1))
    inside = shared[a, b].astype(np.float64)
    near = (inside / np.maximum(total[a] + total[b] - inside, 1e-300) >= threshold - 1e-6) & (label[a] != label[b])
    up = {}

    def root(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = x = up.get(up[x], up[x])
        return x

    links = []
    for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
        # Rows of a label are connected already, whatever the bucket.
        p, q = root(-1 - int(label[x])), root(-1 - int(label[y]))
        if p != q:
            up[p] = q
            links.append((x, y))
    return links


def _links_in_buckets(rest: DataFrame, texts: DataFrame, weights, threshold: float) -> DataFrame:
    """Links (a, b) that connect what the rows (bucket, digest, label) leave apart though it is near.

    Small buckets are put together into tasks. A bucket of more than BLOCK_ROWS rows or BLOCK_BYTES bytes is cut into blocks,
    and a task compares two of them, so that no task's memory grows with a bucket.
    """
    rows = stash(rest.join(texts.select("digest", F.octet_length("text").alias("size")), "digest"), "neardup-rest")
    sums = rows.groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_BYTES)).alias("blocks"))
    rows = rows.join(stash(sums, "neardup-blocks"), "bucket").withColumn("i", F.pmod(F.xxhash64("digest"), "blocks"))
    packs = max(1, -(-rows.where("blocks = 1").count() // BLOCK_ROWS))
    alone = rows.where("blocks = 1").select("bucket", "digest", "label", F.pmod(F.xxhash64("bucket"), F.lit(packs)).alias("k"), F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j"))
    cut = rows.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cut = cut.select("bucket", "digest", "label", F.col("bucket").alias("k"), F.least("i", "other").alias("i"), F.greatest("i", "other").alias("j"))
    full = alone.unionByName(cut).join(texts, "digest")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        digest = table["digest"].to_pylist()
        _, label = np.unique(np.array([x.hex() for x in table["label"].to_pylist()]), return_inverse=True)
        found = _near_within(table["text"].chunk(0), table["bucket"].to_numpy(), label, weights.value, threshold)
        return pa.table({"a": pa.array([digest[x] for x, _ in found], pa.binary()), "b": pa.array([digest[y] for _, y in found], pa.binary())})

    return stash(full.groupBy("k", "i", "j").applyInArrow(run, "a binary, b binary"), "neardup-links")


def _places(digests: pa.Array, words: int) -> np.ndarray:
    """Two bits of a filter for each digest, as rows."""
    halves = np.frombuffer(b"".join(digests.to_pylist()), np.uint64).reshape(-1, 2)
    return (mix(halves) % np.uint64(64 * words)).astype(np.int64)


def maybe_in(digests: DataFrame) -> Callable[[Column], Column]:
    """Whether a digest may be among digests: true for all that are. A Bloom filter, sized by the number of digests."""
    words = int(min(max(digests.count() // 8, LEAST_WORDS), MOST_WORDS))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(words, np.uint64)
        for batch in batches:
            at = _places(batch.column(0), words).ravel()
            np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        some = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(bits[some].view(np.int64))], names=["word", "bits"])

    found = digests.select("digest").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most `words`
    bits = np.zeros(words, np.uint64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    shared = digests.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def maybe(column: pa.Array) -> pa.Array:
        at = _places(column, len(shared.value))
        return pa.array((shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool).all(axis=1))

    return maybe


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, rare: int = RARE) -> DataFrame:
    """(doc_id, text) to (doc_id, digest, class_id, kept), a row a document.

    Equal texts are one text and are sampled, banded and verified once. class_id is the smallest doc_id of a class, null only if no row of it has one; kept is
    true for the rows of the text of that smallest doc_id (rows that repeat it included: keep_one() leaves one of them).
    Links are the pairs of texts that share a band and reach the threshold; where texts are connected already their other
    links aren't looked for, as they change no class. Texts are compared whole, A-Z as a-z. A text of
    one to four words is near only to the same words; texts without words are near to equal ones. Null texts have no
    digest, and each is a class of its own. Empty tables give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    weights = spark.sparkContext.broadcast(frequent_weights(docs, rare))
    kind = docs.schema["doc_id"].dataType.simpleString()

    @tidy
    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2)):
            drawn = sample(*weighted_sets(batch.column(2), weights.value), batch.num_rows).astype(np.uint64)
            keys = np.zeros((batch.num_rows, BANDS), np.uint64)
            for i in range(BANDS):
                key = np.full(batch.num_rows, i + 1, np.uint64)
                for j in range(ROWS):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + drawn[i * ROWS + j])
                keys[:, i] = key
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["doc_id", "digest", "bands"])

    read = docs.where("text is not null").select("doc_id", _digest(F.col("text")).alias("digest"), "text")
    signed = stash(read.mapInArrow(bands, f"doc_id {kind}, digest binary, bands array<bigint>"), "neardup-signatures")
    nodes = stash(signed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "neardup-texts")

    # Candidates: every text of a bucket with its hub, the text that has most company in all its buckets. Where copies
    # were edited one by one, that is the original, to which most of them are near though not to each other.
    buckets = nodes.select(F.explode("bands").alias("bucket"), "digest")
    crowds = stash(buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "neardup-buckets")
    crowded = stash(buckets.join(crowds, "bucket"), "neardup-crowded")
    company = stash(crowded.groupBy("digest").agg(F.sum("n").alias("company")), "neardup-company")
    hubs = crowded.join(company, "digest").groupBy("bucket").agg(F.max(F.struct("company", "digest")).alias("hub"))
    hubs = stash(hubs.select("bucket", F.col("hub.digest").alias("hub")), "neardup-hubs")
    members = stash(crowded.select("bucket", "digest").join(hubs, "bucket"), "neardup-members")
    stars = stash(members.where("digest <> hub").select(F.col("hub").alias("a"), F.col("digest").alias("b")).distinct(), "neardup-pairs")
    # The texts that are candidates at all, once each.
    wanted = members.select("digest").distinct().join(nodes.select("digest", "rep"), "digest").withColumnRenamed("digest", "d")
    wanted = stash(wanted, "neardup-wanted")
    maybe = maybe_in(wanted.select(F.col("d").alias("digest")))
    own = read.where(maybe(F.col("digest"))).join(wanted, (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    texts = stash(own.select("digest", "text").dropDuplicates(["digest"]), "neardup-candidates")
    links = _verified(stars, texts, weights, threshold)

    # What a star can't tell: pairs within a bucket that are not connected yet.
    names = components(links.select("a", "b"))
    named = members.join(names.withColumnRenamed("node", "digest"), "digest", "left").select("bucket", "digest", "hub", F.coalesce("label", "digest").alias("label"))
    named = stash(named, "neardup-named")
    mixed = named.groupBy("bucket").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l <> m").select("bucket")
    rest = stash(named.join(mixed, "bucket"), "neardup-mixed")
    links = links.unionByName(_links_in_buckets(rest.select("bucket", "digest", "label"), texts, weights, threshold))

    names = stash(components(links), "neardup-classes").withColumnRenamed("node", "digest")
    classes = nodes.select("digest", "rep").join(names, "digest", "left").select("digest", "rep", F.coalesce("label", "digest").alias("label"))
    best = classes.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull().alias("no_id"), "rep", "digest")).alias("best"))
    classes = stash(classes.join(best, "label").select("digest", F.col("best.rep").alias("class_id"), (F.col("digest") == F.col("best.digest")).alias("is_best")), "neardup-result")
    found = signed.select("doc_id", "digest").join(classes, "digest").select("doc_id", "digest", "class_id", (F.col("is_best") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"))
    alone = docs.where("text is null").select("doc_id", F.lit(None).cast("binary").alias("digest"), F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    return found.unionByName(alone)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class, all its columns as they are; rows with a null text all stay."""
    columns = docs.columns
    rows = stash(near_duplicates(docs, threshold).where("digest is not null").select("doc_id", "digest", "kept"), "neardup-kept")
    # A text of which no other row has a near copy stays as it is; only the others' rows move.
    per = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("kept").alias("all_kept"))
    moving = stash(per.where("n > 1 or not all_kept").select("digest"), "neardup-moving")
    maybe = maybe_in(moving)
    # The rows go along as one column, so that no name of theirs meets one of these.
    own = docs.where("text is not null").select(F.struct(*columns).alias("row"), "doc_id", _digest(F.col("text")).alias("digest"))
    own = own.withColumn("maybe", maybe(F.col("digest")))
    kept = rows.where("kept").select(F.col("doc_id").alias("id"), F.col("digest").alias("d")).distinct()
    chosen = own.where("maybe").join(kept, (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").dropDuplicates(["doc_id", "digest"])
    return own.where("not maybe").select("row.*").unionByName(chosen.select("row.*")).unionByName(docs.where("text is null"))
