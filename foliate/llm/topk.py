"""Exact top-k inner products by Fagin's threshold algorithm.

Candidates are cut into blocks; in a block every dimension has a list of its candidates sorted by that component. A query
reads all lists from the end that its sign prefers, scores what it meets exactly, and stops as soon as the sum of its
components times the last values read, which bounds every candidate not yet met, falls below its k-th score so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_place, stash

K = 20
SCALE = 64
QUERY_EVERY = 20
#: Candidates and queries that meet in one task.
CANDIDATE_BLOCK, QUERY_BLOCK = 8192, 1024
#: Positions that are read from every list before the first look at the threshold, and the ratio of later looks.
SEED, GROWTH = 8, 1.25
#: Positions read of all lists, as a share of the block, from which on the whole block is scored at once.
FLAT_SHARE = 0.5


def _matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors as rows of whole numbers; a shorter one is padded with 0."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), max(1, lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores, ties to smaller ids."""
    close = np.arange(len(scores))
    if len(scores) > k:
        close = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return close[np.lexsort((ids[close], -scores[close]))[:k]]


def threshold_search(queries: np.ndarray, block: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int = K) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (its index, candidates' indices, scores): its k best of the block, ties to smaller ids.

    own: the index in the block of the query's own row, or -1. A query first reads SEED positions of every list and scores
    what they name; the k-th score so far then tells the depth at which the threshold falls below it, and no list is read
    further. Queries that read so deep that the lists name most of the block score it as one matrix product.
    """
    width = max(queries.shape[1], block.shape[1])
    queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    block = np.pad(block, ((0, 0), (0, width - block.shape[1])))
    n = len(block)
    # Floats hold the products exactly where they stay below 2**53, and multiply faster than whole numbers.
    safe = float(np.abs(queries).max(initial=0)) * float(np.abs(block).max(initial=0)) * width < 2**52
    kind = np.float64 if safe else object
    queries, block = queries.astype(kind), block.astype(kind)
    order = np.argsort(block, axis=0, kind="stable")
    lists = np.take_along_axis(block, order, 0)
    # After `depth` positions of every list, nothing unmet is above the values at these places.
    depths = np.unique(np.minimum(n, (SEED * GROWTH ** np.arange(0, 64)).astype(np.int64)))
    bounds = lists[n - depths] @ np.maximum(queries, 0).T + lists[depths - 1] @ np.minimum(queries, 0).T
    flat: list[int] = []

    def named(q: int, depth: int) -> np.ndarray:
        rising, falling = np.flatnonzero(queries[q] < 0), np.flatnonzero(queries[q] > 0)
        met = np.unique(np.concatenate((order[:depth][:, rising].ravel(), order[n - depth :][:, falling].ravel())))
        return met[met != own[q]]

    for q, vector in enumerate(queries):
        met = named(q, int(depths[0]))
        stop = len(depths) - 1
        if len(met) >= k:
            kth = np.partition(scores := block[met] @ vector, len(met) - k)[len(met) - k]
            stop = int(np.argmax(bounds[:, q] < kth)) if (bounds[:, q] < kth).any() else stop
        if depths[stop] * np.count_nonzero(vector) >= FLAT_SHARE * n or depths[stop] == n:
            flat.append(q)
            continue
        if stop:
            met = named(q, int(depths[stop]))
            scores = block[met] @ vector
        first = _best(scores, ids[met], k)
        yield q, met[first], scores[first]
    for at in range(0, len(flat), 128):
        some = np.array(flat[at : at + 128])
        for q, scores in zip(some.tolist(), queries[some] @ block.T, strict=True):
            met = np.arange(n)
            if own[q] >= 0:
                met, scores = np.delete(met, own[q]), np.delete(scores, own[q])
            first = _best(scores, ids[met], k)
            yield q, met[first], scores[first]


def top_k(vectors: DataFrame, k: int = K, scale: int = SCALE, query_every: int = QUERY_EVERY, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(vec_id, embedding) to (query_id, rank, vec_id, score): the k best other rows of every row whose id is divisible.

    Components become floor(scale * x). Vectors that are null or hold a null or a component that is not finite take no
    part; nor do rows without an id. A shorter vector counts as padded with zeros, an empty one as all zeros. Repeated rows
    are rows of their own: each is a candidate of the others, and each repeated query gets its own result. Equal scores go
    to the smaller vec_id. Fewer than k candidates are all returned; empty tables give no rows. Other columns are not read.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    fit = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    rows = stash(fit.select("vec_id", whole.alias("v")), "topk-vectors").withColumn("place", row_place())
    n = rows.count()
    asked = rows.where(F.col("vec_id") % query_every == 0)
    m = asked.count()
    across, down = max(1, -(-n // candidate_block)), max(1, -(-m // query_block))
    # A grid of tasks: blocks of candidates by blocks of queries, each of bounded size.
    candidates = rows.withColumn("c", F.pmod("place", F.lit(across)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    queries = asked.withColumn("q", F.pmod(F.xxhash64("place"), F.lit(down)).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["place", "query_id", "vec_id", "score"]
        out: list[list[np.ndarray]] = [[] for _ in names]
        if left.num_rows and right.num_rows:
            ids, query_ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
            query_places, place = right["place"].to_numpy(), {p: i for i, p in enumerate(left["place"].to_pylist())}
            own = np.array([place.get(p, -1) for p in query_places.tolist()])
            for q, best, scores in threshold_search(_matrix(right["v"]), _matrix(left["v"]), ids, own, k):
                for column, values in zip(out, (np.full(len(best), query_places[q]), np.full(len(best), query_ids[q]), ids[best], scores.astype(np.int64)), strict=True):
                    column.append(values)
        return pa.table({name: pa.array(np.concatenate(x) if x else [], pa.int64()) for name, x in zip(names, out, strict=True)})

    found = candidates.groupBy("c", "q").cogroup(queries.groupBy("c", "q")).applyInArrow(search, "place long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("place").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
