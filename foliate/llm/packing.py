"""Packing token sequences: best-fit decreasing, certified by dual-feasible bounds, with exchanges between partitions.

Documents become token pieces of at most a sequence's length. Pieces are dealt to partitions; each packs its own by best-fit
decreasing, and dual-feasible functions bound from below the sequences that its pieces need. A partition whose sequences
exceed that bound by so little that all such partitions together can't save one sequence is certified and done. The others
have gaps: the pieces of their sequences with room are exchanged, that is dealt anew to fewer and larger partitions, and
packed anew. This goes on until the bound over all pieces is met, which certifies the whole, or nothing is left to exchange.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encoder
from .common import row_place, stash
from .words import slices, tidy

CAPACITY = 4096
#: The id that ends every document.
END_ID = 1
#: Pieces that one task packs at first, how much larger partitions are with every exchange, and the largest.
PARTITION_PIECES, GROWTH, LARGEST = 50_000, 4, 2_000_000
MAX_EXCHANGES = 6


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """(doc_id, text) to token pieces: doc_id, piece, start, length, ids_crc32 and, if asked, ids as bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            found, bounds = encoder(tokenizer_path).encode(batch.column(1), end_id)
            size = np.diff(bounds)
            count = -(-size // capacity)
            index = np.repeat(np.arange(batch.num_rows), count)
            piece = np.arange(len(index)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(size[index] - start, capacity)
            at = bounds[index] + start
            raw = found.astype("<u4", copy=False).view(np.uint8).data
            parts = [raw[4 * s : 4 * e] for s, e in zip(at.tolist(), (at + length).tolist(), strict=True)]
            columns = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
            if ids:
                columns.append(pa.array([bytes(x) for x in parts], pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int64())), *columns], names=names)

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every length: longest first, each into the open bin where it leaves the least room.

    Bins are kept by room, with a bit for every room that some bin has, so finding one takes no search.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fitting = rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room, n = n, capacity, n + 1
        bins[i], offsets[i] = b, capacity - room
        if room > need:
            by_room[room - need].append(b)
            rooms |= 1 << (room - need)
    return bins, offsets


def dual_feasible(size: np.ndarray, count: np.ndarray, capacity: int = CAPACITY) -> float:
    """The largest sum of several dual-feasible functions over `count` items of each `size`: that many bins or more are needed.

    A function u of [0, 1] is dual feasible if the values of any numbers that sum to at most 1 also sum to at most 1; the
    sum of u over all items then bounds the bins. Taken are the identity, the rounding u_k(x) = x if (k + 1) x is whole,
    else floor((k + 1) x) / k, and the threshold e(x) = 0 below e, x between, 1 above 1 - e.
    """
    best = int((size * count).sum()) / capacity
    for k in range(1, 33):
        scaled = (k + 1) * size
        whole = scaled % capacity == 0
        # In units of 1 / (k * capacity), so that sums are exact.
        value = np.where(whole, size * k, scaled // capacity * capacity)
        best = max(best, int((value * count).sum()) / (k * capacity))
    by_size = np.zeros(capacity + 2, np.int64)
    by_size[size] = count
    items, tokens = (np.concatenate(([0], np.cumsum(x))) for x in (by_size, by_size * np.arange(capacity + 2)))
    e = np.arange(1, capacity // 2 + 1)
    # Tokens of sizes e to capacity - e, and a bin for each larger one.
    sums = tokens[capacity - e + 1] - tokens[e] + (items[-1] - items[capacity - e + 1]) * capacity
    return max(best, int(sums.max(initial=0)) / capacity)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """dual_feasible() of a list of lengths, in whole bins."""
    return math.ceil(dual_feasible(*np.unique(lengths, return_counts=True), capacity) - 1e-9) if len(lengths) else 0


def _pack_groups(rows: DataFrame, groups: int, round_: int, capacity: int) -> DataFrame:
    """Rows with a place and a length, packed in `groups` groups by a hash of the place and the round.

    Added are bin, offset, fill (the bin's tokens) and certified: whether the group's bins exceed its dual-feasible sum by
    less than 1 / groups, so that the certified groups can't save a whole sequence between them.
    """

    def run(table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        n = int(bins.max(initial=-1)) + 1
        fill = np.bincount(bins, lengths, minlength=n).astype(np.int64)
        certified = n - dual_feasible(*np.unique(lengths, return_counts=True), capacity) < 1 / groups
        group = table["__group"][0].as_py()
        number = np.int64(round_) << 58 | np.int64(group) << 26 | bins
        extra = {"bin": number, "offset": offsets, "fill": fill[bins], "certified": np.full(len(bins), certified)}
        for name, values in extra.items():
            table = table.append_column(f"__{name}", pa.array(values))
        return table

    dealt = rows.withColumn("__group", F.pmod(F.xxhash64("__place", F.lit(round_)), F.lit(groups)))
    schema = T.StructType([*dealt.schema.fields, *(T.StructField(f"__{n}", T.LongType()) for n in ("bin", "offset", "fill")), T.StructField("__certified", T.BooleanType())])
    return dealt.groupBy("__group").applyInArrow(run, schema).drop("__group")


def certify(parts: DataFrame, capacity: int = CAPACITY) -> int:
    """The dual-feasible bound on the sequences that all pieces need; what comes to the driver is a count for each length."""
    rows = parts.groupBy("length").count().collect()  # at most `capacity`
    return math.ceil(dual_feasible(*np.array(rows, np.int64).T, capacity) - 1e-9) if rows else 0


def pack(parts: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES, max_exchanges: int = MAX_EXCHANGES, largest: int = LARGEST) -> DataFrame:
    """Token pieces, with a length column of 1 to capacity, with sequence_id and offset added.

    Sequences have no gaps and no piece is cut. Repeated pieces are packed each; an empty table gives no rows. Columns of
    the input named sequence_id or offset are replaced.
    """
    parts = stash(parts.drop("sequence_id", "offset"), "pack-pieces")
    columns = parts.columns
    rows = parts.withColumn("__place", row_place())
    n = parts.count()
    bound = certify(parts, capacity)
    groups = max(1, -(-n // partition_pieces))
    packed = stash(_pack_groups(rows, groups, 0, capacity), "pack-round")
    done: list[DataFrame] = []
    closed_bins = 0
    for i in range(1, max_exchanges + 1):
        is_open = ~F.col("__certified") & (F.col("__fill") < capacity)
        bins = lambda df: df.select("__bin").distinct().count()
        pieces_open = packed.where(is_open).count()
        fewer = max(1, -(-pieces_open // min(largest, partition_pieces * GROWTH**i)))
        if groups == 1 or not pieces_open or closed_bins + bins(packed) <= bound:
            break  # packed together, certified one by one, or certified as a whole
        before = bins(packed.where(is_open))
        again = stash(_pack_groups(packed.where(is_open).select(*columns, "__place"), fewer, i, capacity), "pack-round")
        groups = fewer
        if bins(again) > before:  # as it was; larger partitions may yet do better
            again = packed.where(is_open)
        closed = packed.where(~is_open)
        closed_bins += bins(closed)
        done.append(closed)
        packed = again
    whole = reduce(DataFrame.unionByName, [*done, packed])
    return whole.select(*columns, F.col("__bin").alias("sequence_id"), F.col("__offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """(doc_id, text) to pieces with their sequence_id and offset.

    A document is its tokens and the end id; a null or empty text is the end id alone. Only documents longer than a
    sequence are cut, into whole sequences and one last piece. Rows that repeat are packed each, an empty table gives no
    rows, and other columns are not read.
    """
    return pack(pieces(docs, tokenizer_path, capacity, end_id, ids), capacity)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequences, their lower bound by tokens, and the share of their room that is used."""
    per = packed.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
    return per.agg(F.count("*").alias("sequences"), F.ceil(F.sum("fill") / capacity).alias("bound"), (F.sum("fill") / (F.count("*") * capacity)).alias("used"))
