"""Sharding by histogram sort: splitters are found by counting bytes, and rows move once.

Rows are ordered by (hash of the text, hash of the document), so equal texts lie together. For every boundary an interval
of hashes that must hold its splitter is kept; each pass counts the exact bytes in `probes` equal cells of the intervals
and narrows each to the cell that holds the boundary's byte, until an edge of the cell is within tolerance. A pass returns
at most (shards - 1) * probes sums. Then every row's shard is a comparison with the splitters, and one exchange deals them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_place, stash

SHARDS = 16
PROBES = 64
#: Distance of a splitter from its ideal byte, as a share of the mean shard, at which the search stops.
TOLERANCE = 0.001
#: The same distance up to which a splitter goes to an edge between different texts rather than into a group of equal ones.
GROUP_TOLERANCE = 0.02
LOWEST, HIGHEST = -(1 << 63), (1 << 63)
#: Rows that one task numbers at a time.
BUCKET_ROWS = 20_000


@dataclass
class Boundary:
    """The search for one splitter: the interval [low, high) of values, the bytes below each of its ends, the rows inside."""

    target: float
    low: int
    high: int
    below_low: int
    below_high: int
    rows: int = 2

    def settled(self, slack: float) -> bool:
        return self.rows < 2 or self.high - self.low <= 1 or min(self.target - self.below_low, self.below_high - self.target) <= slack

    def nearest(self) -> tuple[int, int]:
        """The nearer end, and the bytes below it."""
        at_low = self.target - self.below_low <= self.below_high - self.target
        return (self.low, self.below_low) if at_low else (self.high, self.below_high)


def _edges(b: Boundary, probes: int) -> list[int]:
    """Ends of at most `probes` cells that cut the interval as evenly as integers can."""
    width = b.high - b.low
    cells = min(probes, width)
    return [b.low - (-width * i // cells) for i in range(cells + 1)]


def _narrow(rows: DataFrame, column: str, boundaries: list[Boundary], probes: int, slack: float) -> int:
    """Passes over rows until every boundary is settled; their number."""
    passes = 0
    while open_ := {(b.low, b.high): b for b in boundaries if not b.settled(slack)}:
        passes += 1
        cell, edges = F.lit(None).cast("long"), []
        for i, b in enumerate(open_.values()):
            edges.append(_edges(b, probes))
            steps = len(edges[i]) - 1
            # Whole-number decimal arithmetic: the span of all longs overflows one, and cells must be exact.
            place = F.expr(f"(cast({column} as decimal(20,0)) - cast('{b.low}' as decimal(20,0))) * cast({steps} as decimal(4,0)) div cast('{b.high - b.low}' as decimal(20,0))")
            inside = (F.col(column) >= F.lit(b.low)) & (F.col(column) < F.lit(b.high) if b.high < HIGHEST else F.lit(True))
            cell = F.when(inside, place + i * probes).otherwise(cell)
        counted = rows.select(cell.alias("cell"), "size", column).where("cell is not null").groupBy("cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min(column).alias("least"), F.max(column).alias("most"))
        sums = {r.cell: r for r in counted.collect()}  # at most a row for each boundary and probe
        found = {}
        for i, (key, b) in enumerate(open_.items()):
            ends, below = edges[i], [b.below_low]
            for j in range(len(ends) - 1):
                below.append(below[-1] + (r.bytes if (r := sums.get(i * probes + j)) else 0))
            found[key] = (i, ends, below)
        for b in boundaries:
            if (b.low, b.high) in found and not b.settled(slack):
                i, ends, below = found[b.low, b.high]
                j = max(k for k in range(len(ends) - 1) if below[k] <= b.target)
                b.low, b.high, b.below_low, b.below_high = ends[j], ends[j + 1], below[j], below[j + 1]
                if (r := sums.get(i * probes + j)) is None:
                    b.rows = 0
                else:
                    b.rows = r.n
                    if r.least == r.most:  # one value is left
                        b.low, b.high = r.least, r.least + 1
    return passes


def byte_splitters(rows: DataFrame, shards: int = SHARDS, probes: int = PROBES, tolerance: float = TOLERANCE, group_tolerance: float = GROUP_TOLERANCE) -> list[tuple[int, int]]:
    """Splitters (key, tie) of rows (key long, tie long, size long); a row belongs to the shard of the splitters not above it."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    mean = total / shards
    boundaries = [Boundary(mean * i, LOWEST, HIGHEST, 0, total) for i in range(1, shards)]
    _narrow(rows, "key", boundaries, probes, tolerance * mean)
    splitters: list[tuple[int, int] | None] = []
    inside: dict[int, list[Boundary]] = {}
    for b in boundaries:
        edge, below = b.nearest()
        if abs(below - b.target) <= max(group_tolerance, tolerance) * mean or b.rows < 2 or b.high - b.low > 1:
            splitters.append((edge, LOWEST))
        else:  # the boundary's byte lies in a large group of equal texts, which is split by the hash of the document
            within = Boundary(b.target - b.below_low, LOWEST, HIGHEST, 0, b.below_high - b.below_low)
            inside.setdefault(b.low, []).append(within)
            splitters.append(None)
    cuts = {}
    for key, group in inside.items():
        _narrow(rows.where(F.col("key") == F.lit(key)), "tie", group, probes, tolerance * mean)
        cuts[key] = iter([(key, b.nearest()[0]) for b in group])
    return [s or next(cuts[b.low]) for s, b in zip(splitters, boundaries, strict=True)]


def _shard(key: Column, tie: Column, splitters: list[tuple[int, int]]) -> Column:
    out = F.lit(0)
    for k, t in splitters:
        after_tie = (tie >= F.lit(t)) if LOWEST < t < HIGHEST else F.lit(t == LOWEST)
        reached = (key > F.lit(k)) | ((key == F.lit(k)) & after_tie) if k < HIGHEST else F.lit(False)
        out = out + reached.cast("int")
    return out


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, probes: int = PROBES, tolerance: float = TOLERANCE, group_tolerance: float = GROUP_TOLERANCE) -> DataFrame:
    """(doc_id, text) to (doc_id, size, text_crc32, law, shard, slot, grown_shard), a row a document.

    size is the text's UTF-8 bytes plus 1; a null text counts as an empty one. Shards get equal bytes as nearly as whole
    documents allow. Equal texts go to one shard unless that would move a boundary by more than group_tolerance of a
    shard; larger groups are split by document. Slots number a shard's documents from 0 without gaps, in no stated order.
    Repeated rows count each for themselves. Empty tables give no rows; shards may be empty if there are few documents.
    Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"))
    narrow = stash(narrow, "shard-rows")
    rows = narrow.withColumn("place", row_place()).withColumn("tie", F.xxhash64("doc_id", "place"))
    splitters = byte_splitters(rows.select("key", "tie", "size"), shards, probes, tolerance, group_tolerance)
    dealt = rows.withColumn("shard", _shard(F.col("key"), F.col("tie"), splitters))

    # Slots: rows of a shard are dealt to buckets by their place, buckets are counted, and counts before each are added.
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("place", F.lit(1)), F.lit(buckets)))
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("place")) - 1
    out = dealt.join(starts, ["shard", "bucket"]).withColumn("slot", (F.col("start") + number).cast("long"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))
