"""Words of whole Arrow batches at once, as 64-bit hashes computed on the batch's bytes.

A word is a run of anything but the six ASCII white-space characters. Its hash is a polynomial over table values of its
bytes, read off running sums of the batch's buffer and mixed; equal words have equal hashes, and different words of a corpus
of n distinct ones share one with a probability below n * n / 2**65.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: Bytes of text that are worked on at a time; a byte takes some fifty bytes of arrays meanwhile.
SLICE_BYTES = 1 << 19
SPACES = b" \t\n\x0b\x0c\r"
_RANDOM = np.random.Generator(np.random.PCG64(4711))
_BYTE = _RANDOM.integers(1, 1 << 63, 256, np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_IS_SPACE = np.isin(np.arange(256), list(SPACES))
#: An odd base and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _release() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        return


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of a task's batches that gives freed memory back to the system after every batch and at the task's end.

    Workers live on from task to task, and several idle ones can stand beside those at work.
    """

    @functools.wraps(work)
    def run(batches: Iterator) -> Iterator:
        def each() -> Iterator:
            for batch in batches:
                yield batch
                del batch
                _release()

        try:
            yield from work(each())
        finally:
            _release()

    return run


def _power(which: int, n: int) -> np.ndarray:
    """The first n powers of the base (0) or of its inverse (1)."""
    if len(_powers[which]) >= n:
        return _powers[which][:n]
    more = np.full(n if n > 2 * SLICE_BYTES else n + n // 4, (_BASE, _INVERSE)[which], np.uint64)
    more[0] = 1
    np.multiply.accumulate(more, out=more)
    if n <= 2 * SLICE_BYTES:  # those of a longer text aren't kept
        _powers[which] = more
    return more[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Batch:
    """The texts of a batch: bytes [bounds[i], bounds[i+1]) of data are text i, words [first[i], first[i+1]) are its words."""

    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    sums: np.ndarray

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of spans of bytes."""
        value = (self.sums[end] - self.sums[start]) * _power(1, len(self.data) + 1)[start]
        return mix(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def hashes(self) -> np.ndarray:
        """The hash of every word."""
        return self.span_hash(self.start, self.end)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The text of every word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have few enough bytes for a cache, or a single longer text; an empty batch as it is."""
    size = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
    sums, at = np.cumsum(size), 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + most_bytes, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def split(texts: pa.Array, lower: bool = False) -> Batch:
    """The words of texts; null: none. lower: A-Z count as a-z."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    _, offsets, values = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(values, np.uint8)[bounds[0] : bounds[-1]] if values is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    # A word begins after white space or where a text begins, and ends before white space or where a text ends.
    solid = ~_IS_SPACE[data]
    before = np.concatenate(([False], solid))
    after = np.concatenate((solid, [False]))
    at_bound = np.zeros(len(data) + 1, bool)
    at_bound[bounds] = True
    start = np.flatnonzero(after & (~before | at_bound))
    end = np.flatnonzero(before & (~after | at_bound))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * _power(0, len(data)), out=sums[1:])
    return Batch(data, bounds, start, end, np.searchsorted(start, bounds), sums)


def windows(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a text, in order, and the first of each text as in Batch.first."""
    counts = np.maximum(np.diff(first) - (n - 1), 0)
    starts = np.concatenate(([0], np.cumsum(counts)))
    if len(hashes) < n:
        return np.zeros(0, np.uint64), starts
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        total = (total ^ hashes[i : len(hashes) - n + 1 + i]) * np.uint64(_BASE)
        total ^= total >> np.uint64(29)
    at = np.arange(starts[-1]) - np.repeat(starts[:-1], counts) + np.repeat(first[:-1], counts)
    return mix(total[at]), starts
