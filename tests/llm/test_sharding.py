import zlib
from collections import Counter, defaultdict

import pytest
from cases import base_rows, frame

from foliate.llm.sharding import HIGHEST, LOWEST, Boundary, _edges, shard_by_bytes


def check(rows, got, shards):
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r.law == "bytes" and 0 <= r.shard < shards and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in base_rows()]
    check(rows, shard_by_bytes(frame(spark)).collect(), 16)
    assert shard_by_bytes(frame(spark, [])).collect() == []


@pytest.mark.parametrize("shards", [1, 2, 16])
def test_bytes_are_near_equal_and_copies_together(spark, shards):
    rows = [(i, f"text {i % 900} " + "x" * ((i % 900) * 37 % 200), "en", "a", 0) for i in range(3000)]
    got = shard_by_bytes(frame(spark, rows), shards).collect()
    check([r[:2] for r in rows], got, shards)
    size, where = Counter(), defaultdict(set)
    for r in got:
        size[r.shard] += r.size
        where[r.text_crc32].add(r.shard)
    mean = sum(size.values()) / shards
    assert max(abs(size[s] - mean) for s in range(shards)) <= 0.05 * mean + 2 * 900
    assert sum(len(w) > 1 for w in where.values()) <= shards


def test_a_group_larger_than_a_shard_is_split(spark):
    rows = [(i, "the same text for a third of all rows" if i % 3 == 0 else f"row {i} of its own with words", "en", "a", 0) for i in range(3000)]
    size = Counter()
    for r in shard_by_bytes(frame(spark, rows), 8).collect():
        size[r.shard] += r.size
    assert max(size.values()) < 1.06 * min(size.values())


def test_repeated_rows_of_one_id(spark):
    rows = [(1, "equal in every column", "en", "a", 0)] * 400
    got = shard_by_bytes(frame(spark, rows), 4).collect()
    check([r[:2] for r in rows], got, 4)
    assert max(Counter(r.shard for r in got).values()) <= 110


def test_edges_cover_the_whole_range():
    e = _edges(Boundary(0, LOWEST, HIGHEST, 0, 0), 64)
    assert e[0] == LOWEST and e[-1] == HIGHEST and e == sorted(set(e))
    assert _edges(Boundary(0, 5, 8, 0, 0), 64) == [5, 6, 7, 8]
