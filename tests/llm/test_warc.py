import hashlib
import random

import pytest
from pyspark.sql import types as T

from foliate.llm import warc as A

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("arc", T.StringType()), T.StructField("offset", T.LongType())])


def pages():
    big, small = "<p>" + "é" * 200, "tiny"
    rows = [(5, "http://a/", big), (3, "http://b/ c", big), (9, None, big), (1, "x", small), (2, "x", small), (7, "http://h/\r\n\r\nWARC/1.1", "\r\n\r\n" + "z" * 150)]
    rows += [(11, "u", None), (12, "u", ""), (13, "u", "q" * 100), (14, "u", "q" * 100), (15, "u", "q" * 99), (16, "u", "q" * 99), (None, "n", big), (20, "l", "L" * 3_000_000)]
    return rows


def want(rows):
    first = {}
    for i, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(h or "", i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = i is not None and len(b) >= 100 and first[h or ""] != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None))
    return out


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "clash", 1) for r in pages()], PAGES).repartition(3)
    got = A.archive_round_trip(df, segment_bytes=2000).collect()
    key = lambda r: (-1 if r[0] is None else r[0], r[1:3])
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want(pages()), key=key)
    ids = [r.record_id for r in got]
    assert len(set(ids)) == len(ids)
    assert {r.target_uri for r in got if r.page_id == 3} == {"http://b/%20c"}
    assert {r.warc_date for r in got} == {"2024-01-01T00:00:00Z"}


def test_repeated_pages_and_empty_table(spark):
    row = (4, "u", "w" * 120, "clash", 1)
    got = A.archive_round_trip(spark.createDataFrame([row, row, row], PAGES)).collect()
    assert sorted(r.record_type for r in got) == ["response", "revisit", "revisit"] and {r.refers_to for r in got} == {None, 4}
    assert A.archive_round_trip(spark.createDataFrame([], PAGES)).collect() == []


@pytest.mark.parametrize("version", [1, 2])
def test_headers_of_both_versions(version):
    content = b"HTTP/1.1 200 OK\r\nX-Page-Id: 8\r\n\r\nline\n\nfiledesc://fake 1 2 3 4\n" + bytes(range(256))
    data = A.arc_file(version, "a.arc.gz", [("http://h/ a", content), ("u", b"")])
    about, one, two = A.read_arc(data)
    assert about.fields["URL"] == "filedesc://a.arc.gz" and about.content.startswith(f"{version} 0 ".encode())
    assert one.content == content and one.fields["URL"] == "http://h/%20a" and two.content == b""
    assert tuple(one.fields) == A.ARC_FIELDS[version]
    records = list(A.read_warc(A.convert("a.arc.gz", data, {})))
    assert [h["WARC-Type"] for h, _ in records] == ["warcinfo", "response", "response"]
    assert records[1][1] == content and records[1][0]["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(content).hexdigest()


def test_broken_lengths_and_files_are_errors():
    short = A._member(A.arc_header(1, "filedesc://x", "20240101000000", "text/plain", 500) + b"1 0 x\n")
    with pytest.raises(ValueError):
        list(A.read_arc(short))
    whole = A.arc_file(1, "a", [("u", b"abc")])
    with pytest.raises(ValueError):
        list(A.read_arc(whole[:-5]))
    odd = A._member(A.arc_header(1, "filedesc://x", "20240101000000", "text/plain", 6) + b"7 0 x\n")
    with pytest.raises(ValueError):
        list(A.read_arc(odd))


def test_dates_of_fewer_digits():
    assert A.warc_date("1996") == "1996-01-01T00:00:00Z" and A.warc_date("19961231235958") == "1996-12-31T23:59:58Z"


def test_members_of_any_size():
    rng = random.Random(3)
    blocks = [rng.randbytes(rng.choice([0, 1, 100, 40_000, 70_000])) for _ in range(30)]
    data = b"".join(map(A._member, blocks))
    assert [c for _, c in A.members(data)] == blocks


def test_pages_with_a_description_s_url(spark):
    rows = [(1, "filedesc://page", "one"), (2, "http://a/", "two"), (3, "filedesc://page", "three")]
    frame = spark.createDataFrame([(*r, None, None) for r in rows], PAGES)
    got = A.archive_round_trip(frame).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == sorted(want(rows))
