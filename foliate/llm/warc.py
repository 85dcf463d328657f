"""Converting legacy ARC archives to WARC.

An ARC file says its version in its first record; version 1 describes a record in five fields, version 2 in ten, and both
declare the length of what follows. The converter reads header lines and declared lengths and writes, record for record, a
WARC file of the same name: identifiers are derived from the ARC file and the record's offset, timestamps from the 14-digit
dates, types from the content, digests from the bytes. A payload that several records hold is kept by one and revisited by
the others. Files are written under a name of their own and then renamed, so that a repeated task replaces its own work.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, stash

#: Fields of a record's header line by version; the last is the declared length.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
CRAWL_DATE, CRAWL_IP, ORIGIN = "20240101000000", "192.0.2.1", "foliate"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below so many bytes are never revisited.
MIN_REVISIT_BYTES = 100
#: Uncompressed bytes after which an archive is closed; a longer record has an archive of its own.
SEGMENT_BYTES = 16 << 20
MOST_TASKS = 10_000


def _store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def _put(uri: str, data: bytes) -> None:
    fs, path = _store(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(own, compression=None) as f:
        f.write(data)
    fs.move(own, path)


def _get(uri: str) -> bytes:
    fs, path = _store(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


def _member(data: bytes) -> bytes:
    """A gzip member of its own for a record, as is usual for either format."""
    z = zlib.compressobj(1, wbits=31)
    return z.compress(data) + z.flush()


def members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the gzip members of a file."""
    at, view = 0, memoryview(data)
    while at < len(data):
        z, content, end = zlib.decompressobj(wbits=31), [], at
        while not z.eof and end < len(data):  # in small steps, as what is left over is copied
            content.append(z.decompress(view[end : end + 32768]))
            end = min(end + 32768, len(data))
        if not z.eof:
            raise ValueError(f"the member at {at} is cut short")
        yield at, b"".join(content)
        at = end - len(z.unused_data)


# ARC


def arc_header(version: int, url: str, date: str, mime: str, length: int, name: str = "-", offset: int = 0) -> bytes:
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    fields = [uri, CRAWL_IP, date, mime, *(["200", "-", "-", str(offset), name] if version == 2 else []), str(length)]
    return " ".join(fields).encode() + b"\n"


def arc_file(version: int, name: str, records: list[tuple[str, bytes]]) -> bytes:
    """An ARC file of (url, content)."""
    about = f"{version} 0 {ORIGIN}\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    out = bytearray(_member(arc_header(version, f"filedesc://{name}", CRAWL_DATE, "text/plain", len(about), name) + about + b"\n"))
    for url, content in records:
        out += _member(arc_header(version, url, CRAWL_DATE, "text/html", len(content), name, len(out)) + content + b"\n")
    return bytes(out)


@dataclass
class ArcRecord:
    offset: int
    fields: dict[str, str]
    content: bytes


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of a compressed ARC file, the file's description first. Lengths that don't fit raise ValueError."""
    version = None
    for offset, block in members(data):
        line, _, rest = block.lstrip(b"\n").partition(b"\n")
        text = line.decode("utf-8", "surrogateescape")
        if version is None:
            length = int(text.rpartition(" ")[2])
            version = int(rest[:length].split(None, 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} isn't known")
        names = ARC_FIELDS[version]
        fields = dict(zip(names, text.rsplit(" ", len(names) - 1), strict=True))
        length = int(fields["Archive-length"])
        if len(rest) < length:
            raise ValueError(f"the record at {offset} declares {length} bytes and has {len(rest)}")
        yield ArcRecord(offset, fields, rest[:length])


def _http(content: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, header block and payload of a response."""
    head, mark, payload = content.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")[1:]
    return dict(x.split(": ", 1) for x in lines), head + mark, payload


# WARC


def record_id(arc: str, offset: int) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{arc}#{offset}')}"


def warc_date(digits: str) -> str:
    """14 digits, or fewer, as an ISO timestamp."""
    d = digits + "00000101000000"[len(digits) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode("utf-8", "surrogateescape") for k, v in [*headers, ("Content-Length", str(len(block)))])]
    return _member(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n")


def convert(arc: str, data: bytes, revisits: dict[int, tuple[int, str, int, str]]) -> bytes:
    """A WARC file of an ARC file. revisits: offset to (page_id, arc, offset, url) of the record that keeps the payload."""
    out = bytearray()
    for r in read_arc(data):
        url, date = r.fields["URL"], warc_date(r.fields["Archive-date"])
        digest = lambda b: "sha256:" + hashlib.sha256(b).hexdigest()
        common = [("WARC-Record-ID", f"<{record_id(arc, r.offset)}>"), ("WARC-Date", date)]
        if r.offset == 0 and url.startswith("filedesc://"):
            out += warc_record([("WARC-Type", "warcinfo"), *common, ("WARC-Filename", arc.replace(".arc", ".warc")), ("Content-Type", "application/warc-fields")], b"software: foliate\r\nformat: WARC File Format 1.1\r\n")
            continue
        _, head, payload = _http(r.content)
        about = [("WARC-Target-URI", url), ("WARC-IP-Address", r.fields["IP-address"]), ("WARC-Payload-Digest", digest(payload)), ("Content-Type", "application/http;msgtype=response")]
        if r.offset in revisits:
            page_id, other, offset, other_url = revisits[r.offset]
            refers = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{record_id(other, offset)}>"), ("WARC-Refers-To-Target-URI", other_url), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-Id", str(page_id))]
            out += warc_record([("WARC-Type", "revisit"), *common, *about, ("WARC-Block-Digest", digest(head)), *refers], head)
        else:
            out += warc_record([("WARC-Type", "response"), *common, *about, ("WARC-Block-Digest", digest(r.content))], r.content)
    return bytes(out)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of a compressed WARC file."""
    for offset, content in members(data):
        head, _, rest = content.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "surrogateescape").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {offset}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        yield headers, rest[: int(headers["Content-Length"])]


# The operator


def write_arcs(pages: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """ARC files of (page_id, url, html), alternately of version 1 and 2; a row (arc) a file."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("html"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names, records, size = TaskContext.get().partitionId(), [], [], 0

        def close() -> None:
            name = f"pages-{part:06d}-{len(names):05d}.arc.gz"
            _put(f"{folder}/arc/{name}", arc_file(1 + (part + len(names)) % 2, name, records))
            names.append(name)
            records.clear()

        for batch in batches:
            for page_id, url, html in zip(*(batch.column(i) for i in range(3)), strict=True):
                payload = html.as_py() or b""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
                head += f"X-Page-Id: {page_id.as_py()}\r\n" if page_id.is_valid else ""
                records.append((url.as_py() or "about:blank", head.encode() + b"\r\n" + payload))
                size += len(payload)
                if size >= segment_bytes:
                    close()
                    size = 0
        if records:
            close()
        yield pa.RecordBatch.from_pydict({"arc": pa.array(names, pa.string())})

    return stash(rows.mapInArrow(write, "arc string"), "arc-files")


def _each(files: DataFrame) -> DataFrame:
    """Files dealt to tasks of their own."""
    return files.repartition(max(1, min(files.count(), MOST_TASKS)), "arc")


def index_arcs(files: DataFrame, folder: str) -> DataFrame:
    """A row for each record of the ARC files: where it is and what its payload is."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for arc in batch.column("arc").to_pylist():
                rows = []
                for r in read_arc(_get(f"{folder}/arc/{arc}")):
                    if r.offset or not r.fields["URL"].startswith("filedesc://"):
                        fields, _, payload = _http(r.content)
                        page = fields.get("X-Page-Id")
                        rows.append({"arc": arc, "offset": r.offset, "page_id": int(page) if page else None, "url": r.fields["URL"].encode("utf-8", "replace").decode(), "n": len(payload), "digest": hashlib.sha256(payload).digest()})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("arc", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("n", pa.int64()), ("digest", pa.binary())]))

    return stash(_each(files).mapInArrow(index, "arc string, offset long, page_id long, url string, n long, digest binary"), "arc-index")


def convert_arcs(files: DataFrame, folder: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Converts the ARC files to WARC files beside them; a row (arc, warc) a file."""
    records = index_arcs(files, folder)
    able = records.where((F.col("n") >= min_revisit_bytes) & F.col("page_id").isNotNull())
    keepers = able.groupBy("digest").agg(F.min(F.struct("page_id", "arc", "offset", "url")).alias("keeper"), F.count("*").alias("k")).where("k > 1")
    keepers = stash(keepers.select("digest", "keeper"), "arc-keepers")  # a table of its own: the join below can then split a hot payload
    again = able.select("arc", "offset", "digest").join(keepers, "digest").where("arc <> keeper.arc or offset <> keeper.offset")
    by_file = again.groupBy("arc").agg(F.collect_list(F.struct("offset", "keeper")).alias("revisits"))  # at most a file's records
    todo = files.join(by_file, "arc", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arcs, out = batch.column("arc").to_pylist(), []
            for i, arc in enumerate(arcs):
                revisits = {r["offset"]: tuple(r["keeper"][k] for k in ("page_id", "arc", "offset", "url")) for r in batch.column("revisits")[i].as_py() or ()}
                out.append(arc.replace(".arc", ".warc"))
                _put(f"{folder}/warc/{out[-1]}", convert(arc, _get(f"{folder}/arc/{arc}"), revisits))
            yield pa.RecordBatch.from_pydict({"arc": pa.array(arcs, pa.string()), "warc": pa.array(out, pa.string())})

    n = max(1, min(files.count(), MOST_TASKS))
    return stash(todo.repartition(n, "arc").mapInArrow(run, "arc string, warc string"), "warc-files")


def read_warcs(files: DataFrame, folder: str) -> DataFrame:
    """The response and revisit records of the WARC files, with what they say and hold."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("warc", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for warc in batch.column("warc").to_pylist():
                rows = []
                for headers, block in read_warc(_get(f"{folder}/warc/{warc}")):
                    kind = headers["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    fields, _, payload = _http(block)
                    declared = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    whole = kind == "response"
                    digest = hashlib.sha256(payload).hexdigest() if whole else declared
                    if digest != declared:
                        raise ValueError(f"{warc}: {headers['WARC-Record-ID']} doesn't hold what its digest says")
                    page, to = fields.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
                    rows.append((int(page) if page else None, len(payload) if whole else int(fields["Content-Length"]), digest, kind, int(to) if to else None, headers["WARC-Record-ID"].strip("<>"), headers["WARC-Target-URI"].encode("utf-8", "replace").decode(), headers["WARC-Date"], warc))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    return _each(files).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string, warc_date string, warc string")


def archive_round_trip(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Writes (page_id, url, html) as ARC files, converts them to WARC files and reads these back: a row a page.

    The payload is the html in UTF-8, a null one empty. Of the records with equal payloads of at least min_revisit_bytes
    the one with the smallest page_id is the response and the others revisit it; rows that repeat a page_id count as
    records of their own, the first in archive order keeping the payload. Records without a page_id are responses. A null
    URL is written as about:blank, white space and control characters of URLs as %XX. Empty tables give empty archives and
    no rows. Other columns are not read.
    """
    folder = fresh_path(pages.sparkSession, "archives")
    files = write_arcs(pages, folder, segment_bytes)
    return read_warcs(convert_arcs(files, folder, min_revisit_bytes), folder)
