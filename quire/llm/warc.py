"""Legacy ARC archives to WARC: parsing, conversion, writing and reading back.

An ARC record is one header line, whose fields depend on the archive's version, and as many bytes as
the line declares.  The converter reads such records and synthesises the WARC record: identifier,
timestamp, type, payload and block digests.  Archives are files of gzip members, one a record, in the
shared folder; a task names its file after its attempt, and only files of attempts that succeeded are
listed in the table that the reader starts from.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import time
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.exact_dedup import bitmaps, filter_bits, tested
from quire.plans.staging import drop_stage, stage, stage_path

# Fixed values of the ARC header line and of WARC revisits.
ARC_FIELDS = {
    1: ["url", "ip", "date", "content_type", "length"],
    2: ["url", "ip", "date", "content_type", "result", "checksum", "location", "offset", "filename", "length"],
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROTATE_BYTES = 256 << 20


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _field(value: str | None, fallback: str) -> str:
    """A header field: without blanks and controls, never empty."""
    out = "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value or "")
    return out or fallback


def arc_header(version: int) -> bytes:
    """The version block that opens an ARC archive."""
    names = {1: b"URL IP-address Archive-date Content-type Archive-length\n", 2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"}
    body = b"%d 0 quire\n" % version + names[version] + b"\n"
    middle = b"" if version == 1 else b" 200 - - 0 quire.arc"
    return b"filedesc://quire.arc 0.0.0.0 20000101000000 text/plain%b %d\n" % (middle, len(body)) + body


def arc_record(version: int, url: str | None, date: str, source: str, block: bytes) -> bytes:
    middle = b"" if version == 1 else f" 200 - - 0 {source}".encode()
    return _field(url, "urn:none").encode("utf-8", "replace") + f" 0.0.0.0 {date} text/html".encode() + middle + b" %d\n" % len(block) + block + b"\n"


def arc_records(stream, name: str = "arc") -> Iterator[tuple[dict, bytes]]:
    """Fields and block of each record of an ARC stream; the version block tells the fields.

    Lines of version 1 name no file and offset: there they are the archive's name and the record's turn.
    Raises ValueError at a line of the wrong number of fields, a bad length, or a cut block.
    """
    version, turn = None, 0
    while line := stream.readline():
        if line in (b"\n", b"\r\n"):
            continue
        parts = line.rstrip(b"\r\n").decode("utf-8", "replace").split(" ")
        fields = ARC_FIELDS[2 if len(parts) == 10 else 1] if version is None else ARC_FIELDS[version]
        if len(parts) != len(fields) or not parts[-1].isdigit():
            raise ValueError(f"not an ARC {version or ''} header line: {line[:200]!r}")
        record = dict(zip(fields, parts))
        block = stream.read(int(record["length"]))
        if len(block) != int(record["length"]):
            raise ValueError(f"the block of {record['url']} is cut")
        if version is None:
            if not record["url"].startswith("filedesc:"):
                raise ValueError("an ARC archive opens with a version block")
            version = int(block.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} is unknown")
            continue
        if version == 1:
            record |= {"filename": name, "offset": str(turn)}
        turn += 1
        yield record, block


def record_id(source: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, source)}>"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head and payload of an HTTP response; a block that is none is all payload."""
    if block.startswith(b"HTTP/"):
        head, mark, payload = block.partition(b"\r\n\r\n")
        if mark:
            return head + mark, payload
    return b"", block


def warc_record(record: dict, block: bytes, refers_to: str | None = None) -> bytes:
    """The WARC record of an ARC record; with refers_to (the source of an equal payload) a revisit."""
    head, payload = split_http(block)
    source = f"{record['filename']}:{record['offset']}"
    d = record["date"].ljust(14, "0")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {('revisit' if refers_to else 'response') if head else 'resource'}",
        f"WARC-Record-ID: {record_id(source)}",
        f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        f"WARC-Target-URI: {record['url']}",
        f"WARC-IP-Address: {record['ip']}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Source: {source}",
    ]
    if refers_to:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Source: {refers_to}"]
        block = head
    lines += [f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Type: {'application/http;msgtype=response' if head else record['content_type']}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def warc_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of a WARC stream."""
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError(f"the block of {fields.get('warc-record-id')} is cut")
        yield fields, block


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def capture(ident: str) -> tuple[int, str]:
    """The ARC version and the date that a page without either is archived under: both follow from its id."""
    n = zlib.crc32(ident.encode())
    return 1 + n % 2, time.strftime("%Y%m%d%H%M%S", time.gmtime(946_684_800 + n % 300_000_000))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes an archive a task into folder and returns the table of the files (path, records).

    Of pages of equal payloads of min_bytes or more, that of the smallest id (one without an id comes
    last) is a response and the others are revisits of it; rows that repeat the smallest id are
    responses too.  A null html is an empty payload, a null url becomes urn:none.  Pages whose
    payload no other has are written where they are read; only the others may be shuffled.
    """
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{id_col}`").alias("key"), F.col(f"`{url_col}`").alias("url"), html.alias("html"), F.sha1(html).alias("digest"))
    shared = stage(
        rows.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"))
        .where("n > 1").select("digest", "first"), "payloads")
    bits = filter_bits(shared.count())
    found = stage(bitmaps(shared.select(F.xxhash64("digest").alias("h")), bits), "filter")
    rows = tested(rows.withColumn("h", F.xxhash64("digest")), "h", found, bits, "again")
    again = rows.where("again").join(shared, "digest", "left")
    again = again.select("id", "url", "html", F.when(~F.col("first").eqNullSafe(F.col("key")), F.col("first").cast("string")).alias("refers_to"))
    rows = rows.where("NOT again").select("id", "url", "html", F.lit(None).cast("string").alias("refers_to")).unionByName(again)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _file_system(folder)
        store.create_dir(top, recursive=True)
        task, turn = TaskContext.get(), 0
        out, name, written, count = None, None, 0, 0
        for batch in batches:
            for page, url, body, first in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "html", "refers_to"))):
                version, date = capture(str(page))
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                archive = arc_header(version) + arc_record(version, url, date, f"page-{page}", head + body)
                for record, block in arc_records(io.BytesIO(archive), f"page-{page}"):
                    if out is None:
                        name = f"{top}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{turn}.warc.gz"
                        out, turn = store.open_output_stream(name, compression=None), turn + 1
                    member = gzip.compress(warc_record(record, block, None if first is None else f"page-{first}:0"), 5, mtime=0)
                    out.write(member)
                    written, count = written + len(member), count + 1
                if written >= ROTATE_BYTES:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"path": [name], "records": pa.array([count], pa.int64())})
                    out, written, count = None, 0, 0
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "records": pa.array([count], pa.int64())})

    out = stage(rows.mapInArrow(run, "path string, records long"), "archives")
    drop_stage(shared)
    drop_stage(found)
    return out


def read_archives(files: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the files of a table: source, type, url, date, digest, length, refers_to, payload.

    A response whose payload does not have the digest that its header names raises ValueError.
    """
    schema = "source string, record_type string, url string, date string, payload_digest string, payload_bytes long, refers_to string, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _file_system(folder)
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) as stream:
                    for f, block in warc_records(stream):
                        payload = split_http(block)[1]
                        digest = f["warc-payload-digest"].removeprefix("sha1:")
                        if f["warc-type"] != "revisit" and base32_sha1(payload) != digest:
                            raise ValueError(f"{f['warc-record-id']}: the payload is not the one that was digested")
                        rows.append((f["x-source"], f["warc-type"], f["warc-target-uri"], f["warc-date"], digest, int(f["x-payload-length"]), f.get("x-refers-to-source"), payload if payloads and f["warc-type"] != "revisit" else None))
                        held += len(payload)
                        if held > 4 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    parts = max(1, files.count())
    return files.repartition(parts).mapInArrow(run, schema)


def arc_to_warc(archives: DataFrame, content_col: str = "content") -> DataFrame:
    """One row per record of ARC archives given as binary rows: url, date and the WARC record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in pc.fill_null(batch.column(0), b""):
                raw = content.as_py()
                rows = [(r["url"], r["date"], warc_record(r, block)) for r, block in arc_records(io.BytesIO(raw), hashlib.sha1(raw).hexdigest())]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 3, (pa.string(), pa.string(), pa.binary()))], ["url", "date", "record"])

    return archives.select(F.col(f"`{content_col}`")).mapInArrow(run, "url string, date string, record binary")


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes the pages' archives into the shared folder, reads them back without payloads, and deletes them."""
    spark = pages.sparkSession
    folder = stage_path(spark, "warc")
    files = write_archives(pages, folder, id_col, url_col, html_col, min_bytes)
    out = stage(read_archives(files, folder, payloads=False).drop("payload"), "records")
    drop_stage(files)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return out
