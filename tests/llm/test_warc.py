"""ARC parsing, conversion and the archives' round trip."""

import hashlib
import io
import random

import pytest

from quire.llm.warc import arc_header, arc_record, arc_records, arc_to_warc, archive_round_trip, base32_sha1, read_archives, warc_record, warc_records, write_archives
from quire.plans.staging import stage_path

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    blocks = [HTTP + b"<p>one</p>", b"no http\n1 2 3 4 5\n", HTTP, b""]
    data = arc_header(version) + b"".join(arc_record(version, f"http://h/{k} é", "20010203040506", "f.arc", b) for k, b in enumerate(blocks))
    got = list(arc_records(io.BytesIO(data)))
    assert [b for _, b in got] == blocks and got[0][0]["url"] == "http://h/0%20é"
    out = [next(warc_records(io.BytesIO(warc_record(r, b)))) for r, b in got]
    assert [f["warc-type"] for f, _ in out] == ["response", "resource", "response", "resource"]
    assert out[0][0]["warc-date"] == "2001-02-03T04:05:06Z" and [b for _, b in out] == blocks
    assert out[0][0]["warc-payload-digest"] == "sha1:" + base32_sha1(b"<p>one</p>")


@pytest.mark.parametrize("data", [b"http://x 1 2\n", arc_header(1) + b"u i d t 99\nshort\n", arc_header(1) + b"u i d t x\n", b"http://x 0 1 t 0\n\n", arc_header(1).replace(b"1 0 quire", b"7 0 quire")])
def test_broken_archives_are_refused(data):
    with pytest.raises(ValueError):
        list(arc_records(io.BytesIO(data)))


def test_converter_rows(spark):
    data = arc_header(1) + arc_record(1, "http://a", "19990101000000", "", HTTP + b"x")
    out = arc_to_warc(spark.createDataFrame([(bytearray(data),), (None,)], "content binary")).collect()
    assert [r.url for r in out] == ["http://a"] and bytes(out[0].record).startswith(b"WARC/1.1\r\n")


@pytest.mark.parametrize("least", [0, 10])
def test_round_trip(spark, least):
    rng = random.Random(5)
    rows = [(k, rng.choice([None, "http://x/y z", f"http://h/{k}"]), rng.choice([None, "", "<p>same\r\n\r\nWARC/1.1\r\n</p>", f"<b>{k}é</b>", "z" * 300_000])) for k in range(120)] + [(3, "http://again", "<i>3</i>"), (3, "http://again", "<i>3</i>")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string").repartition(3)
    out = archive_round_trip(pages, min_bytes=least).collect()
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(i, first.get(h or "", i))
    assert len(out) == len(rows)
    want = []
    for i, _, h in rows:
        h = h or ""
        again = len(h.encode()) >= least and first[h] != i
        want.append((f"page-{i}:0", "revisit" if again else "response", len(h.encode()), base32_sha1(h.encode()), f"page-{first[h]}:0" if again else None))
    assert sorted(map(repr, want)) == sorted(repr((r.source, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to)) for r in out)


def test_payloads_come_back(spark):
    pages = spark.createDataFrame([(1, "u", "é<p>\n"), (2, "u", "é<p>\n")], "page_id long, url string, html string")
    folder = stage_path(spark, "t")
    out = {r.source: r for r in read_archives(write_archives(pages, folder), folder).collect()}
    assert bytes(out["page-1:0"].payload).decode() == "é<p>\n" and out["page-2:0"].payload is None
    assert hashlib.sha1("é<p>\n".encode()).digest()
    assert archive_round_trip(pages.limit(0)).count() == 0
