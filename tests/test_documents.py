"""Packed objects, live definitions, page order and page structure on hand-built rows."""

import zlib

import pytest
from pyspark.sql import functions as F

from quire.sources import documents as D, files


@pytest.mark.parametrize("data,want", [
    (b"<< /A 1 /B << /C [1 2] /D (x >> y) >> /E#20F /G >>", {"A": b"1", "B": b"<< /C [1 2] /D (x >> y) >>", "E F": b"/G"}),
    (b"<< /A 1 >", None), (b"<< A 1 >>", None), (b"[1]", None), (b"<<>>", {}), (b"<< /A % no >>\n 2 0 R >>", {"A": b"% no >>\n 2 0 R"[8:].strip()}),
])
def test_entries(data, want):
    assert D.entries(data) == want


def test_lookup_tells_absent_from_unparseable(spark):
    rows = spark.createDataFrame([(bytearray(b"<< /A 1 >>"),), (bytearray(b"<< /B 1 >>"),), (bytearray(b"<< /A"),), (None,)], "d binary")
    assert [r[0].status for r in rows.select(D.lookup(F.col("d"), "A")).collect()] == ["found", "absent", "unparseable", "unparseable"]


def stream(objects):
    head, body = b"", b""
    for n, d in objects:
        head += b"%d %d " % (n, len(body))
        body += d + b" "
    data = zlib.compress(head + body)
    return b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (len(objects), len(head), len(data)) + data + b"\nendstream"


def test_packed_and_live_objects(spark):
    parts = [(5, stream([(1, b"<< /V 1 >>"), (2, b"<< /V 2 >>")])), (1, b"<< /V 9 >>"), (6, stream([(2, b"<< /V 3 >>"), (7, b"<< /V 7 >>")]))]
    data = b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n" % n + d + b"\nendobj\n" for n, d in parts)
    rows = spark.createDataFrame([("a", bytearray(data))], "path string, content binary")
    index = files.latest(files.objects(rows, "path"), "path")
    top = D.bodies(rows, index, "path")
    inner = D.packed(top, "path")
    assert {r.obj: bytes(r.body) for r in inner.collect()} == {1: b"<< /V 1 >>", 2: b"<< /V 3 >>", 7: b"<< /V 7 >>"}
    got = {r.obj: bytes(r.body).strip() for r in D.live(top, inner, "path").collect()}
    assert got[1] == b"<< /V 9 >>" and got[2] == b"<< /V 3 >>" and got[7] == b"<< /V 7 >>"
    assert D.packed(top, "path", budget=30).where("obj = 1").count() == 0


def test_page_order_and_cycles(spark):
    nodes = spark.createDataFrame([("a", 1, [2, 3]), ("a", 2, [4, 5]), ("a", 3, None), ("a", 4, None), ("a", 5, [6, 1]), ("a", 6, None), ("b", 1, None)], "f string, obj long, kids array<long>")
    roots = spark.createDataFrame([("a", 1), ("b", 1)], "f string, obj long")
    got = [(r.f, r.page, r.obj) for r in D.page_leaves(nodes, roots, "f").orderBy("f", "page").collect()]
    assert got == [("a", 0, 4), ("a", 1, 6), ("a", 2, 3), ("b", 0, 1)]


def test_page_structure(spark):
    rows = spark.createDataFrame([(1, "q /Im0 Do Q"), (2, "/Im0 Do BT (f Do) Tj ET"), (3, "/Im0 Do /Im1 Do"), (4, "/Im0 Do 0 0 5 5 re f")], "page long, stream string")
    assert {r.page: r.image_only for r in D.image_only(rows, "page").collect()} == {1: True, 2: False, 3: False, 4: False}
    images = spark.createDataFrame([(1, 100, 100, 72.0, 72.0), (1, 100, 100, 72.0, 72.0), (2, 5, 5, 0.0, 72.0)], "page long, w long, h long, page_w double, page_h double")
    assert {r.page: r.coverage for r in D.image_coverage(images, "page").collect()} == {1: 2.0, 2: 0.0}


def test_page_counts_must_match(spark):
    geometry = spark.createDataFrame([("a", 0, 5.0), ("a", 1, 6.0)], "f string, page long, w double")
    good = spark.createDataFrame([("a", 0, 2, "x")], "f string, page long, pages long, text string")
    assert D.page_geometry(good, geometry, "f").collect()[0].w == 5.0
    with pytest.raises(Exception, match="page counts differ"):
        D.page_geometry(good.withColumn("pages", F.lit(3)), geometry, "f").collect()


def test_bits_are_packed(spark):
    rows = spark.createDataFrame([(1, x, 0, 0 if x in (0, 9) else 255) for x in range(10)], "id long, x int, y int, v int")
    assert [r.value for r in D.packed_bits(rows).orderBy("byte").collect()] == [0b01111111, 0b10111111]
