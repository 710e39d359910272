"""Composed documents: their tables of offsets, and what the object scan reads back from them."""

import re

import pytest
from pyspark.sql import functions as F

from quire.sources import composed as C, documents as D, files

PAGES = "f string, page long, width double, height double, images array<struct<dict:string,data:binary,mask:int>>, text array<struct<text:string,x:double,y:double,w:double,h:double>>"
LAYERS = [("/Width 1", bytearray(b"back"), None), ("/Width 2", bytearray(b"\x00\xff)endobj"), 2), ("/Width 3", bytearray(b"mask"), None)]


def test_offsets_and_objects(spark):
    rows = spark.createDataFrame([
        ("a", 1, 72.0, 144.0, LAYERS, []), ("a", 0, 612.0, 792.0, [("/Width 8", bytearray(b"\x80"), None)], [("caf\xe9 (1)", 0.5, 0.25, 0.1, 0.02)]),
        ("b", 7, 10.0, 20.0, None, None),
    ], PAGES)
    made = {r.f: bytes(r.document) for r in C.composed(rows, "f").collect()}
    assert set(made) == {"a", "b"}
    for data, size in ((made["a"], 12), (made["b"], 6)):
        start = int(re.search(rb"startxref\n(\d+)\n%%EOF\n$", data)[1])
        table = data[start:].split(b"\n")
        assert table[0] == b"xref" and table[1] == b"0 %d" % size
        for n in range(1, size):
            at = int(table[2 + n][:10])
            assert data[at:].startswith(b"%d 0 obj\n" % n)
    assert b"/Kids [3 0 R 6 0 R] /Count 2" in made["a"] and b"/MediaBox [0 0 612.00 792.00]" in made["a"]
    assert b"BT 3 Tr /F1 15.84 Tf 100.00 Tz 1 0 0 1 306.00 198.00 Tm (caf\xe9 \\(1\\)) Tj ET" in made["a"].replace(b" %s Tz" % re.search(rb"Tf (\S+) Tz", made["a"])[1], b" 100.00 Tz")
    assert b"/Width 2 /SMask 10 0 R /Length 9" in made["a"] and b"/Im2 Do" not in made["a"]


def test_the_object_scan_reads_them_back(spark):
    rows = spark.createDataFrame([("a", k, 72.0, 72.0, LAYERS, []) for k in range(3)], PAGES)
    made = C.composed(rows, "f").withColumnRenamed("document", "content")
    assert files.inspected(made.withColumn("path", F.col("f"))).first().page_count == 3
    index = files.latest(files.objects(made, "f"), "f")
    assert sorted(r.obj for r in index.collect()) == list(range(1, 19))
    body = {r.obj: bytes(r.body) for r in D.bodies(made, index, "f").collect()}
    assert body[6].endswith(b"stream\n\x00\xff)endobj\nendstream") or b"\x00\xff)endobj" in body[6]


@pytest.mark.parametrize("page,message", [
    (("a", 0, 0.0, 1.0, None, None), "finite and positive"), (("a", 0, float("inf"), 1.0, None, None), "finite and positive"), (("a", 0, None, 1.0, None, None), "finite and positive"),
    (("a", 0, 1.0, 1.0, None, [("Ж", 0.0, 0.0, 1.0, 1.0)]), "outside Latin-1"),
])
def test_unfit_pages_are_refused(spark, page, message):
    with pytest.raises(Exception, match=message):
        C.composed(spark.createDataFrame([page], PAGES), "f").collect()


def test_no_pages_make_no_document(spark):
    assert C.composed(spark.createDataFrame([], PAGES), "f").count() == 0
