"""Queries of composed documents and their objects over stand-in columns.

A document is made of each row of pages: an image whose bytes are the html, and a page with the
address as its text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import pricing, text as T
from quire.operators import pages as W
from quire.plans.bindings_more import PIXELS, grey_pages
from quire.plans.bindings_rows import VERSIONS, table, versions
from quire.sources import composed as C, documents as D, files


def made(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.encode("html", "UTF-8").alias("html"))
    image = F.array(F.struct(F.concat(F.lit("/Width "), F.octet_length("html")).alias("dict"), F.col("html").alias("data"), F.lit(None).cast("int").alias("mask"))).cast(C.IMAGES)
    run = F.array(F.struct(F.col("url").alias("text"), F.lit(0.5).alias("x"), F.lit(0.25).alias("y"), F.lit(0.125).alias("w"), F.lit(0.0625).alias("h"))).cast(C.TEXT)
    page = lambda k, images, text: F.struct(F.lit(k).alias("page"), images.alias("images"), text.alias("text"))
    pages = p.select("page_id", F.explode(F.array(page(0, image, F.array().cast(C.TEXT)), page(1, F.array().cast(C.IMAGES), run))).alias("p"))
    return C.composed(pages.select("page_id", "p.*", F.lit(612.0).alias("width"), F.lit(792.0).alias("height")), "page_id")


def locked(document):
    """The document with an update that names a lock which needs a password."""
    zeros = "00" * 32
    lock = f"20 0 obj\n<< /Filter /Standard /V 1 /R 2 /O <{zeros}> /U <{zeros}> /P -4 >>\nendobj\n"
    place = F.octet_length(document)
    tail = F.concat(F.lit(f"{lock}xref\n20 1\n"), F.format_string("%010d 00000 n \n", place), F.lit("trailer\n<< /Size 21 /Root 1 0 R /Encrypt 20 0 R >>\nstartxref\n"), (place + len(lock)).cast("string"), F.lit("\n%%EOF\n"))
    return F.concat(document, tail.cast("binary"))


def composed_documents(spark, sf_dir):
    """Size and digest of a new document of two pages for each row."""
    return made(spark, sf_dir).select("page_id", F.octet_length("document").cast("long").alias("size"), files.digest(F.col("document")).alias("digest"))


def object_index(spark, sf_dir):
    """Objects that the scan finds in composed documents, the largest number, and the image's bytes."""
    docs = made(spark, sf_dir).withColumnRenamed("document", "content")
    index = D.bodies(docs, files.latest(files.objects(docs, "page_id"), "page_id"), "page_id")
    image = F.max(F.when(F.col("obj") == 5, F.octet_length("body"))).cast("long")
    return index.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.max("obj").cast("long").alias("largest"), (image > 0).alias("has_image"))


def inspected_documents(spark, sf_dir):
    """Status and page count of composed documents, of every third cut before its table and every seventh locked."""
    docs = made(spark, sf_dir)
    content = (
        F.when(F.col("page_id") % 3 == 0, F.substring("document", F.lit(1), F.lit(40)))
        .when(F.col("page_id") % 7 == 0, locked(F.col("document"))).otherwise(F.col("document"))
    )
    return D.inspected(docs.select("page_id", content.alias("content")), "page_id").select("page_id", "status", "page_count")


def dictionary_lookup(spark, sf_dir):
    """A key that is there, absent, or in no dictionary at all."""
    data = F.when(F.col("page_id") % 3 == 0, F.lit("<< /Other 1 >>")).when(F.col("page_id") % 5 == 0, F.lit("<< /Kids")).otherwise(F.concat(F.lit("<< /Other 1 /Key ("), F.col("page_id"), F.lit(") >>")))
    out = table(spark, sf_dir, "pages").select("page_id", D.lookup(data.cast("binary"), "Key").alias("f"))
    return out.select("page_id", "f.status", F.col("f.value").cast("string").alias("value"))


def unescaped_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", files.unescaped_name(F.concat(F.lit("A#20"), F.col("source"), F.lit("#2F"))).alias("name"))


def byte_texts(spark, sf_dir):
    size = F.col("n_chars") * F.when(F.col("doc_id") % 3 == 0, 1).when(F.col("doc_id") % 3 == 1, 7919).otherwise(7990271)
    return table(spark, sf_dir, "documents").select("doc_id", T.byte_text(size.cast("long")).alias("size"))


def budgeted_names(spark, sf_dir):
    """The first line's characters that fit 40 bytes of UTF-8."""
    first = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", T.utf8_budget(first, 40).alias("name"))


def packed_bits(spark, sf_dir):
    rows = W.packed_bits(grey_pages(spark, sf_dir), "v").select("id", "bits_width", F.posexplode("bits").alias("k", "value"))
    return rows.select("id", F.floor(F.col("k") / F.col("bits_width")).cast("int").alias("y"), (F.col("k") % F.col("bits_width")).alias("byte"), "value")


def composite(spark, sf_dir):
    """Pixels in front where the mask is set, else those behind."""
    g = grey_pages(spark, sf_dir).withColumns({"m": F.transform("v", lambda x: (x < 120).cast("int")), "behind": F.transform("v", lambda x: 255 - x)})
    return W.long_form(W.composite(g, "m", "v", "behind", "out"), "out").withColumnRenamed("out", "v")


def image_coverage(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("page"), (F.col("p_size") * 10).alias("w"), (F.col("p_size") * 20).alias("h"), F.lit(72.0).alias("page_w"), (F.col("p_partkey") % 50 * 0 + 144.0).alias("page_h"))
    return D.image_coverage(parts, "page").select("page", F.round("coverage", 6).alias("coverage"))


def page_structure(spark, sf_dir):
    """Pages that draw one image and nothing else; operators within strings do not count."""
    turn = F.col("page_id")
    stream = F.concat(F.lit("q /Im0 Do Q (x Do f) "), F.when(turn % 3 == 0, "/Im1 Do ").otherwise(""), F.when(turn % 5 == 0, "(y) Tj ").otherwise(""), F.when(turn % 7 == 0, "0 0 5 5 re f").otherwise(""))
    return D.image_only(table(spark, sf_dir, "pages").select("page_id", stream.alias("stream")), "page_id")


def page_geometry(spark, sf_dir):
    """Turns of conversations beside the pages of the same number."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", F.col("turn").alias("page")).agg(F.min("text").alias("text"))
    geometry = c.select("conv_id", "page", (F.col("page") * 8 + 72).alias("width"))
    pages = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("pages"))
    out = D.page_geometry(c.join(pages, "conv_id"), geometry, "conv_id")
    return out.select("conv_id", "page", "width", F.length("text").cast("long").alias("chars"))


def preset_arguments(spark, sf_dir):
    """Resolutions, quantiser factor and layer qualities of each delivered row's preset, and what redoing it would take."""
    v = versions(spark, sf_dir).withColumn("preset", F.element_at(F.array(*map(F.lit, ["maximum", "balanced", "smallest"])), (F.col("qty") % 3 + 1).cast("int")))
    out = v.join(F.broadcast(pricing.presets(spark)), "preset")  # three rows
    state = F.when(F.col("searchable"), "instantSwitch").when(F.col("state") == "done", "armed").otherwise("none")
    rate = F.when(F.col("pos") != 2, F.col("pos") / 4.0)
    return out.select("run", "pos", "preset", "dpi", "mono_dpi", "q_factor", "background", "foreground", T.mechanism_line(state, F.col("dpi"), rate, F.col("qty") - 1, F.col("pos") == 5).alias("line"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    composed_documents, object_index, inspected_documents, dictionary_lookup, unescaped_names, byte_texts, budgeted_names, packed_bits, composite, image_coverage, page_structure, page_geometry, preset_arguments)}

_OBJECTS = r"""u AS (SELECT page_id, url, encode(html) AS html,
  encode('q 612.00 0 0 792.00 0 0 cm /Im0 Do Q' || chr(10)) AS c0,
  encode('BT 3 Tr /F1 49.50 Tf ' || printf('%.2f', least(1000.0::DOUBLE, greatest(1.0::DOUBLE, 76.5::DOUBLE / greatest(1.0::DOUBLE, length(url) * 0.5::DOUBLE * 49.5::DOUBLE) * 100))) ||
    ' Tz 1 0 0 1 306.00 198.00 Tm (' || regexp_replace(url, '([\\()])', '\\\1', 'g') || ') Tj ET' || chr(10)) AS c1 FROM pages),
b AS (SELECT page_id, encode('%PDF-1.4' || chr(10)) AS h, chr(10) || 'endobj' || chr(10) AS e,
  encode('1 0 obj' || chr(10) || '<< /Type /Catalog /Pages 2 0 R >>' || e) AS b1,
  encode('2 0 obj' || chr(10) || '<< /Type /Pages /Kids [3 0 R 6 0 R] /Count 2 >>' || e) AS b2,
  encode('3 0 obj' || chr(10) || '<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612.00 792.00] /Contents 4 0 R /Resources << /XObject << /Im0 5 0 R >> /Font << /F1 8 0 R >> >> >>' || e) AS b3,
  encode('4 0 obj' || chr(10) || '<< /Length ' || octet_length(c0) || ' >>' || chr(10) || 'stream' || chr(10)) || c0 || encode(chr(10) || 'endstream' || e) AS b4,
  encode('5 0 obj' || chr(10) || '<< /Type /XObject /Subtype /Image /Width ' || octet_length(html) || ' /Length ' || octet_length(html) || ' >>' || chr(10) || 'stream' || chr(10)) || html || encode(chr(10) || 'endstream' || e) AS b5,
  encode('6 0 obj' || chr(10) || '<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612.00 792.00] /Contents 7 0 R /Resources << /XObject << >> /Font << /F1 8 0 R >> >> >>' || e) AS b6,
  encode('7 0 obj' || chr(10) || '<< /Length ' || octet_length(c1) || ' >>' || chr(10) || 'stream' || chr(10)) || c1 || encode(chr(10) || 'endstream' || e) AS b7,
  encode('8 0 obj' || chr(10) || '<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>' || e) AS b8 FROM u),
n AS (SELECT page_id, h || b1 || b2 || b3 || b4 || b5 || b6 || b7 || b8 AS body, [octet_length(x) FOR x IN [h, b1, b2, b3, b4, b5, b6, b7, b8]] AS sizes FROM b),
o AS (SELECT page_id, body || encode('xref' || chr(10) || '0 9' || chr(10) || '0000000000 65535 f ' || chr(10) ||
  array_to_string([printf('%010d 00000 n ', list_sum(sizes[1:k])::BIGINT) || chr(10) FOR k IN range(1, 9)], '') ||
  'trailer' || chr(10) || '<< /Size 9 /Root 1 0 R >>' || chr(10) || 'startxref' || chr(10) || octet_length(body) || chr(10) || '%%EOF' || chr(10)) AS document FROM n)"""

SQL: dict[str, str] = {
    "composed_documents": f"WITH {_OBJECTS} SELECT page_id, octet_length(document)::BIGINT AS size, sha256(document) AS digest FROM o",
    "object_index": "SELECT page_id, 8::BIGINT AS n, 8::BIGINT AS largest, true AS has_image FROM pages",
    "inspected_documents": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'corrupt' WHEN page_id % 7 = 0 THEN 'encrypted' ELSE 'ok' END AS status, CASE WHEN page_id % 3 <> 0 AND page_id % 7 <> 0 THEN 2::BIGINT END AS page_count FROM pages",
    "dictionary_lookup": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'absent' WHEN page_id % 5 = 0 THEN 'unparseable' ELSE 'found' END AS status, CASE WHEN page_id % 3 <> 0 AND page_id % 5 <> 0 THEN '(' || page_id || ')' END AS value FROM pages",
    "unescaped_names": "SELECT doc_id, 'A ' || source || '/' AS name FROM documents",
    "byte_texts": """WITH d AS (SELECT doc_id, n_chars * CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 7919 ELSE 7990271 END AS n FROM documents)
SELECT doc_id, CASE WHEN n < 1000 THEN n || ' bytes' WHEN n < 1000000 THEN round(n / 1000.0::DOUBLE)::BIGINT || ' KB' WHEN n < 1000000000 THEN printf('%.1f MB', n / 1000000.0::DOUBLE) ELSE printf('%.2f GB', n / 1000000000.0::DOUBLE) END AS size FROM d""",
    "budgeted_names": """WITH d AS (SELECT doc_id, split_part(text, chr(10), 1) AS line FROM documents)
SELECT doc_id, left(line, (SELECT max(k) FROM range(0, 41) r(k) WHERE k <= length(line) AND octet_length(encode(left(line, k))) <= 40)) AS name FROM d""",
    "packed_bits": f"WITH {PIXELS} SELECT id, y, 0::INT AS byte, sum(CASE WHEN v < 128 THEN 0 ELSE 2 ** (7 - x) END)::INT AS value FROM p GROUP BY id, y",
    "composite": f"WITH {PIXELS} SELECT id, x, y, CASE WHEN v < 120 THEN v ELSE 255 - v END AS v FROM p",
    "image_coverage": "SELECT p_partkey % 50 AS page, round(sum(p_size * 10 * p_size * 20)::DOUBLE / (72.0::DOUBLE / 72.0::DOUBLE * 100.0::DOUBLE * (144.0::DOUBLE / 72.0::DOUBLE * 100.0::DOUBLE)), 6) AS coverage FROM part GROUP BY 1",
    "page_structure": "SELECT page_id, page_id % 3 <> 0 AND page_id % 5 <> 0 AND page_id % 7 <> 0 AS image_only FROM pages",
    "page_geometry": "SELECT conv_id, turn AS page, turn * 8 + 72 AS width, length(min(text))::BIGINT AS chars FROM conversations GROUP BY conv_id, turn",
    "preset_arguments": f"""WITH {VERSIONS}, a AS (SELECT * FROM (VALUES ('maximum', 300, 600, 0.76::DOUBLE, 0.4::DOUBLE, 0.3::DOUBLE), ('balanced', 150, 300, 1.5::DOUBLE, 0.4::DOUBLE, 0.3::DOUBLE),
  ('smallest', 100, 300, 3.0::DOUBLE, 0.3::DOUBLE, 0.25::DOUBLE)) t(preset, dpi, mono_dpi, q_factor, background, foreground)),
m AS (SELECT v.*, a.*, greatest(1, round(pos / 4.0::DOUBLE * (qty - 1))::BIGINT) AS secs FROM v JOIN a ON a.preset = (['maximum', 'balanced', 'smallest'])[(qty % 3 + 1)::INT])
SELECT run, pos, preset, dpi, mono_dpi, q_factor, background, foreground, CASE WHEN pos = 5 THEN 'Not included' WHEN searchable THEN 'Already on disk — swapped in immediately'
  WHEN state = 'done' THEN 'Redone from the original at ' || dpi || ' DPI' || CASE WHEN pos <> 2 AND qty > 1 THEN ' · about ' || secs || CASE WHEN secs = 1 THEN ' second' ELSE ' seconds' END ELSE '' END
  ELSE 'Already optimised — nothing to change' END AS line FROM m""",
}
