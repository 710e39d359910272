"""Queries of files' endings, updates and positioned text, over files composed from pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.bindings_lists import _packed_document
from quire.plans.bindings_rows import table
from quire.plans.bindings_sources import made
from quire.plans.staging import stage_rows
from quire.sources import composed as C, files
from quire.sources.content import references, text_lines
from quire.sources.structure import parsed
from quire.sources.updates import file_runs, text_sections


def file_endings(spark, sf_dir):
    """Composed files whose image bytes hold the words of an ending, every third one followed by a second ending of its own."""
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.encode("html", "UTF-8"), F.lit("\ntrailer\n<< /Size 3 /Root 77 0 R /Encrypt 5 0 R >>\nstartxref\n1\n%%EOF\n").cast("binary")).alias("data"))
    image = F.array(F.struct(F.lit("/Width 1").alias("dict"), F.col("data"), F.lit(None).cast("int").alias("mask"))).cast(C.IMAGES)
    docs = C.composed(p.select("page_id", F.lit(0).alias("page"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), image.alias("images"), F.array().cast(C.TEXT).alias("text")), "page_id")
    tail = F.concat(F.lit("xref\n0 0\ntrailer\n<< /Size 40 /Prev 9 >>\nstartxref\n"), F.octet_length("document").cast("string"), F.lit("\n%%EOF\n")).cast("binary")
    lost = F.concat(F.lit("startxref\n"), (F.octet_length("document") * 9).cast("string"), F.lit("\n%%EOF\n")).cast("binary")
    docs = docs.withColumn("content", F.when(F.col("page_id") % 3 == 0, F.concat("document", tail)).when(F.col("page_id") % 3 == 1, F.concat("document", lost)).otherwise(F.col("document")))
    told = parsed(docs.select("page_id", "content"), "page_id")
    ends = F.max("ending")
    return told.groupBy("page_id").agg(ends.alias("e"), F.count("obj").alias("objects")).select("page_id", "e.state", "e.root", "e.form", "e.size", "e.encrypted", "objects")


def _sources(spark, sf_dir):
    """Composed files, and ones whose objects are packed."""
    docs = made(spark, sf_dir)
    return docs.select("page_id", F.when(F.col("page_id") % 2 == 0, F.col("document")).otherwise(_packed_document("page_id")).alias("content"))


def text_layers(spark, sf_dir):
    """Files with an update that puts text on their first page; what is read back from the updated bytes."""
    docs = stage_rows(_sources(spark, sf_dir), "sources")
    label = F.concat(F.lit("Layer ("), F.col("page_id").cast("string"), F.lit(")"))
    text = docs.where("page_id % 5 > 0").select("page_id", F.when(F.col("page_id") % 7 == 0, 9).otherwise(0).alias("page"), F.lit(0).alias("run"), label.alias("text"), F.lit(0.25).alias("x"), F.lit(0.5).alias("y"), F.lit(0.5).alias("w"), F.lit(0.03125).alias("h"))
    sections = stage_rows(text_sections(docs, text, "page_id"), "sections")
    updated = docs.join(sections, "page_id").withColumn("after", files.incremental(F.col("content"), F.col("section")))
    updated = stage_rows(updated.withColumn("section_text", F.decode(F.coalesce("section", F.lit("").cast("binary")), "ISO-8859-1")), "updated")
    old = F.octet_length("content")
    told = stage_rows(parsed(updated.select("page_id", F.col("after").alias("content")), "page_id"), "parsed")
    new = told.join(updated.select("page_id", old.alias("old")), "page_id").where("start >= old").groupBy("page_id").agg(F.count(F.lit(1)).alias("new_objects"), F.max("obj").alias("largest"))
    ends = told.where("obj IS NULL").select("page_id", "ending.form", "ending.root", "ending.size", F.col("ending.startxref").alias("place"))
    offsets = F.transform(F.regexp_extract_all("section_text", F.lit(r"(?m)^(\d{10}) \d{5} n $"), 1), lambda x: x.cast("int"))
    begins = lambda at: F.decode(F.substring(F.col("after"), at + 1, F.lit(20)), "ISO-8859-1").rlike(r"^\d+ \d+ obj")
    there = F.decode(F.substring(F.col("after"), (F.col("place") + 1).cast("int"), F.lit(20)), "ISO-8859-1").rlike(r"^(xref\n|\d+ 0 obj|%PDF)")
    runs = file_runs(updated.where("section IS NOT NULL").select("page_id", F.col("after").alias("content")), "page_id").where("NOT visible AND text LIKE 'Layer%'")
    out = updated.join(ends, "page_id").join(new, "page_id", "left").join(runs.select("page_id", "page", "text", *[F.round(c, 2).alias(c) for c in "xywh"]), "page_id", "left")
    return out.select(
        "page_id", "status", files.verbatim_prefix(F.col("content"), F.col("after")).alias("is_prefix"), "form", "root", "size", F.coalesce("new_objects", F.lit(0)).alias("new_objects"), "largest",
        (F.forall(offsets, begins) & there).alias("places_right"), "page", "text", "x", "y", "w", "h")


def nested_reference_lists(spark, sf_dir):
    """References of an array's own level, past dictionaries, arrays, strings and comments with references inside."""
    n = F.col("page_id").cast("string")
    value = F.concat(F.lit("[1 0 R << /A "), n, F.lit(" 0 R /B [4 0 R] >> "), n, F.lit(" 2 R [5 0 R << /C 6 0 R >>] (7 0 R \\) x) <38203020> % 9 0 R\n 8 0 R]"))
    found = F.transform(references(value.cast("binary")), lambda r: F.concat_ws("/", r["obj"].cast("string"), r["gen"].cast("string")))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(found, ",").alias("found"))


def positioned_text(spark, sf_dir):
    """Lines of the text of composed pages, with their boxes."""
    docs = made(spark, sf_dir).select("page_id", F.col("document").alias("content"))
    lines = text_lines(file_runs(docs, "page_id"), "page_id")
    return lines.select("page_id", "page", "line", "text", *[F.round(c, 3).alias(c) for c in "xywh"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (file_endings, text_layers, nested_reference_lists, positioned_text)}

SQL: dict[str, str] = {
    "file_endings": """SELECT page_id, 'open' AS state, 1::BIGINT AS root, 'table' AS form, CASE WHEN page_id % 3 = 0 THEN 40 ELSE 7 END::BIGINT AS size, false AS encrypted, 6::BIGINT AS objects FROM pages""",
    "text_layers": """WITH s AS (SELECT page_id, page_id % 2 = 0 AS composed, CASE WHEN page_id % 5 = 0 THEN 'unchanged' WHEN page_id % 7 = 0 THEN 'unsupported' ELSE 'ok' END AS status FROM pages)
SELECT page_id, status, true AS is_prefix, CASE WHEN composed THEN 'table' ELSE 'stream' END AS form, 1::BIGINT AS root,
  CASE WHEN status = 'ok' THEN CASE WHEN composed THEN 11 ELSE 13 END ELSE CASE WHEN composed THEN 9 ELSE 1 END END::BIGINT AS size,
  CASE WHEN status = 'ok' THEN CASE WHEN composed THEN 3 ELSE 4 END ELSE 0 END::BIGINT AS new_objects, CASE WHEN status = 'ok' THEN CASE WHEN composed THEN 10 ELSE 12 END END::BIGINT AS largest,
  true AS places_right, CASE WHEN status = 'ok' THEN 0 END::BIGINT AS page, CASE WHEN status = 'ok' THEN 'Layer (' || page_id || ')' END AS text,
  CASE WHEN status = 'ok' THEN 0.25::DOUBLE END AS x, CASE WHEN status = 'ok' THEN 0.5::DOUBLE END AS y, CASE WHEN status = 'ok' THEN 0.5::DOUBLE END AS w, CASE WHEN status = 'ok' THEN 0.03::DOUBLE END AS h FROM s""",
    "nested_reference_lists": "SELECT page_id, '1/0,' || page_id || '/2,8/0' AS found FROM pages",
    "positioned_text": """SELECT page_id, 1::BIGINT AS page, 0::INT AS line, url AS text, 0.5::DOUBLE AS x, 0.25::DOUBLE AS y, 0.125::DOUBLE AS w, 0.063::DOUBLE AS h FROM pages""",
}
