"""New documents from pages of full-page images with invisible text.

Each object of a document is a row: numbers come from a sum over the pages before, offsets from a sum
over the objects before, and the bytes are put together by an ordered aggregate, all in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.geometry import text_scale
from quire.functions.numbers import number_text
from quire.functions.text import escaped, lossy
from quire.operators.ordered import object_numbers

HEADER = "%PDF-1.4\n"
IMAGES = "array<struct<dict:string,data:binary,mask:int>>"
TEXT = "array<struct<text:string,x:double,y:double,w:double,h:double>>"


def _latin(*parts: Column | str) -> Column:
    return F.encode(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), "ISO-8859-1")


def _stream(head: Column | str, data: Column) -> Column:
    return F.concat(_latin("<< ", head, "/Length ", F.octet_length(data), " >>\nstream\n"), data, _latin("\nendstream"))


def content_stream(width: Column, height: Column, images: Column, text: Column) -> Column:
    """Operators that draw all images that are no masks over the whole page, and show the text invisibly."""
    masks = F.transform(F.filter(images, lambda i: i["mask"].isNotNull()), lambda i: i["mask"])
    shown = F.filter(F.sequence(F.lit(0), F.size(images) - 1), lambda k: ~F.array_contains(masks, k))
    shown = F.when(F.size(images) > 0, shown).otherwise(F.array().cast("array<int>"))
    draws = F.transform(shown, lambda k: F.concat(F.lit("q "), number_text(width), F.lit(" 0 0 "), number_text(height), F.lit(" 0 0 cm /Im"), k.cast("string"), F.lit(" Do Q\n")))

    def run(t: Column) -> Column:
        size, scale = text_scale(F.char_length(t["text"]), t["w"], t["h"], width, height)
        return F.concat(
            F.lit("BT 3 Tr /F1 "), number_text(size), F.lit(" Tf "), number_text(scale), F.lit(" Tz 1 0 0 1 "),
            number_text(t["x"] * width), F.lit(" "), number_text(t["y"] * height), F.lit(" Tm ("), escaped(t["text"]), F.lit(") Tj ET\n"))

    return F.array_join(F.concat(draws, F.transform(text, run)), "")


def page_objects(pages: DataFrame, key: str, page: str = "page") -> DataFrame:
    """(key, obj, body): objects of each document: catalog 1, page tree 2, pages from 3 on, and the font last.

    pages have width and height in points, images (dict, data, mask: the place of the image's mask in
    the array) and text (text, and its box in shares of the page).  A page takes an object for itself,
    one for its contents and one for each image.  Null arrays count as empty.  A size that is not
    finite and positive, or text outside Latin-1, is an error.
    """
    width, height = F.col("width").cast("double"), F.col("height").cast("double")
    rows = pages.select(
        key, page, width.alias("w"), height.alias("h"), F.coalesce(F.col("images").cast(IMAGES), F.array().cast(IMAGES)).alias("images"), F.coalesce(F.col("text").cast(TEXT), F.array().cast(TEXT)).alias("text"))
    bounded = lambda x: F.coalesce((x > 0) & (x < float("inf")), F.lit(False))
    rows = rows.where(F.assert_true(bounded(F.col("w")) & bounded(F.col("h")), F.lit("a page's size must be finite and positive")).isNull())
    rows = rows.where(F.assert_true(~F.exists("text", lambda t: F.coalesce(lossy(t["text"]), F.lit(True))), F.lit("text outside Latin-1")).isNull())
    rows = object_numbers(rows.withColumn("n", F.size("images") + 2), [key], [page], "n")
    rows = rows.withColumn("font", F.sum("n").over(Window.partitionBy(key)) + 3)
    first = F.col("first_object")
    names = F.array_join(F.transform("images", lambda i, k: F.concat(F.lit("/Im"), k.cast("string"), F.lit(" "), (first + 2 + k).cast("string"), F.lit(" 0 R "))), "")
    leaf = _latin(
        "<< /Type /Page /Parent 2 0 R /MediaBox [0 0 ", number_text(F.col("w")), " ", number_text(F.col("h")), "] /Contents ", first + 1,
        " 0 R /Resources << /XObject << ", names, ">> /Font << /F1 ", F.col("font"), " 0 R >> >> >>")
    contents = _stream("", _latin(content_stream(F.col("w"), F.col("h"), F.col("images"), F.col("text"))))

    def image(i: Column, k: Column) -> Column:
        mask = F.when(i["mask"].isNull(), "").otherwise(F.concat(F.lit("/SMask "), (first + 2 + i["mask"]).cast("string"), F.lit(" 0 R ")))
        head = F.concat(F.lit("/Type /XObject /Subtype /Image "), i["dict"], F.lit(" "), mask)
        return F.struct((first + 2 + k).alias("obj"), _stream(head, i["data"]).alias("body"))

    own = F.array(F.struct(first.alias("obj"), leaf.alias("body")), F.struct((first + 1).alias("obj"), contents.alias("body")))
    parts = rows.select(key, F.explode(F.concat(own, F.transform("images", image))).alias("o")).select(key, "o.obj", "o.body")
    tree = rows.groupBy(key).agg(F.sort_array(F.collect_list("first_object")).alias("kids"), F.max("font").alias("font"))
    kids = F.array_join(F.transform("kids", lambda k: F.concat(k.cast("string"), F.lit(" 0 R"))), " ")
    fixed = tree.select(key, F.explode(F.array(
        F.struct(F.lit(1).cast("long").alias("obj"), _latin("<< /Type /Catalog /Pages 2 0 R >>").alias("body")),
        F.struct(F.lit(2).cast("long").alias("obj"), _latin("<< /Type /Pages /Kids [", kids, "] /Count ", F.size("kids"), " >>").alias("body")),
        F.struct(F.col("font").alias("obj"), _latin("<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>").alias("body")),
    )).alias("o")).select(key, "o.obj", "o.body")
    return parts.unionByName(fixed)


def composed(pages: DataFrame, key: str, page: str = "page") -> DataFrame:
    """(key, document): one new document of each key's pages in order; see page_objects for the columns.

    A document is one value, so it may have two gigabytes at most.  Pages of equal order within a
    document come in any order; an empty table gives no documents.
    """
    objects = page_objects(pages, key, page)
    objects = objects.select(key, "obj", F.concat(_latin(F.col("obj"), " 0 obj\n"), F.col("body"), _latin("\nendobj\n")).alias("bytes"))
    before = Window.partitionBy(key).orderBy("obj").rowsBetween(Window.unboundedPreceding, -1)
    objects = objects.withColumn("at", F.coalesce(F.sum(F.octet_length("bytes")).over(before), F.lit(0)) + len(HEADER))
    objects = objects.withColumn("entry", F.format_string("%010d 00000 n \n", "at"))
    ordered = objects.groupBy(key).agg(
        F.expr("listagg(bytes) WITHIN GROUP (ORDER BY obj)").alias("all"), F.expr("listagg(entry) WITHIN GROUP (ORDER BY obj)").alias("entries"), (F.max("obj") + 1).alias("size"))
    tail = _latin(
        "xref\n0 ", F.col("size"), "\n0000000000 65535 f \n", F.col("entries"), "trailer\n<< /Size ", F.col("size"), " /Root 1 0 R >>\nstartxref\n",
        F.octet_length("all") + len(HEADER), "\n%%EOF\n")
    return ordered.select(key, F.concat(_latin(HEADER), F.col("all"), tail).alias("document"))
