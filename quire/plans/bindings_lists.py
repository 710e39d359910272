"""Queries of lists, names, files and larger pages over stand-in columns.

Larger pages are put together of embeddings: each is a tile of 8 x 8 pixels.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from quire.functions import geometry as G, numbers as N, pricing, rows as R, text as T
from quire.operators import keyed as K, pages as W, pixels as P, totals as A
from quire.plans.bindings_more import OTSU, PIXELS, grey_pages
from quire.plans.bindings_rows import CLASSED, FILES, VERSIONS, files, table, versions
from quire.plans.staging import stage_path
from quire.sources import composed as C, documents as D, files as B, history as H


def change_quality_totals(spark, sf_dir):
    """Bytes of each run under each preset: a row of the list is excluded, at the preset, tried in vain, or predicted."""
    presets = F.array(*map(F.lit, ["maximum", "balanced", "smallest"]))
    v = versions(spark, sf_dir).select(
        "run", F.col("after").alias("current"), F.element_at(presets, (F.col("qty") % 3 + 1).cast("int")).alias("own_preset"),
        F.create_map(F.lit("maximum"), F.floor(F.col("before") * 9 / 10).cast("long"), F.lit("balanced"), F.floor(F.col("before") * 65 / 100).cast("long")).alias("predictions"),
        (F.col("pos") == 5).alias("excluded"), F.when(F.col("searchable"), F.array(F.lit("balanced"))).alias("futile"))
    return A.change_quality_totals(v, pricing.presets(spark), "run")


def free_names(spark, sf_dir):
    """Names of files that neither another file's reservation nor a version card has."""
    name = F.concat(F.when(F.col("doc_id") % 2 == 0, "Scan").otherwise("scan"), (F.col("size") % 997).cast("string"))
    f = files(spark, sf_dir).select(F.col("doc_id").alias("owner"), name.alias("name"), "state", "problem")
    cards = f.where("problem IS NOT NULL").select("owner", F.when(F.col("problem") == "locked", "shipped").otherwise("original").alias("slot"), "name")
    return K.free_names(f.select("owner", "name"), f.where("state IN ('done', 'running')").select("owner", "name"), cards)


def runnable_rows(spark, sf_dir):
    f = files(spark, sf_dir).select("doc_id", "state", "skipped", "problem")
    plans = f.select("doc_id", F.when(F.col("problem").isNull(), "armed").otherwise("none").alias("rerun"))
    return K.runnable(f, f.where("skipped").select("doc_id"), plans, "doc_id")


def completed_removed(spark, sf_dir):
    return K.without_completed(files(spark, sf_dir)).select("doc_id", "state")


def encoded_pages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return A.encoded_pages(c.select("conv_id", F.when(F.length("text") % 3 == 0, "mrcEncoded").when(F.col("role") == "user", "declined").alias("verdict")), "conv_id")


def all_finished(spark, sf_dir):
    v = versions(spark, sf_dir).withColumn("state", F.when(F.col("state") == "running", "done").otherwise(F.col("state")))
    return A.all_finished(v.withColumn("rerun", F.when(F.col("qty") % 11 == 0, "armed").when(F.col("qty") % 11 == 1, "none")), "run")


def lifetime(spark, sf_dir):
    return A.lifetime(A.batch_records(versions(spark, sf_dir), "run"))


def exact_names(spark, sf_dir):
    """Names that avoid those on disk, in any case of letters."""
    base = F.concat(F.when(F.col("doc_id") % 2 == 0, "Scan").otherwise("scan"), (F.col("size") % 23).cast("string"))
    f = files(spark, sf_dir).withColumn("base", base)
    disk = f.where("doc_id % 5 = 0").select("source", F.concat(F.upper("base"), F.lit("-small"), F.when(F.col("doc_id") % 7 > 0, F.concat(F.lit("-"), (F.col("doc_id") % 7).cast("string"))).otherwise(""), F.lit(".pdf")).alias("name"))
    return K.exact_output_names(f, "source", "base", "doc_id", taken=disk).select("doc_id", "output_name")


def delta_texts(spark, sf_dir):
    """The words of a candidate's difference to what is there: same, less, more, or for printing."""
    v = versions(spark, sf_dir)
    candidate = F.when(F.col("qty") % 4 == 0, F.col("before")).when(F.col("qty") % 4 == 1, F.col("before") - F.col("qty") * 1000).otherwise(F.col("before") + F.col("qty") * 100_000)
    return v.select("run", "pos", T.delta_text(F.col("before"), candidate, F.col("qty") % 4 == 3).alias("delta"))


def consent_pairs(spark, sf_dir):
    """Runs whose first two versions are one rebuilt and one plain, in either order."""
    v = versions(spark, sf_dir).withColumn("variant", F.when(F.col("qty") % 3 == 0, "mrc").when(F.col("qty") % 3 == 1, "plain"))
    pair = v.where("pos = 1").select("run", F.col("variant").alias("first")).join(v.where("pos = 2").select("run", F.col("variant").alias("second")), "run")
    return pair.select("run", R.consent(F.col("first"), F.col("second")).alias("consent"))


def swapped_slots(spark, sf_dir):
    v = versions(spark, sf_dir)
    slot = lambda name, size: F.struct(F.concat(F.lit(name), F.col("pos").cast("string")).alias("url"), size.alias("bytes"), F.lit(name).alias("variant"))
    v = v.select("run", "pos", slot("shipped", F.col("after")).alias("shipped"), F.when(F.col("searchable"), slot("parked", F.col("before"))).alias("parked"))
    out = v.withColumns(K.swapped("shipped", "parked", ["bytes", "variant"]))
    return out.select("run", "pos", F.col("shipped.url").alias("url"), F.col("shipped.bytes").alias("bytes"), F.col("shipped.variant").alias("variant"), F.col("parked.url").alias("parked_url"), F.col("parked.bytes").alias("parked_bytes"))


def saved_texts(spark, sf_dir):
    return versions(spark, sf_dir).select("run", "pos", T.saved_text(F.col("before") - F.col("after")).alias("saved"))


def preset_flags(spark, sf_dir):
    """Which preset of each run keeps ink separations."""
    v = versions(spark, sf_dir).withColumn("preset", F.element_at(F.array(*map(F.lit, ["maximum", "balanced", "smallest"])), (F.col("qty") % 3 + 1).cast("int")))
    return v.join(F.broadcast(pricing.presets(spark)), "preset").groupBy("run").agg(F.count_if("keeps_cmyk").alias("kept"), F.max("mono_dpi").alias("mono_dpi"))  # three rows


def placements(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumns({"w": F.col("p_size") * 10.0, "h": (F.col("p_partkey") % 97 + 1) * 8.0, "r": ((F.col("p_partkey") % 9 - 4) * 90).cast("int")})
    at = G.placement(F.lit(0.25), F.lit(0.5), F.lit(0.5), F.lit(0.25), F.length("p_name"), F.lit(3.0), F.lit(5.0), F.col("w"), F.col("h"), F.col("r"))
    return p.select("p_partkey", at.alias("p")).select("p_partkey", "p.x", "p.y", "p.angle", F.round("p.size", 6).alias("size"), F.round("p.scale", 6).alias("scale"))


# files


def appended_files(spark, sf_dir):
    """Files with an update behind their own bytes."""
    p = table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"), F.when(F.col("page_id") % 3 > 0, F.encode("url", "UTF-8")).alias("section"))
    out = p.withColumn("made", B.incremental(F.col("content"), F.col("section")))
    return out.select("page_id", F.octet_length("made").cast("long").alias("size"), B.digest(F.col("made")).alias("digest"), B.verbatim_prefix(F.col("content"), F.col("made")).alias("is_prefix"))


@F.pandas_udf(BinaryType())
def _deflated(text: pd.Series, turn: pd.Series) -> pd.Series:
    """Test bytes: with a zlib header, without one, or broken."""

    def one(t: str, k: int) -> bytes:
        if k == 1:
            c = zlib.compressobj(6, zlib.DEFLATED, -15)
            return c.compress(t.encode()) + c.flush()
        return zlib.compress(t.encode()) if k == 0 else zlib.compress(t.encode())[:-9]

    return pd.Series([one(t, k) for t, k in zip(text, turn)])


def inflated_pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", B.inflated(_deflated("html", F.col("page_id") % 3)).alias("plain"))
    return p.select("page_id", B.digest(F.col("plain")).alias("digest"))


def reference_lists(spark, sf_dir):
    """References in an array, without those in strings and comments."""
    n = F.col("page_id").cast("string")
    text = F.concat(F.lit("[1 0 R ("), n, F.lit(" 0 R \\) x) "), n, F.lit(" 2 R] % 7 0 R\n 8 0 R"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.transform(N.references(text), lambda r: F.concat_ws("/", r["object"].cast("string"), r["generation"].cast("string"))), ",").alias("found"))


def release_feed(spark, sf_dir):
    """Releases with good and bad tags, and images on the right host and on another."""
    n = F.col("page_id")
    host = F.when(n % 5 == 0, "example.org").otherwise("github.com")
    tag = F.when(n % 7 == 0, F.lit("nightly")).otherwise(F.concat(F.lit("v1."), (n % 9).cast("string")))
    feed = F.to_json(F.struct(
        tag.alias("tag_name"), F.concat(F.lit("https://github.com/r/"), n.cast("string")).alias("html_url"),
        F.array(F.struct(F.lit("https://github.com/a.zip").alias("browser_download_url")), F.struct(F.concat(F.lit("https://"), host, F.lit("/a.dmg")).alias("browser_download_url"))).alias("assets")))
    return table(spark, sf_dir, "pages").select("page_id", H.release(feed).alias("r")).select("page_id", "r.version", "r.image")


def history_file(spark, sf_dir):
    """The newest 200 orders written as an envelope and read back."""
    o = table(spark, sf_dir, "orders").select(
        (-F.col("o_orderkey")).alias("pos"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").cast("timestamp").alias("date"), F.col("o_orderpriority").alias("folderName"),
        F.lit("file:///x").alias("folderURL"), F.col("o_custkey").alias("fileCount"), F.lit(None).cast("string").alias("presetTitle"), F.lit(True).alias("compressOn"), F.lit(False).alias("ocrOn"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("savedBytes"))
    path = stage_path(spark, "history")
    H.write_history(o, 20_100, path)
    return H.read_history(spark, path).select(F.col("pos").cast("long").alias("pos"), "id", "folderName", "savedBytes", "successCount")


@F.pandas_udf(BinaryType())
def _packed_document(number: pd.Series) -> pd.Series:
    """Test files whose catalog, tree and pages lie in an object stream; the first page of even ones shows text."""

    def one(n: int) -> bytes:
        pages = n % 4
        kids = b" ".join(b"%d 0 R" % (5 + k) for k in range(pages))
        inner = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [" + kids + b"] /Count %d >>" % pages)]
        inner += [(5 + k, b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>") for k in range(pages)]
        head, body = b"", b""
        for k, d in inner:
            head += b"%d %d " % (k, len(body))
            body += d + b" "
        shown = zlib.compress(b"BT (x) Tj ET" if n % 2 == 0 else b"q (x Tj) Do Q")
        data = zlib.compress(head + body)
        streams = [
            (3, b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (len(inner), len(head), len(data)) + data),
            (4, b"<< /Filter /FlateDecode /Length %d >>\nstream\n" % len(shown) + shown),
        ]
        return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n" % k + d + b"\nendstream\nendobj\n" for k, d in streams) + b"9 0 obj\n<< /Type /XRef /Root 1 0 R >>\nendobj\nstartxref\n0\n%%EOF\n"

    return number.map(one)


def page_trees(spark, sf_dir):
    """A look inside composed files and ones with object streams, some cut, encrypted or missing."""
    from quire.plans.bindings_sources import locked, made

    n = F.col("page_id")
    docs = made(spark, sf_dir).withColumn("content", F.when(n % 2 == 0, F.col("document")).otherwise(_packed_document(n)))
    docs = docs.withColumn("content", F.when(n % 11 == 0, None).when(n % 13 == 0, F.substring("content", F.lit(1), F.lit(40))).when(n % 7 == 0, locked(F.col("content"))).otherwise(F.col("content")))
    return D.inspected(docs.select("page_id", "content"), "page_id")


def masked_images(spark, sf_dir):
    """Composed pages of an image with a mask: the numbers that the image's object names."""
    p = table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("html"), F.encode("url", "UTF-8").alias("url"))
    image = lambda data, mask: F.struct(F.lit("/Width 1").alias("dict"), data.alias("data"), mask.cast("int").alias("mask"))
    pages = p.select("page_id", F.lit(0).alias("page"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.array(image(F.col("html"), F.lit(1)), image(F.col("url"), F.lit(None))).cast(C.IMAGES).alias("images"), F.array().cast(C.TEXT).alias("text"))
    objects = C.page_objects(pages, "page_id").select("page_id", "obj", F.decode("body", "ISO-8859-1").alias("body"))
    mask = F.max(F.when(F.col("obj") == 5, F.regexp_extract("body", r"/SMask (\d+) 0 R", 1))).cast("long")
    drawn = F.max(F.when(F.col("obj") == 4, F.size(F.regexp_extract_all("body", F.lit("(Do)"), 1))))
    return objects.groupBy("page_id").agg(F.count(F.lit(1)).alias("objects"), mask.alias("mask_object"), drawn.alias("drawn"))


# larger pages


def tiles(spark, sf_dir, across: int) -> DataFrame:
    """Square pages of across x across tiles, as whole rows; -1 where the last page has no tile."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def laid(parts: pd.Series) -> pd.Series:
        def one(tiles: list) -> np.ndarray:
            page = np.full((across, 8, across, 8), -1, np.int32)
            for t in tiles:
                page[t["tile"] // across, :, t["tile"] % across, :] = np.asarray(t["v"]).reshape(8, 8)
            return page.ravel()

        return parts.map(one)

    n = across * across
    pages = grey_pages(spark, sf_dir).select(F.floor(F.col("id") / n).cast("long").alias("id"), F.struct((F.col("id") % n).cast("int").alias("tile"), "v").alias("t"))
    return pages.groupBy("id").agg(F.collect_list("t").alias("t")).select("id", F.lit(across * 8).alias("width"), laid("t").alias("v"))  # n tiles a page


def _tiles(across: int) -> str:
    """SQL of the same, as g."""
    n = across * across
    return PIXELS.replace("p AS (", "t AS (", 1) + f""", g AS (SELECT id // {n} AS id, (id % {n} % {across} * 8 + x)::INT AS x, (id % {n} // {across} * 8 + y)::INT AS y, v FROM t)"""


def _marks(pages: DataFrame) -> DataFrame:
    """Pages of marks on white, two or three pixels wide; those of two have gaps and on every third page a tint."""
    wide = F.when(F.col("id") % 4 == 3, 3).otherwise(2)

    def shade(tint):
        def one(v, k):
            on = (k % F.col("width") % 4 < wide) & (F.floor(k / F.col("width")) % 4 < wide) & ((wide == 3) | (v % 5 > 0))
            return F.when(v < 0, -1).when(on, F.floor(v / 2).cast("int") + tint).otherwise(255).cast("int")

        return F.transform("v", one)

    return pages.select("id", "width", shade((F.col("id") % 3 * 20).cast("int")).alias("r"), *(shade(F.lit(0)).alias(c) for c in "gb"))


_MARKS = _tiles(8) + """, m AS (SELECT *, CASE WHEN id % 4 = 3 THEN 3 ELSE 2 END AS wide FROM g),
dk AS (SELECT id, x, y, CASE WHEN x % 4 < wide AND y % 4 < wide AND (wide = 3 OR v % 5 > 0) THEN v // 2 END AS dark FROM m),
c AS (SELECT id, x, y, coalesce(dark + id % 3 * 20, 255) AS r, coalesce(dark, 255) AS g, coalesce(dark, 255) AS b FROM dk)"""
_LUMA = _MARKS + """, p AS (SELECT id, x, y, ((r * 299 + g * 587 + b * 114) // 1000)::INT AS v, greatest(r, g, b) - least(r, g, b) AS chroma FROM c)"""


def page_features(spark, sf_dir):
    out = W.features(_marks(tiles(spark, sf_dir, 8)), "r", "g", "b").drop("width", "r", "g", "b")
    return out.withColumn("mean_area", F.round("mean_area", 6))


def colour_statistics(spark, sf_dir):
    """Extremes and coloured pixels of pages in colour."""
    c = _marks(tiles(spark, sf_dir, 8)).select("id", "width", F.arrays_zip("r", "g", "b").alias("p"))
    grey_ = lambda x: F.when(x["r"] < 0, -1).otherwise(P.luminance(x["r"], x["g"], x["b"]))
    c = c.select("id", "width", F.transform("p", grey_).alias("v"), F.transform("p", lambda x: P.chroma(x["r"], x["g"], x["b"])).alias("c"))
    return W.statistics(c, "v", "c").drop("width", "v", "c")


def local_threshold(spark, sf_dir):
    """Ink against squares of 31 x 31 pixels, by page."""
    pages = tiles(spark, sf_dir, 8)
    out = W.local_ink(pages, "v").withColumn("here", F.transform("v", lambda x: x >= 0))
    kept = lambda name: F.transform(F.filter(F.arrays_zip("here", name), lambda x: x["here"]), lambda x: x[name])
    n = kept("n")
    return out.select("id", F.size(F.filter("ink", lambda x: x)).cast("long").alias("ink"), F.array_max(n).alias("largest"), F.array_min(n).alias("smallest"), F.aggregate(kept("s"), F.lit(0).cast("long"), lambda a, x: a + x).alias("s"))


def strided_ink(spark, sf_dir):
    pages = tiles(spark, sf_dir, 20).withColumn("v", F.transform("v", lambda x: x * 2))
    return W.ink_ratio(pages, "v").drop("width", "v")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    change_quality_totals, free_names, runnable_rows, completed_removed, encoded_pages, all_finished, lifetime, exact_names, delta_texts, consent_pairs, swapped_slots, saved_texts, preset_flags, placements,
    appended_files, inflated_pages, reference_lists, release_feed, history_file, page_trees, masked_images, page_features, colour_statistics, local_threshold, strided_ink)}

_BYTES = lambda n: f"CASE WHEN {n} < 1000 THEN {n} || ' bytes' WHEN {n} < 1000000 THEN round({n} / 1000.0::DOUBLE)::BIGINT || ' KB' WHEN {n} < 1000000000 THEN printf('%.1f MB', {n} / 1000000.0::DOUBLE) ELSE printf('%.2f GB', {n} / 1000000000.0::DOUBLE) END"
_NAMED = "n AS (SELECT doc_id AS owner, CASE WHEN doc_id % 2 = 0 THEN 'Scan' ELSE 'scan' END || size % 997 AS name, state, problem FROM f)"

SQL: dict[str, str] = {
    "change_quality_totals": f"""WITH {VERSIONS}, r AS (SELECT v.*, c.preset, (['maximum', 'balanced', 'smallest'])[(qty % 3 + 1)::INT] AS own FROM v CROSS JOIN (VALUES ('maximum'), ('balanced'), ('smallest')) c(preset)),
s AS (SELECT *, pos = 5 OR own = preset OR (searchable AND preset = 'balanced') AS stays FROM r)
SELECT run, preset, sum(CASE WHEN stays OR preset = 'smallest' THEN after WHEN preset = 'maximum' THEN before * 9 // 10 ELSE before * 65 // 100 END)::BIGINT AS total_bytes, count(*) FILTER (NOT stays) AS changed FROM s GROUP BY run, preset""",
    "free_names": f"""WITH {FILES}, {_NAMED} SELECT owner, name FROM n WHERE NOT EXISTS (SELECT 1 FROM n l WHERE l.state IN ('done', 'running') AND lower(l.name) = lower(n.name) AND l.owner <> n.owner)
  AND NOT EXISTS (SELECT 1 FROM n c WHERE c.problem = 'locked' AND lower(c.name) = lower(n.name))""",
    "runnable_rows": f"WITH {FILES} SELECT doc_id, CASE WHEN state = 'queued' THEN 'first' ELSE 'again' END AS plan FROM f WHERE (state = 'queued' AND NOT coalesce(skipped, false)) OR (state = 'done' AND problem IS NULL)",
    "completed_removed": f"WITH {CLASSED} SELECT doc_id, state FROM k WHERE state NOT IN ('done', 'failed')",
    "encoded_pages": "SELECT conv_id, count(*) FILTER (length(text) % 3 = 0) AS encoded, count(*) AS pages FROM conversations GROUP BY conv_id",
    "all_finished": f"WITH {VERSIONS} SELECT run, bool_and(state IN ('done', 'failed', 'running')) AND NOT bool_or(qty % 11 = 0) AS all_finished FROM v GROUP BY run",
    "lifetime": f"""WITH {VERSIONS}, b AS (SELECT run, sum(CASE WHEN queued AND state = 'done' THEN greatest(0, before - after) ELSE 0 END) AS saved, count(*) FILTER (queued AND state = 'done') AS ok, bool_or(cancelled) AS gone FROM v GROUP BY run)
SELECT coalesce(sum(saved), 0)::BIGINT AS lifetime_saved, count(*) AS batches FROM b WHERE NOT (gone AND ok = 0)""",
    "exact_names": f"""WITH {FILES}, b AS (SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN 'Scan' ELSE 'scan' END || size % 23 AS base FROM f),
o AS (SELECT *, lower(base) AS key, row_number() OVER (PARTITION BY source, lower(base) ORDER BY doc_id) AS turn FROM b),
u AS (SELECT DISTINCT source, lower(base) AS key, doc_id % 7 AS k FROM b WHERE doc_id % 5 = 0),
h AS (SELECT source, key, count(*) + 7 AS top FROM o GROUP BY source, key), c AS (SELECT source, key, unnest(range(0, top)) AS k FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY source, key ORDER BY k) AS turn FROM c WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.source = c.source AND u.key = c.key AND u.k = c.k))
SELECT doc_id, base || '-small' || CASE WHEN k > 0 THEN '-' || k ELSE '' END || '.pdf' AS output_name FROM o JOIN r ON o.source = r.source AND o.key = r.key AND o.turn = r.turn""",
    "delta_texts": f"""WITH {VERSIONS}, d AS (SELECT run, pos, qty, CASE qty % 4 WHEN 0 THEN 0 WHEN 1 THEN -qty * 1000 ELSE qty * 100000 END AS more FROM v)
SELECT run, pos, CASE WHEN more = 0 THEN 'what you have' WHEN more < 0 THEN {_BYTES('(-more)')} || ' less' WHEN qty % 4 = 3 THEN 'for printing' ELSE {_BYTES('more')} || ' more' END AS delta FROM d""",
    "consent_pairs": f"""WITH {VERSIONS}, a AS (SELECT run, qty % 3 AS k FROM v WHERE pos = 1), b AS (SELECT run, qty % 3 AS k FROM v WHERE pos = 2)
SELECT a.run, (a.k = 0 AND b.k = 1) OR (a.k = 1 AND b.k = 0) AS consent FROM a JOIN b ON a.run = b.run""",
    "swapped_slots": f"""WITH {VERSIONS} SELECT run, pos, 'shipped' || pos AS url, CASE WHEN searchable THEN before ELSE after END AS bytes, CASE WHEN searchable THEN 'parked' ELSE 'shipped' END AS variant,
  CASE WHEN searchable THEN 'parked' || pos END AS parked_url, CASE WHEN searchable THEN after END AS parked_bytes FROM v""",
    "saved_texts": f"WITH {VERSIONS}, d AS (SELECT run, pos, before - after AS n FROM v) SELECT run, pos, CASE WHEN n <= 0 THEN 'no change' ELSE {_BYTES('n')} END AS saved FROM d",
    "preset_flags": f"WITH {VERSIONS} SELECT run, count(*) FILTER (qty % 3 = 0) AS kept, max(CASE WHEN qty % 3 = 0 THEN 600 ELSE 300 END)::INT AS mono_dpi FROM v GROUP BY run",
    "placements": """WITH p AS (SELECT p_partkey, length(p_name) AS n, p_size * 10.0::DOUBLE AS w, (p_partkey % 97 + 1) * 8.0::DOUBLE AS h, ((((p_partkey % 9 - 4) * 90) % 360 + 360) % 360)::INT AS r FROM part),
q AS (SELECT *, CASE WHEN r IN (90, 270) THEN h ELSE w END AS sw, CASE WHEN r IN (90, 270) THEN w ELSE h END AS sh FROM p), s AS (SELECT *, greatest(1.0::DOUBLE, 0.25::DOUBLE * sh) AS size, 0.25::DOUBLE * sw AS dx, 0.5::DOUBLE * sh AS dy FROM q)
SELECT p_partkey, CASE r WHEN 90 THEN w - dy WHEN 180 THEN w - dx WHEN 270 THEN dy ELSE dx END + 3.0::DOUBLE AS x, CASE r WHEN 90 THEN dx WHEN 180 THEN h - dy WHEN 270 THEN h - dx ELSE dy END + 5.0::DOUBLE AS y, r AS angle, round(size, 6) AS size,
  round(least(1000.0::DOUBLE, greatest(1.0::DOUBLE, greatest(1.0::DOUBLE, 0.5::DOUBLE * sw) / greatest(1.0::DOUBLE, n * 0.5::DOUBLE * size) * 100)), 6) AS scale FROM s""",
    "appended_files": "WITH m AS (SELECT page_id, html || CASE WHEN page_id % 3 > 0 THEN url ELSE '' END AS made FROM pages) SELECT page_id, octet_length(encode(made))::BIGINT AS size, sha256(made) AS digest, true AS is_prefix FROM m",
    "inflated_pages": "SELECT page_id, CASE WHEN page_id % 3 < 2 THEN sha256(html) END AS digest FROM pages",
    "reference_lists": "SELECT page_id, '1/0,' || page_id || '/2,8/0' AS found FROM pages",
    "release_feed": "SELECT page_id, CASE WHEN page_id % 7 > 0 THEN '1.' || page_id % 9 END AS version, CASE WHEN page_id % 7 > 0 AND page_id % 5 > 0 THEN 'https://github.com/a.dmg' END AS image FROM pages",
    "history_file": """SELECT row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS pos, o_orderkey::VARCHAR AS id, o_orderpriority AS "folderName", round(o_totalprice * 100)::BIGINT AS "savedBytes", 0::BIGINT AS "successCount" FROM orders ORDER BY o_orderkey DESC LIMIT 200""",
    "page_trees": """WITH s AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'missing' WHEN page_id % 13 = 0 THEN 'corrupt' WHEN page_id % 7 = 0 THEN 'encrypted' ELSE 'open' END AS state, CASE WHEN page_id % 2 = 0 THEN 2 ELSE page_id % 4 END AS n FROM pages)
SELECT page_id, CASE WHEN state <> 'open' THEN state WHEN n > 0 THEN 'ok' ELSE 'noPages' END AS status, CASE WHEN state = 'open' THEN n::BIGINT END AS page_count, CASE WHEN state = 'open' AND n > 0 THEN false END AS has_text FROM s""",
    "masked_images": "SELECT page_id, 7::BIGINT AS objects, 6::BIGINT AS mask_object, 1 AS drawn FROM pages",
    "page_features": f"""WITH {OTSU.replace(PIXELS, _LUMA)}, f AS (SELECT p.id, threshold, count(*) AS n, count(*) FILTER (v < threshold) AS ink, count(*) FILTER (chroma > 40) AS coloured, count(*) FILTER (chroma > 25) AS moderate FROM p JOIN o ON p.id = o.id GROUP BY p.id, threshold),
ce AS (SELECT p.id, x // 4 AS cx, y // 4 AS cy, count(*) FILTER (v < threshold) AS area FROM p JOIN o ON p.id = o.id GROUP BY 1, 2, 3), a AS (SELECT id, count(*) FILTER (area >= 3) AS components, coalesce(avg(area) FILTER (area >= 3), 0) AS mean FROM ce GROUP BY id)
SELECT f.*, components, round(mean, 6) AS mean_area, CASE WHEN NOT (ink::DOUBLE / n BETWEEN 0.01::DOUBLE AND 0.35::DOUBLE AND coloured::DOUBLE / n <= 0.35::DOUBLE AND mean > 0 AND mean <= 220 AND components >= 40) THEN 'notTextDominant'
  WHEN moderate::DOUBLE / n > 0.115::DOUBLE THEN 'chromaPattern' END AS verdict FROM f JOIN a ON f.id = a.id""",
    "colour_statistics": f"WITH {_LUMA}, s AS (SELECT id, count(*) AS sampled, count(*) FILTER (v <= 40 OR v >= 215) AS extremes, count(*) FILTER (chroma > 25) AS chromatic FROM p GROUP BY id) SELECT *, extremes / sampled > 0.92 AND chromatic / sampled <= 0.005 AS near_bilevel FROM s",
    "local_threshold": f"""WITH {_tiles(8)}, a AS (SELECT *, count(*) OVER w AS n1, sum(v) OVER w AS s1, sum(v * v) OVER w AS q1 FROM g WINDOW w AS (PARTITION BY id, y ORDER BY x RANGE BETWEEN 15 PRECEDING AND 15 FOLLOWING)),
b AS (SELECT id, v, (sum(n1) OVER w)::BIGINT AS n, (sum(s1) OVER w)::BIGINT AS s, (sum(q1) OVER w)::BIGINT AS sq FROM a WINDOW w AS (PARTITION BY id, x ORDER BY y RANGE BETWEEN 15 PRECEDING AND 15 FOLLOWING))
SELECT id, count(*) FILTER (v < s::DOUBLE / n * (1 + 0.3::DOUBLE * (sqrt(greatest(0.0::DOUBLE, sq::DOUBLE / n - (s::DOUBLE / n) * (s::DOUBLE / n))) / 128.0::DOUBLE - 1))) AS ink, max(n)::BIGINT AS largest, min(n)::BIGINT AS smallest, sum(s)::BIGINT AS s FROM b GROUP BY id""",
    "strided_ink": f"WITH {_tiles(20)} SELECT id, count(*) AS n, count(*) FILTER (v * 2 < 245) AS ink FROM g WHERE x % 2 = 0 AND y % 2 = 0 GROUP BY id",
}
