"""Queries of texts, progress ticks, pixels and numbers over stand-in columns.

events are progress ticks (the user is the row, the event id the order); embeddings are 8 x 8 grey
pages, scaled to 0 to 255; documents, pages and conversations are texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry as G, numbers as N, rows as R, text as T
from quire.operators import keyed as K, ordered as O, pages as W, pixels as P, totals as A
from quire.plans.bindings_rows import table
from quire.sources import history as H


def ticks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "ts", "value", F.get_json_object("props", "$.k").cast("long").alias("k"), ((F.col("event_id") * 37) % 100 / 100.0).alias("fraction"))


TICKS = "t AS (SELECT event_id, user_id, event_type, ts, value, (props::JSON->>'$.k')::BIGINT AS k, ((event_id * 37) % 100)::DOUBLE / 100.0::DOUBLE AS fraction FROM events)"


def monotone_progress(spark, sf_dir):
    return O.monotone(ticks(spark, sf_dir), ["user_id"], ["event_id"], "value").select("user_id", "event_id", "value")


def page_markers(spark, sf_dir):
    lines = ticks(spark, sf_dir).withColumn("line", F.when(F.col("event_type") == "error", "no page").otherwise(F.concat(F.lit("Page "), F.col("k").cast("string"))))
    return O.page_markers(lines, ["user_id"], ["event_id"], "line").select("user_id", "event_id", "page")


def _timed(spark, sf_dir):
    return ticks(spark, sf_dir).withColumn("elapsed", F.col("event_id") * 0.5)


def smoothed_eta(spark, sf_dir):
    return O.smoothed_eta(_timed(spark, sf_dir).select("user_id", "event_id", "fraction", "elapsed"), ["user_id"], "event_id")


def leg_eta(spark, sf_dir):
    t = _timed(spark, sf_dir)
    span = O.composed_span(F.col("fraction"), F.lit(0.2), F.when(F.col("k") % 5 != 0, F.lit(0.5)).otherwise(0.0))
    return t.select("event_id", O.leg_eta(F.col("fraction"), F.col("elapsed")).alias("eta"), span.alias("span"))


def late_tick_filter(spark, sf_dir):
    return O.accepted_ticks(ticks(spark, sf_dir), "user_id", "event_id", F.col("event_type") == "purchase").select("user_id", "event_id")


def ingest_once(spark, sf_dir):
    return O.first_outcomes(ticks(spark, sf_dir), "user_id", "event_id", F.col("event_type") == "purchase").select("user_id", "event_id", "value", "k")


def row_durations(spark, sf_dir):
    return O.row_duration(ticks(spark, sf_dir), "user_id", "ts", "event_type", "purchase")


def progress_labels(spark, sf_dir):
    t = ticks(spark, sf_dir)
    return t.select("event_id", T.reading_label(F.col("fraction"), F.col("k")).alias("reading"), T.leg_label(F.col("fraction"), F.col("k") % 2 == 0).alias("leg"))


def lossy_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    return d.select("doc_id", T.lossy(F.col("text")).alias("lossy"), T.lossy(flat).alias("lossy_flat"))


def lossy_runs(spark, sf_dir):
    """Folders all of whose texts are lossy."""
    d = table(spark, sf_dir, "documents").where(T.has_text(F.col("text")))
    return d.groupBy("source").agg(F.bool_and(T.lossy(F.col("text"))).alias("all_lossy"), F.count(F.lit(1)).alias("n"))


def escape_text(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    odd = F.concat(F.col("text"), F.lit(" (a\\b)\tŁ"))
    return c.select("conv_id", "turn", T.escaped(odd).alias("escaped"))


def text_runs(spark, sf_dir):
    """Lines of documents by position; none of a document with a lossy line."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(T.runs(F.col("text"))).alias("pos", "line"))


def content_class(spark, sf_dir):
    """Kinds of documents from up to five sampled pages; the page number decides whether a page is an image."""
    d = table(spark, sf_dir, "documents")
    sample = O.page_sample((F.floor(F.col("n_chars") / 500) + 1).cast("long"), F.lit(5).cast("long"))
    body = lambda page: F.substring(F.col("text"), (page * 500 + 1).cast("int"), F.lit(500))
    is_text = F.transform(sample, lambda page: ((F.col("doc_id") + page) % 3 != 0) & (F.length(T.trimmed(body(page))) >= 40))
    d = d.select("doc_id", "lang", F.explode(F.array(is_text)).alias("kinds"))  # an array of one: computed once
    n = F.size(F.filter("kinds", lambda x: x)).cast("long")
    sums = d.select("doc_id", "lang", n.alias("text_pages"), (F.size("kinds") - n).alias("image_pages"))
    return sums.select("doc_id", "text_pages", "image_pages", R.content_class(F.col("text_pages"), F.col("image_pages"), F.col("lang") == "en").alias("kind"))


def ocr_outcome(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    s = c.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("recognised"), F.count_if(F.col("role") != "user").alias("skipped"), F.count(F.lit(1)).alias("pages"), A.capped_sum(F.length("text"), 2_000_000).alias("runs"))
    return s.select("conv_id", "runs", R.ocr_outcome(F.col("recognised"), F.col("skipped"), F.col("pages"), F.when(F.col("conv_id") % 3 == 0, 0).otherwise(F.col("runs"))).alias("outcome"))


def accuracy(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    langs = F.array("lang", F.when(F.col("doc_id") % 4 == 0, "ja-JP").otherwise("en"))
    return d.select("doc_id", R.clamp_accuracy(F.when(F.col("doc_id") % 3 == 0, "accurate").otherwise("fast"), langs).alias("accuracy"))


def version_compare(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    n = lambda k: (F.col("page_id") % k).cast("string")
    remote = F.when(F.col("page_id") % 17 == 0, "1.x").otherwise(F.concat(n(3), F.lit("."), n(7)))
    local = F.when(F.col("page_id") % 19 == 0, "beta").otherwise(F.concat(n(2), F.lit("."), n(5), F.lit("."), n(2)))
    return p.select("page_id", N.version_newer(remote, local).alias("newer"))


def url_pin(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("host", F.regexp_extract("url", "^[a-z]+://([^/:?#]*)", 1))
    return p.select("page_id", (N.pinned(F.col("url"), "github.com").isNotNull() | ((F.col("host") != "") & F.col("url").startswith("https://"))).alias("secure"), "host")


def ref_parse(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    text = F.concat(F.when(F.col("page_id") % 9 == 0, "x").otherwise(F.col("page_id").cast("string")), F.lit(" "), (F.col("page_id") % 4).cast("string"), F.when(F.col("page_id") % 5 == 0, " Q").otherwise(" R"))
    big = F.concat(F.lit("10995116277"), (F.col("page_id") % 100).cast("string"))
    return p.select("page_id", N.reference(text)["object"].alias("object"), N.reference(text)["generation"].alias("generation"), N.bounded_int(big).alias("bounded"))


def geometry(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumns({"w": F.col("p_size") * 10.0, "h": (F.col("p_partkey") % 97 + 1) * 8.0, "r": ((F.col("p_partkey") % 9 - 4) * 90).cast("int")})
    w, h = G.displayed_size(F.col("w"), F.col("h"), F.col("r"))
    x, y = G.user_point(F.col("w") / 4, F.col("h") / 2, F.lit(3.0), F.lit(5.0), F.col("w"), F.col("h"), F.col("r"))
    size, stretch = G.text_scale(F.lit(12), F.lit(0.5), F.lit(0.25), w, h)
    return p.select("p_partkey", w.alias("shown_w"), h.alias("shown_h"), x.alias("x"), y.alias("y"), size.alias("size"), F.round(stretch, 6).alias("stretch"))


def raster_size(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    w, h = G.raster_size((F.col("p_size") - 1) * 100.0, (F.col("p_partkey") % 97) * 80.0, F.lit(300.0))
    return p.select("p_partkey", w.cast("long").alias("w"), h.cast("long").alias("h"))


def number_texts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    v = F.when(F.col("p_partkey") % 5 == 0, F.lit("NaN").cast("double")).when(F.col("p_partkey") % 7 == 0, F.lit("Infinity").cast("double")).otherwise(F.col("p_size") / 4.0)
    return p.select("p_partkey", N.number_text(v).alias("text"))


def error_tails(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.error_tail(F.col("text"), F.lit("")).alias("tail"))


def breadcrumbs(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", T.breadcrumb(F.regexp_replace("url", "^[a-z]+:/", "")).alias("crumb"))


def reservation_keys(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.reservation_key(F.concat(F.lit("/Out/"), F.col("source"), F.lit("/É"), F.left("text", F.lit(12)))).alias("key"))


def file_digests(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


def history_json_decode(spark, sf_dir):
    """Defaults of a decoded row: a missing count is 0, texts are cut, an address must be a file's."""
    e = table(spark, sf_dir, "events")
    batch = F.from_json(F.concat(F.lit('{"savedBytes": '), F.col("event_id").cast("string"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(', "successCount": '), F.get_json_object("props", "$.k"))).otherwise(""), F.lit(', "folderURL": "'), F.when(F.col("event_id") % 5 == 0, "http").otherwise("file"), F.lit(':///x"}')), H.BATCH)
    b = H.decoded(batch)
    return e.select("event_id", b["savedBytes"].alias("saved"), b["successCount"].alias("successes"), H.sound(F.array(b)).alias("accepted"))


def admitted_files(spark, sf_dir):
    from quire.sources.files import admitted

    p = table(spark, sf_dir, "pages").withColumn("path", F.concat("url", F.when(F.col("page_id") % 3 == 0, ".PDF").when(F.col("page_id") % 3 == 1, ".pdf").otherwise(".html")))
    return admitted(p).select("page_id", "path")


def scope_dedupe(spark, sf_dir):
    return K.first_by(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), ["source", "lang"], "doc_id")


# pixels


def grey(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    scaled = F.transform("embedding", lambda x: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (x.cast("double") + 1) * 127.5))).cast("int"))
    return P.pixels(e, "vec_id", scaled, 8)


PIXELS = """p AS (SELECT vec_id AS id, (i % 8)::INT AS x, (i // 8)::INT AS y, floor(least(255.0::DOUBLE, greatest(0.0::DOUBLE, (embedding[i + 1]::DOUBLE + 1) * 127.5::DOUBLE)))::INT AS v
  FROM embeddings, range(64) r(i))"""
OTSU = PIXELS + """, hist AS (SELECT id, v AS bin, count(*) AS n FROM p GROUP BY 1, 2), fb AS (SELECT i.id, b.bin::INT AS bin, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT id FROM p) i CROSS JOIN range(256) b(bin) LEFT JOIN hist ON hist.id = i.id AND hist.bin = b.bin),
su AS (SELECT id, bin, sum(n) OVER w AS w0, sum(n) OVER (PARTITION BY id) AS w, (sum(bin * n) OVER w)::DOUBLE AS s0, (sum(bin * n) OVER (PARTITION BY id))::DOUBLE AS s FROM fb WINDOW w AS (PARTITION BY id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
va AS (SELECT id, bin, w0::DOUBLE * (w - w0)::DOUBLE * (s0 / w0::DOUBLE - (s - s0) / (w - w0)::DOUBLE) * (s0 / w0::DOUBLE - (s - s0) / (w - w0)::DOUBLE) AS variance FROM su WHERE w0 > 0 AND w > w0),
be AS (SELECT id, bin FROM (SELECT *, max(variance) OVER (PARTITION BY id) AS best FROM va) WHERE variance = best),
o AS (SELECT i.id, coalesce((min(bin) + max(bin)) // 2, 127)::INT AS threshold FROM (SELECT DISTINCT id FROM p) i LEFT JOIN be ON be.id = i.id GROUP BY i.id)"""


def otsu(spark, sf_dir):
    return W.thresholds(grey_pages(spark, sf_dir), "v").select("id", "threshold")


def near_bilevel(spark, sf_dir):
    return W.statistics(grey_pages(spark, sf_dir), "v").drop("width", "v")


def ink_counts(spark, sf_dir):
    return W.ink_counts(grey_pages(spark, sf_dir), "v").drop("width", "v")


def ink_ratio(spark, sf_dir):
    return W.ink_ratio(grey_pages(spark, sf_dir).withColumn("v", F.transform("v", lambda x: x * 2)), "v").drop("width", "v")


def block_mean(spark, sf_dir):
    return P.block_mean(grey(spark, sf_dir), 2, F.col("v") >= 120)


def grey_pages(spark, sf_dir):
    """The same pages as whole rows."""
    e = table(spark, sf_dir, "embeddings")
    scaled = F.transform("embedding", lambda x: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (x.cast("double") + 1) * 127.5))).cast("int"))
    return e.select(F.col("vec_id").alias("id"), F.lit(8).alias("width"), scaled.alias("v"))


def _dark(limit: int):
    return F.transform("v", lambda x: (x < limit).cast("int"))


def dilate(spark, sf_dir):
    g = grey_pages(spark, sf_dir).withColumn("v", _dark(100))
    return W.long_form(W.dilated(g, "v", "grown"), "grown").withColumnRenamed("grown", "v")


def masked_error(spark, sf_dir):
    g = grey_pages(spark, sf_dir).withColumns({"m": _dark(100), "c": F.transform("v", lambda x: (F.floor(x / 16) * 16).cast("int"))})
    return W.masked_error(W.dilated(g, "m", "region"), "c", "v", "region").select("id", "n", "error", "passes")


def integral_image(spark, sf_dir):
    return W.long_form(W.local_ink(grey_pages(spark, sf_dir), "v", 2), "n", "s", "sq", "ink")


def layers(spark, sf_dir):
    g = grey_pages(spark, sf_dir).withColumns({"m": _dark(120), "white": F.transform("v", lambda x: F.lit(255))})
    return W.long_form(W.composite(g, "m", "v", "white", "out"), "out").withColumnRenamed("out", "v")


def validate_pages(spark, sf_dir):
    """Documents of five pages each: ink before and after brightening."""
    ink = P.ink_ratio(grey(spark, sf_dir).withColumn("v", F.when(F.col("v") < 120, F.col("v")).otherwise(255)), 8, 8).select("id", (F.col("ink") / F.col("n")).alias("ink"))
    before = ink.select(F.floor(F.col("id") / 5).cast("long").alias("doc"), (F.col("id") % 5).alias("page"), "ink")
    after = ink.select(F.floor(F.col("id") / 5).cast("long").alias("doc"), (4 - F.col("id") % 5).alias("page"), "ink").where("(doc + page) % 37 <> 0")
    pairs = K.page_pairs(before, after, ["doc", "page"], "ink").withColumnsRenamed({"left_value": "before", "right_value": "after"})
    return P.validated(pairs, "doc", F.col("page").isin(0, 1, 4))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    monotone_progress, page_markers, smoothed_eta, leg_eta, late_tick_filter, ingest_once, row_durations, progress_labels, lossy_text, lossy_runs, escape_text, text_runs, content_class, ocr_outcome, accuracy,
    version_compare, url_pin, ref_parse, geometry, raster_size, number_texts, error_tails, breadcrumbs, reservation_keys, file_digests, history_json_decode, admitted_files, scope_dedupe,
    otsu, near_bilevel, ink_counts, ink_ratio, block_mean, dilate, masked_error, integral_image, layers, validate_pages)}

_SPACE = r"[\x{0009}-\x{000D}\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_LOSSY = r"[^\x20-\x{FF}\t]"

SQL: dict[str, str] = {
    "monotone_progress": f"WITH {TICKS}, m AS (SELECT *, coalesce(max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS best FROM t) SELECT user_id, event_id, value FROM m WHERE value > best",
    "page_markers": f"WITH {TICKS}, m AS (SELECT *, coalesce(max(k) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS best FROM t WHERE event_type <> 'error') SELECT user_id, event_id, k AS page FROM m WHERE k > best",
    "smoothed_eta": f"""WITH RECURSIVE {TICKS}, u AS (SELECT user_id, event_id, fraction, event_id * 0.5::DOUBLE AS elapsed, lag(fraction) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM u WHERE last IS NULL OR last <> fraction),
f AS (SELECT user_id, event_id, rn, CASE WHEN fraction >= 0.1 AND elapsed > 0 THEN fraction / elapsed END AS rate, CASE WHEN fraction >= 0.1 AND elapsed > 0 THEN round(greatest(0.0::DOUBLE, 1 - fraction) / (fraction / elapsed))::BIGINT END AS eta FROM n WHERE rn = 1
  UNION ALL SELECT n.user_id, n.event_id, n.rn,
    CASE WHEN n.fraction >= 0.1 AND elapsed > 0 THEN CASE WHEN f.rate IS NULL THEN n.fraction / elapsed ELSE 0.3::DOUBLE * (n.fraction / elapsed) + 0.7::DOUBLE * f.rate END ELSE f.rate END,
    CASE WHEN n.fraction >= 0.1 AND elapsed > 0 THEN least(round(greatest(0.0::DOUBLE, 1 - n.fraction) / (CASE WHEN f.rate IS NULL THEN n.fraction / elapsed ELSE 0.3::DOUBLE * (n.fraction / elapsed) + 0.7::DOUBLE * f.rate END))::BIGINT, f.eta) END
  FROM f JOIN n ON n.user_id = f.user_id AND n.rn = f.rn + 1)
SELECT user_id, event_id, eta FROM f""",
    "leg_eta": f"WITH {TICKS} SELECT event_id, CASE WHEN fraction >= 0.1 AND event_id > 0 THEN greatest(0, round((1 - fraction) / (fraction / (event_id * 0.5::DOUBLE)))::BIGINT) END AS eta, CASE WHEN k % 5 <> 0 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, (fraction - 0.2::DOUBLE) / 0.5::DOUBLE)) END AS span FROM t",
    "late_tick_filter": f"WITH {TICKS}, m AS (SELECT *, min(event_id) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id) AS fin FROM t) SELECT user_id, event_id FROM m WHERE fin IS NULL OR event_id <= fin",
    "ingest_once": f"WITH {TICKS}, m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM t WHERE event_type = 'purchase') SELECT user_id, event_id, value, k FROM m WHERE rn = 1",
    "row_durations": f"WITH {TICKS}, m AS (SELECT user_id, epoch_us(min(ts) FILTER (event_type = 'purchase')) - epoch_us(min(ts)) AS micros FROM t GROUP BY user_id) SELECT user_id, micros FROM m WHERE micros IS NOT NULL",
    "progress_labels": f"WITH {TICKS} SELECT event_id, 'Reading page ' || least(k, greatest(1, round(fraction * k)::BIGINT)) || ' of ' || k AS reading, CASE WHEN fraction >= 0.45 AND k % 2 = 0 THEN 'Rebuilding scan…' ELSE 'Compressing…' END AS leg FROM t",
    "lossy_text": f"SELECT doc_id, regexp_matches(text, '{_LOSSY}') AS lossy, regexp_matches(replace(text, chr(10), ' '), '{_LOSSY}') AS lossy_flat FROM documents",
    "lossy_runs": f"SELECT source, bool_and(regexp_matches(text, '{_LOSSY}')) AS all_lossy, count(*) AS n FROM documents WHERE length(regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g')) > 0 GROUP BY source",
    "escape_text": r"SELECT conv_id, turn, regexp_replace(replace(regexp_replace(text || ' (a\b)' || chr(9) || 'Ł', '([\\()])', '\\\1', 'g'), chr(9), ' '), '[^\x20-\x{FF}]', '?', 'g') AS escaped FROM conversations",
    "text_runs": f"""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '^{_SPACE}+|{_SPACE}+$', '', 'g')) > 0) AS ls FROM documents)
SELECT doc_id, (i - 1)::INT AS pos, ls[i] AS line FROM l, unnest(range(1, len(ls) + 1)) r(i) WHERE len(ls) > 0 AND len(list_filter(ls, lambda x: regexp_matches(x, '{_LOSSY}'))) = 0""",
    "content_class": f"""WITH d AS (SELECT doc_id, lang, text, n_chars // 500 + 1 AS n FROM documents), e AS (SELECT *, unnest(range(0, n)) AS page FROM d),
g AS (SELECT *, page > 0 AND page <> n - 1 AND page % greatest(1, n // 5) = 0 AS mid, sum(CASE WHEN page > 0 AND page <> n - 1 AND page % greatest(1, n // 5) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page) AS rk FROM e),
s AS (SELECT *, (doc_id + page) % 3 = 0 AS raster, length(regexp_replace(substr(text, (page * 500 + 1)::INT, 500), '^{_SPACE}+|{_SPACE}+$', '', 'g')) >= 40 AS txt FROM g WHERE 5 >= n OR page IN (0, n - 1) OR (mid AND rk <= 3)),
c AS (SELECT doc_id, lang, count(*) FILTER (NOT raster AND txt) AS text_pages, count(*) FILTER (raster OR NOT txt) AS image_pages FROM s GROUP BY 1, 2)
SELECT doc_id, text_pages, image_pages, CASE WHEN text_pages > 0 AND text_pages >= image_pages THEN 'bornDigital' WHEN lang = 'en' THEN 'scanBilevel' ELSE 'scanColour' END AS kind FROM c""",
    "ocr_outcome": "WITH s AS (SELECT conv_id, count(*) FILTER (role = 'user') AS rec, count(*) FILTER (role <> 'user') AS skp, count(*) AS pages, sum(length(text))::BIGINT AS runs FROM conversations GROUP BY conv_id) SELECT conv_id, runs, CASE WHEN rec = 0 AND skp = pages THEN 'alreadySearchable' WHEN rec > 0 AND (conv_id % 3 = 0 OR runs = 0) THEN 'tooFaint' ELSE 'added' END AS outcome FROM s",
    "accuracy": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR doc_id % 4 = 0 THEN 'accurate' ELSE 'fast' END AS accuracy FROM documents",
    "version_compare": """WITH d AS (SELECT page_id, [page_id % 3, page_id % 7, 0] AS r, [page_id % 2, page_id % 5, page_id % 2] AS l FROM pages)
SELECT page_id, CASE WHEN page_id % 17 = 0 THEN false WHEN page_id % 19 = 0 THEN true ELSE r > l END AS newer FROM d""",
    "url_pin": "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) <> '' AND starts_with(url, 'https://') AS secure, regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) AS host FROM pages",
    "ref_parse": "SELECT page_id, CASE WHEN page_id % 9 <> 0 AND page_id % 5 <> 0 THEN page_id END AS object, CASE WHEN page_id % 9 <> 0 AND page_id % 5 <> 0 THEN page_id % 4 END AS generation, CASE WHEN ('10995116277' || page_id % 100)::BIGINT <= 1099511627776 THEN ('10995116277' || page_id % 100)::BIGINT END AS bounded FROM pages",
    "geometry": """WITH p AS (SELECT p_partkey, p_size * 10.0::DOUBLE AS w, (p_partkey % 97 + 1) * 8.0::DOUBLE AS h, ((((p_partkey % 9 - 4) * 90) % 360 + 360) % 360)::INT AS r FROM part),
q AS (SELECT *, CASE WHEN r IN (90, 270) THEN h ELSE w END AS shown_w, CASE WHEN r IN (90, 270) THEN w ELSE h END AS shown_h FROM p)
SELECT p_partkey, shown_w, shown_h, CASE r WHEN 90 THEN w - h / 2 WHEN 180 THEN w - w / 4 WHEN 270 THEN h / 2 ELSE w / 4 END + 3.0::DOUBLE AS x, CASE r WHEN 90 THEN w / 4 WHEN 180 THEN h - h / 2 WHEN 270 THEN h - w / 4 ELSE h / 2 END + 5.0::DOUBLE AS y,
  greatest(1.0::DOUBLE, 0.25::DOUBLE * shown_h) AS size, round(least(1000.0::DOUBLE, greatest(1.0::DOUBLE, greatest(1.0::DOUBLE, 0.5::DOUBLE * shown_w) / greatest(1.0::DOUBLE, 12 * 0.5::DOUBLE * greatest(1.0::DOUBLE, 0.25::DOUBLE * shown_h)) * 100)), 6) AS stretch FROM q""",
    "raster_size": """WITH p AS (SELECT p_partkey, (p_size - 1) * 100.0::DOUBLE AS w, (p_partkey % 97) * 80.0::DOUBLE AS h, 300.0::DOUBLE / 72.0::DOUBLE AS s FROM part),
q AS (SELECT *, CASE WHEN w * s * h * s > 40000000.0::DOUBLE THEN s * sqrt(40000000.0::DOUBLE / (w * s * h * s)) ELSE s END AS f FROM p)
SELECT p_partkey, CASE WHEN w > 0 AND h > 0 AND floor(w * f) >= 1 AND floor(h * f) >= 1 THEN floor(w * f)::BIGINT END AS w, CASE WHEN w > 0 AND h > 0 AND floor(w * f) >= 1 AND floor(h * f) >= 1 THEN floor(h * f)::BIGINT END AS h FROM q""",
    "number_texts": "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN '0.00' ELSE printf('%.2f', p_size / 4.0::DOUBLE) END AS text FROM part",
    "error_tails": "WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents) SELECT doc_id, left(array_to_string(ls[greatest(1, len(ls) - 1):], ' '), 300) AS tail FROM d",
    "breadcrumbs": "WITH d AS (SELECT page_id, list_filter(string_split(regexp_replace(url, '^[a-z]+:/', ''), '/'), lambda x: x <> '') AS ps FROM pages) SELECT page_id, array_to_string(ps[greatest(1, len(ps) - 1):], ' › ') AS crumb FROM d",
    "reservation_keys": "SELECT doc_id, lower(nfc_normalize('/Out/' || source || '/É' || left(text, 12))) AS key FROM documents",
    "file_digests": "SELECT doc_id, sha256(text) AS digest FROM documents",
    "history_json_decode": "SELECT event_id, event_id AS saved, CASE WHEN event_id % 2 = 0 THEN (props::JSON->>'$.k')::BIGINT ELSE 0 END AS successes, event_id % 5 <> 0 AS accepted FROM events",
    "admitted_files": "SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '.PDF' ELSE '.pdf' END AS path FROM pages WHERE page_id % 3 <> 2",
    "scope_dedupe": "SELECT min(doc_id) AS doc_id, source, lang FROM documents GROUP BY source, lang",
    "otsu": f"WITH {OTSU} SELECT id, threshold FROM o",
    "near_bilevel": f"WITH {PIXELS}, s AS (SELECT id, count(*) AS sampled, count(*) FILTER (v <= 40 OR v >= 215) AS extremes, 0::BIGINT AS chromatic FROM p GROUP BY id) SELECT *, extremes / sampled > 0.92 AND chromatic / sampled <= 0.005 AS near_bilevel FROM s",
    "ink_counts": f"WITH {OTSU} SELECT p.id, threshold, count(*) AS n, count(*) FILTER (v < threshold) AS ink FROM p JOIN o ON p.id = o.id GROUP BY p.id, threshold",
    "ink_ratio": f"WITH {PIXELS} SELECT id, count(*) AS n, count(*) FILTER (v * 2 < 245) AS ink FROM p GROUP BY id",
    "block_mean": f"""WITH {PIXELS}, b AS (SELECT id, x // 2 AS block_x, y // 2 AS block_y, sum(v) FILTER (v >= 120) AS s, count(*) FILTER (v >= 120) AS n FROM p GROUP BY 1, 2, 3)
SELECT id, block_x, block_y, n, coalesce(s::DOUBLE / nullif(n, 0), (sum(s) OVER (PARTITION BY id))::DOUBLE / nullif(sum(n) OVER (PARTITION BY id), 0)) AS mean FROM b""",
    "dilate": f"WITH {PIXELS} SELECT a.id, a.x, a.y, max((b.v < 100)::INT) AS v FROM p a JOIN p b ON a.id = b.id AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY 1, 2, 3",
    "masked_error": f"""WITH {PIXELS}, m AS (SELECT a.id, a.x, a.y, any_value(a.v) AS v, max((b.v < 100)::INT) AS m FROM p a JOIN p b ON a.id = b.id AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY 1, 2, 3),
s AS (SELECT id, count(*) FILTER (m = 1) AS n, coalesce(sum(abs(v - v // 16 * 16)) FILTER (m = 1), 0)::DOUBLE AS d, coalesce(sum(v) FILTER (m = 1), 0)::DOUBLE AS s, coalesce(sum(v * v) FILTER (m = 1), 0)::DOUBLE AS sq FROM m GROUP BY id),
e AS (SELECT id, n, d, CASE WHEN n > 0 THEN sqrt(greatest(0.0::DOUBLE, sq / n - (s / n) * (s / n))) END AS c FROM s), r AS (SELECT id, n, CASE WHEN n = 0 OR c < 4 THEN 0.0::DOUBLE ELSE d / n / c END AS error FROM e)
SELECT id, n, round(error, 6) AS error, error <= 0.33::DOUBLE AS passes FROM r""",
    "integral_image": f"""WITH {PIXELS}, w AS (SELECT a.id, a.x, a.y, any_value(a.v) AS v, count(*) AS n, sum(b.v)::BIGINT AS s, sum(b.v * b.v)::BIGINT AS sq FROM p a JOIN p b ON a.id = b.id AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY 1, 2, 3)
SELECT id, x, y, n, s, sq, v < s::DOUBLE / n * (1 + 0.3::DOUBLE * (sqrt(greatest(0.0::DOUBLE, sq::DOUBLE / n - (s::DOUBLE / n) * (s::DOUBLE / n))) / 128.0::DOUBLE - 1)) AS ink FROM w""",
    "layers": f"WITH {PIXELS} SELECT id, x, y, CASE WHEN v < 120 THEN v ELSE 255 END AS v FROM p",
    "validate_pages": f"""WITH {PIXELS}, i AS (SELECT id, count(*) FILTER (v < 120)::DOUBLE / count(*) AS ink FROM p GROUP BY id), l AS (SELECT id // 5 AS doc, id % 5 AS page, ink FROM i), r AS (SELECT id // 5 AS doc, 4 - id % 5 AS page, ink FROM i WHERE (id // 5 + 4 - id % 5) % 37 <> 0),
j AS (SELECT coalesce(l.doc, r.doc) AS doc, coalesce(l.page, r.page) AS page, l.ink AS b, r.ink AS a FROM l FULL JOIN r ON l.doc = r.doc AND l.page = r.page),
k AS (SELECT *, coalesce(CASE WHEN b < 0.005 THEN a <= 0.5 ELSE a >= b * 0.3 AND a <= least(b * 3, b + 0.35) END, false) AS ok, page IN (0, 1, 4) AS smp FROM j),
s AS (SELECT doc, count(*) FILTER (smp AND NOT b < 0.005) AS compared, coalesce(bool_and(ok) FILTER (smp), false) AS f, bool_and(ok) AS g FROM k GROUP BY doc) SELECT doc, compared, f AND (compared > 0 OR g) AS valid FROM s""",
}
