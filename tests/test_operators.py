"""Cases that the tables lack: ties, nulls, empty inputs, odd sizes."""

import json
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quire.functions import numbers as N, pricing, rows as R, text as T
from quire.operators import keyed as K, ordered as O, pixels as P, selection as S, totals as A
from quire.sources import files, history


def one(spark, **columns):
    return [r for r in spark.range(1).select(*(c.alias(n) for n, c in columns.items())).collect()][0]


def test_race_ties(spark):
    rows = spark.createDataFrame([("scanColour", 100, 90, 90), ("scanColour", 100, 100, 100), ("scanColour", 100, 90, 80), ("scanColour", 100, 120, 80)], "kind string, size long, base long, mrc long")
    r = S.race(F.col("kind"), F.col("size"), F.col("base"), F.lit(True), F.lit(None), F.lit(None), F.col("mrc"), F.lit(True), F.lit(True), F.lit("balanced"))
    got = [tuple(x[0])[:3] for x in rows.select(r).collect()]
    assert got == [("shipped", "baseline", "mrc"), ("noGain", None, None), ("shipped", "mrc", "baseline"), ("shipped", "mrc", "original")]


def test_null_verb_is_not_a_failure(spark):
    r = one(spark, a=R.degraded(F.lit("compressed"), F.lit(None).cast("string")), b=R.degraded(F.lit(None).cast("string"), F.lit("failed")))
    assert (r.a, r.b) == (False, True)


def test_searchable_flags(spark):
    null = F.lit(None).cast("boolean")
    r = one(spark, a=R.made_searchable(F.lit(True), null), b=R.made_searchable(null, null), c=R.made_searchable(F.lit(True), F.lit(True)))
    assert (r.a, r.b, r.c) == (True, False, False)


def test_cancelled_run_without_deliveries_leaves_no_record(spark):
    rows = spark.createDataFrame([(1, "failed", 10, 5, False, None, None, True, True), (2, "done", 10, 15, True, "compressed", None, True, True)],
        "run long, state string, before long, after long, searchable boolean, compress string, ocr string, cancelled boolean, queued boolean")
    [r] = A.batch_records(rows, "run").collect()
    assert (r.run, r.saved_bytes, r.success_count) == (2, 0, 1)


def test_empty_run_has_progress_zero(spark):
    rows = spark.createDataFrame([], "state string, fraction double")
    [r] = A.run_progress(rows).collect()
    assert r.run_fraction == 0 and not r.all_finished


def test_otsu_between_modes_and_plateau(spark):
    hist = spark.createDataFrame([(1, 20, 50), (1, 235, 50), (2, 7, 9)], "id long, bin int, n long")
    got = dict(P.otsu(hist).collect())
    assert 20 < got[1] < 235 and got[2] == 127


def test_components_count_regions(spark):
    grid = ["##....", "##..#.", "....##", "......", "#....."]
    pix = [(1, x, y, 0 if c == "#" else 255) for y, line in enumerate(grid) for x, c in enumerate(line)]
    rows = spark.createDataFrame(pix, "id long, x int, y int, v int")
    [r] = P.components(rows, spark.createDataFrame([(1, 100)], "id long, threshold int")).collect()
    assert (r.components, r.mean_area) == (2, 3.5)


def test_masked_error_without_contrast_passes(spark):
    flat = spark.createDataFrame([(1, x, 0, 9) for x in range(4)], "id long, x int, y int, v int")
    [r] = P.masked_error(flat.withColumn("v", F.lit(200)), flat, flat.withColumn("v", F.lit(1))).collect()
    assert r.error == 0 and r.passes


@pytest.mark.parametrize("n,k", [(n, k) for n in (0, 1, 2, 5, 9, 10, 64) for k in (0, 1, 2, 3, 5, 70)])
def test_page_sample(spark, n, k):
    r = one(spark, s=O.page_sample(F.lit(n).cast("long"), F.lit(k).cast("long"))).s
    if n <= 0 or k <= 0:
        assert r == []
    else:
        assert r == sorted(set(r)) and len(r) <= min(n, k) and all(0 <= p < n for p in r) and 0 in r
        assert k < 2 or n - 1 in r


def test_eta_does_not_rise_and_restarts_after_a_dip(spark):
    rows = spark.createDataFrame([(1, k, f, 1.0 + k) for k, f in enumerate([0.05, 0.2, 0.2, 0.4, 0.05, 0.1, 0.9])], "id long, k long, fraction double, elapsed double")
    got = {r.k: r.eta for r in O.smoothed_eta(rows, ["id"], "k").collect()}
    assert 2 not in got and got[0] is None and got[4] is None and got[3] <= got[1] and got[5] > got[3] and got[6] <= got[5]


def test_exact_names_step_over_taken_ones(spark):
    rows = spark.createDataFrame([("f", "a", 1), ("f", "a-small-1", 2), ("f", "A", 3), ("f", "a", 4)], "folder string, base string, k long")
    got = [r.output_name for r in K.exact_output_names(rows, "folder", "base", "k").orderBy("k").collect()]
    assert got == ["a-small.pdf", "a-small-1-small.pdf", "A-small-1.pdf", "a-small-2.pdf"]


def test_preset_totals_with_fallback(spark):
    docs = spark.createDataFrame([(1, 1000, 1, "bornDigital", True), (2, 1000, None, None, True), (3, 0, 1, "scanColour", False)], "id long, size long, pages long, content_type string, rebuild boolean")
    got = {(r.id, r.preset): (r.predicted, r.is_fallback) for r in pricing.price(docs).collect()}
    assert got[1, "balanced"] == (900, False) and got[2, "smallest"] == (449, True) and got[3, "maximum"] == (1, False)


def test_texts(spark):
    r = one(spark, a=T.lossy(F.lit("a\tb")), b=T.lossy(F.lit("a\nb")), c=T.escaped(F.lit("(\\)\t☃")), d=T.has_text(F.lit("  \n")), e=T.utf8_budget(F.lit("abééx"), 6), f=T.breadcrumb(F.lit("/a/b/c")), g=T.percent_text(F.lit(3), F.lit(0)))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == (False, True, "\\(\\\\\\) ?", False, "abé", "b › c", "same size")


def test_numbers(spark):
    r = one(spark, a=N.version_newer(F.lit("1.10"), F.lit("1.9.9")), b=N.version_newer(F.lit("x"), F.lit("1")), c=N.version_newer(F.lit("1"), F.lit("dev")), d=N.version_newer(F.lit("1.0"), F.lit("1")), e=N.reference(F.lit("12 0 R")), f=N.references(F.lit("[1 0 R (2 0 R) 3 1 R % 4 0 R\n]")))
    assert (r.a, r.b, r.c, r.d) == (True, False, True, False) and tuple(r.e) == (12, 0) and [tuple(x) for x in r.f] == [(1, 0), (3, 1)]


def _batch(k, **more):
    return {"id": str(k), "date": "2024-01-01T00:00:00Z", "folderName": "n" * 300, "folderURL": "file:///x", "fileCount": 1, "compressOn": True, "ocrOn": False, "savedBytes": k, "searchableCount": 0, "partial": False, "problem": False, "cancelled": False} | more


def test_history_source_and_sink(spark, tmp_path):
    def envelope(name, **body):
        (tmp_path / name).write_text(json.dumps(body))
        return str(tmp_path / name)

    good = history.read_history(spark, envelope("a", version=1, batches=[_batch(k) for k in range(201)], lifetimeSavedBytes=9))
    rows = good.orderBy("pos").collect()
    assert len(rows) == 200 and rows[0].successCount == 0 and len(rows[0].folderName) == 200
    assert history.read_history(spark, envelope("b", version=2, batches=[_batch(1)], lifetimeSavedBytes=0)).count() == 0
    assert history.read_history(spark, envelope("c", version=1, batches=[_batch(1), _batch(2, folderURL="http://x")], lifetimeSavedBytes=0)).count() == 0
    (tmp_path / "d").write_text("{broken")
    assert history.read_history(spark, str(tmp_path / "d")).count() == 0
    history.write_history(good, 20100, str(tmp_path / "out"))
    assert history.read_history(spark, str(tmp_path / "out")).count() == 200


def test_objects_of_a_hand_built_file(spark):
    body = zlib.compress(b"endobj inside" * 3)
    data = b"%PDF-1.4\n1 0 obj\n<< /Type /Page >>\nendobj\n2 0 obj\n<< /Length " + str(len(body)).encode() + b" >>\nstream\n" + body + b"\nendstream\nendobj\n1 1 obj\n<< /Type /Page /New true >>\nendobj\nstartxref\n0\n%%EOF"
    rows = spark.createDataFrame([("a.PDF", bytearray(data)), ("b.pdf", bytearray(b"junk")), ("c.txt", bytearray(b""))], "path string, content binary")
    admitted = files.admitted(rows)
    assert admitted.count() == 2
    assert {r.path: (r.status, r.page_count) for r in files.inspected(admitted).collect()} == {"a.PDF": ("ok", 2), "b.pdf": ("corrupt", None)}
    index = files.objects(admitted, "path")
    assert index.count() == 3
    assert {r.obj: r.gen for r in files.latest(index, "path").collect()} == {1: 1, 2: 0}


def test_bytes(spark):
    rows = spark.createDataFrame([(bytearray(zlib.compress(b"abc" * 9)),), (bytearray(b"zz"),)], "c binary")
    got = [r[0] for r in rows.select(files.inflated(F.col("c"))).collect()]
    assert bytes(got[0]) == b"abc" * 9 and got[1] is None
    r = one(spark, a=files.verbatim_prefix(F.lit("ab").cast("binary"), F.lit("abc").cast("binary")), b=files.verbatim_prefix(F.lit("b").cast("binary"), F.lit("abc").cast("binary")), c=files.unescaped_name(F.lit("A#20B")))
    assert (r.a, r.b, r.c) == (True, False, "A B")


def test_stream_never_reopens_a_finished_row(spark, tmp_path):
    from quire.streaming.progress import rising

    src = tmp_path / "in"
    spark.createDataFrame([(1, 1, 0.2, "tick"), (1, 2, 0.1, "tick"), (1, 3, 0.5, "done"), (1, 4, 0.9, "tick"), (2, 5, 0.3, "tick")], "row long, k long, v double, kind string").coalesce(1).write.parquet(str(src))
    stream = rising(spark.readStream.schema("row long, k long, v double, kind string").parquet(str(src)), "row", "k", "v", "kind", ["done"])
    q = stream.writeStream.format("memory").queryName("rising").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.k for r in spark.table("rising").collect()) == [1, 3, 5]


def test_release_feed_is_pinned(spark):
    def feed(**more):
        return json.dumps({"tag_name": "v1.2.3", "html_url": "https://github.com/a/b", "assets": [{"browser_download_url": "https://x/a.zip"}, {"browser_download_url": "https://github.com/a.dmg"}]} | more)

    rows = spark.createDataFrame([(feed(),), (feed(html_url="http://github.com/a"),), (feed(tag_name="1" * 40),), (feed(assets=[{"browser_download_url": "https://evil.com/a.dmg"}]),), ("{",)], "j string")
    got = [r[0] for r in rows.select(history.release(F.col("j"))).collect()]
    assert tuple(got[0]) == ("1.2.3", "https://github.com/a/b", "https://github.com/a.dmg")
    assert got[1] is None and got[2] is None and got[3].image is None and got[4] is None


def test_batches_are_handed_on(spark, tmp_path):
    from quire.streaming.progress import republished

    spark.range(5).write.parquet(str(tmp_path / "in"))
    seen = []
    q = republished(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), lambda df, n: seen.append((n, df.count())), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert seen[0] == (0, 5)


def test_swapped_slots_keep_their_addresses(spark):
    rows = spark.createDataFrame([(("u1", 5), ("u2", 7)), (("u1", 5), None)], "shipped struct<url:string,bytes:long>, parked struct<url:string,bytes:long>")
    got = rows.select(*(c.alias(n) for n, c in K.swapped("shipped", "parked", ["bytes"]).items())).collect()
    assert tuple(got[0].shipped) == ("u1", 7) and tuple(got[0].parked) == ("u2", 5) and tuple(got[1].shipped) == ("u1", 5)


def test_a_hot_key_is_scanned_by_many_tasks(spark):
    """A key with two thirds of all rows: its values rise as in one loop, and no range holds most of it."""
    from quire.operators import ordered as O, scans

    rng = random.Random(3)
    rows = [(7 if k % 3 else k, k, float(rng.randint(0, 10**6)), "done" if k == 50_000 else "tick") for k in range(60_000)] + [(None, k, float(k % 7), "tick") for k in range(100)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "key long, k long, v double, kind string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = scans.chunked(frame, ["key"], ["k"]).where("key = 7").groupBy(scans.CHUNK).count().collect()
        got = sorted((str(r.key), r.k) for r in O.monotone(frame, ["key"], ["k"], "v").collect())
        early = O.accepted_ticks(frame, "key", "k", F.col("kind") == "done").count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    best, want = {}, []
    for key, k, v, _ in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if v > best.get(key, 0.0):
            best[key] = v
            want.append((str(key), k))
    assert got == sorted(want)
    assert len(parts) >= 3 and max(p["count"] for p in parts) < 25_000
    assert early == sum(not (r[0] == 7 and r[1] > 50_000) for r in rows)


@pytest.mark.parametrize("split", [False, True])
def test_estimates_of_a_hot_key_equal_one_loop(spark, split):
    from quire.operators import ordered as O

    rng, rows = random.Random(6), []
    for k in range(6000):
        key = 7 if k % 3 else k % 40
        f = rng.choice([None, 0.05, 0.5, 0.5, min(1.0, k / 6000), min(1.0, k / 6000), rng.random()]) if rng.random() < 0.2 else min(1.0, 0.1 + k / 7000)
        rows.append((key, k, f, rng.choice([0.0, 1.0 + k, 2.0 + k, 1.0 + k])))
    frame = spark.createDataFrame(rows, "key long, k long, fraction double, elapsed double").repartition(8)
    if split:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.key, r.k): r.eta for r in O.smoothed_eta(frame, ["key"], "k").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, state = {}, {}
    for key, k, f, t in sorted(rows):
        last, rate, eta = state.get(key, (None, None, None))
        if last is not None and (f is None or f == last):  # as rows are told apart
            state[key] = (f, rate, eta)
            continue
        if f is not None and f >= 0.1 and t > 0:
            rate = f / t if rate is None else 0.3 * (f / t) + 0.7 * rate
            left = int(max(0.0, 1 - f) / rate + 0.5)
            eta = left if eta is None else min(left, eta)
        else:
            eta = None
        want[key, k] = eta
        state[key] = (f, rate, eta)
    assert got.keys() == want.keys()
    assert sum(got[x] != want[x] for x in want) == 0


def test_cards_of_rows_that_share_their_keys_are_one_list(spark):
    slot = lambda name: F.when(F.col(name).isNotNull(), F.struct(F.lit("u").alias("url"), F.col(name).alias("bytes"), F.lit("plain").alias("variant")))
    rows = spark.createDataFrame([(1, 5, 7), (1, 4, None), (2, 9, 8), (None, 3, None), (None, 3, 6)], "run long, a long, b long").select("run", slot("a").alias("shipped"), slot("b").alias("previous"))
    got = [(r.run, r.pos, r.slot, r.bytes) for r in S.version_cards(rows, ["run"], ["shipped", "previous"]).collect()]
    want = [(1, 0, "shipped", 4), (1, 1, "shipped", 5), (1, 2, "previous", 7), (2, 0, "shipped", 9), (2, 1, "previous", 8), (None, 0, "shipped", 3), (None, 1, "shipped", 3), (None, 2, "previous", 6)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_sections_hold_no_groups(spark):
    rows = spark.createDataFrame([(1, 4), (1, 4), (1, 5), (1, 5), (1, 9), (1, 9), (1, 11), (2, None), (2, None), (2, 1), (2, 0), (None, 7), (None, 8), (3, None)], "run long, n long")
    out = O.sections(rows, ["run"], "n")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Exchange") == 1
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, 4, 2), (1, 9, 1), (1, 11, 1), (2, None, 1), (2, 0, 2), (None, 7, 2), (3, None, 1)], key=repr)
