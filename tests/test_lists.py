"""Names, runs of pixels, estimates and cards against brute force."""

import random

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import keyed as K, ordered as O, pixels as P, totals as A
from quire.sources import files as B


def test_names_avoid_all_that_is_taken(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice("xy"), rng.choice(["a", "A", "b", "a-small"])) for k in range(80)]
    taken = [("x", rng.choice(["a-small.pdf", "A-Small-2.pdf", "a-small-3.PDF", "b-small-1.pdf", "a-small-01.pdf", "a-small-0.pdf", "other.pdf"])) for _ in range(12)]
    out = K.exact_output_names(spark.createDataFrame(rows, "id long, folder string, base string"), "folder", "base", "id", taken=spark.createDataFrame(taken, "folder string, name string"))
    used = {(f, n.lower()) for f, n in taken}
    want = {}
    for k, folder, base in rows:
        turn = 0
        while (folder, (name := f"{base}-small{f'-{turn}' if turn else ''}.pdf").lower()) in used:
            turn += 1
        used.add((folder, name.lower()))
        want[k] = name
    assert {r.id: r.output_name for r in out.collect()} == want


def regions(ink):
    left, sizes = set(ink), []
    while left:
        stack, n = [left.pop()], 0
        while stack:
            x, y = stack.pop()
            n += 1
            for dx in (-1, 0, 1):
                for dy in (-1, 0, 1):
                    if (x + dx, y + dy) in left:
                        left.remove((x + dx, y + dy))
                        stack.append((x + dx, y + dy))
        sizes.append(n)
    return [n for n in sizes if n >= 3]


def test_components_equal_a_flood_fill(spark):
    rng = random.Random(5)
    pages = {k: {(x, y): int(rng.random() < 1 - k / 12) * 255 for x in range(31) for y in range(17)} for k in range(12)}
    pages[12] = {(x, y): 0 if (x + y) % 2 == 0 or x == 0 else 255 for x in range(31) for y in range(17)}
    pix = spark.createDataFrame([(k, x, y, v) for k, p in pages.items() for (x, y), v in p.items()], "id long, x int, y int, v int")
    got = {r.id: (r.components, r.mean_area) for r in P.components(pix, spark.createDataFrame([(k, 128) for k in pages], "id long, threshold int")).collect()}
    for k, p in pages.items():
        sizes = regions([at for at, v in p.items() if v < 128])
        assert got[k][0] == len(sizes) and abs(got[k][1] - (sum(sizes) / len(sizes) if sizes else 0.0)) < 1e-9


def test_verdicts_of_pages(spark):
    rows = spark.createDataFrame([(1, 0.1, 0.0, 50.0, 60, 0.0), (2, 0.1, 0.0, 50.0, 60, 0.2), (3, 0.5, 0.0, 50.0, 60, 0.0), (4, 0.1, 0.4, 50.0, 60, 0.0), (5, 0.1, 0.0, 221.0, 60, 0.0), (6, 0.1, 0.0, 50.0, 39, 0.0)], "id int, ink double, colour double, area double, n int, moderate double")
    out = rows.select("id", P.envelope(*map(F.col, ("ink", "colour", "area", "n", "moderate"))).alias("v"))
    assert [r.v for r in out.orderBy("id").collect()] == [None, "chromaPattern", *["notTextDominant"] * 4]


def test_estimates_pass_batches_by(spark):
    rows = [(k % 3, k, (k % 40 + 1) / 41, k * 0.5) for k in range(3000)]
    ticks = spark.createDataFrame(rows, "job long, n long, fraction double, elapsed double")
    want = {}
    for job in range(3):
        rate = eta = last = None
        for _, n, f, t in [r for r in rows if r[0] == job]:
            if f == last:
                continue
            last = f
            if f >= 0.1 and t > 0:
                rate = f / t if rate is None else 0.3 * (f / t) + 0.7 * rate
                left = int(max(0.0, 1 - f) / rate + 0.5)
                eta = left if eta is None else min(left, eta)
            else:
                eta = None
            want[job, n] = eta
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = {(r.job, r.n): r.eta for r in O.smoothed_eta(ticks, ["job"], "n").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    assert got == want


def test_change_quality_list(spark):
    rows = [("a", 100, "small", {"big": 300}, False, None), ("a", 200, "big", {"big": 1, "small": 50}, None, None), ("a", 400, "small", {"big": 9}, True, []), ("a", 50, None, {"small": 5}, False, ["small"])]
    out = A.change_quality_totals(spark.createDataFrame(rows, "run string, current long, own_preset string, predictions map<string,long>, excluded boolean, futile array<string>"), spark.createDataFrame([("big",), ("small",)], "preset string"), "run")
    assert {(r.preset, r.total_bytes) for r in out.collect()} == {("big", 300 + 200 + 400 + 50), ("small", 100 + 50 + 400 + 50)}


def test_texts_of_blanks(spark):
    rows = spark.createDataFrame([("   \t\n",), ("",), (None,), (" x ",)], "t string")
    assert [r[0] for r in rows.select(T.has_text(F.col("t"))).collect()] == [False, False, False, True]
    names = spark.createDataFrame([("A#20b#2Fc",), ("#zz#41",), ("plain",), ("#",), (None,), ("a##41",)], "n string")
    assert [r[0] for r in names.select(B.unescaped_name(F.col("n"))).collect()] == ["A b/c", "#zzA", "plain", "#", None, "a#A"]
