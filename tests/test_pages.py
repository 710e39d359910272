"""Spreading blocks, coded rows, copies, envelopes and outcomes of streams."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import blocks as K
from quire.sources import group4 as G, history
from quire.sources.copies import copy_files
from quire.streaming import outcomes as O


def plain_spread(means, known):
    """Rounds over the unknown blocks, row by row."""
    height, width = means.shape
    m, done = means.copy(), known.copy()
    while not done.all():
        moved = False
        for y in range(height):
            for x in range(width):
                if done[y, x]:
                    continue
                total, n = 0.0, 0
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        if (dx or dy) and 0 <= x + dx < width and 0 <= y + dy < height and done[y + dy, x + dx]:
                            total, n = total + m[y + dy, x + dx], n + 1
                if n:
                    m[y, x], done[y, x], moved = total / n, True, True
        if not moved:
            break
    if not done.all():
        total = 0.0
        for v in m[done]:
            total += v
        m[~done] = total / done.sum() if done.any() else 128.0
    return m


@pytest.mark.parametrize("seed", range(30))
def test_spreading_equals_rounds_row_by_row(seed):
    rng = np.random.default_rng(seed)
    shape = (int(rng.integers(1, 24)), int(rng.integers(1, 24)))
    known = rng.random(shape) < rng.choice([0.0, 0.01, 0.05, 0.3, 0.9])
    means = np.where(known, rng.random(shape) * 255, 0)
    assert (K.spread(means, known) == plain_spread(means, known)).all()


def test_spreading_is_linear_in_the_blocks():
    known = np.zeros((600, 600), bool)
    known[-1, -1] = True  # a round a diagonal, upwards and to the left
    out = K.spread(np.where(known, 7.0, 0.0), known)
    assert (out == 7).all()


def test_spread_blocks_of_pages(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i, (h, w) in enumerate([(5, 7), (8, 8), (1, 1), (9, 3)]):
        rows.append((i, w, rng.integers(0, 256, h * w).tolist(), (rng.random(h * w) < 0.2).astype(int).tolist()))
    rows += [(8, 4, [9] * 16, [0] * 16), (9, 0, [], []), (10, None, None, None)]
    pages = spark.createDataFrame([(*r, "mine") for r in rows], "id long, width int, v array<int>, m array<int>, V_blocks2 string")
    for flat in (False, True):
        got = {r.id: r for r in K.spread_blocks(pages, ["v"], "m", 3, flat).collect()}
        for i, w, v, m in rows[:5]:
            v, m = np.array(v, float).reshape(-1, w), np.array(m).reshape(-1, w) == 1
            cells = [[(v[y : y + 3, x : x + 3][m[y : y + 3, x : x + 3]]) for x in range(0, w, 3)] for y in range(0, len(v), 3)]
            known = np.array([[len(c) > 0 for c in r] for r in cells])
            means = np.array([[c.sum() / len(c) if len(c) else 0.0 for c in r] for r in cells])
            want = plain_spread(means, known) if not flat else np.where(known, means, means[known].mean() if known.any() else 128.0)
            assert np.abs(np.array(got[i].v_blocks) - np.floor(want + 0.5).ravel()).max() <= (1 if flat else 0) and got[i].block_width == -(-w // 3)
        assert got[9].v_blocks is None and got[10].v_blocks is None


# ---- coded rows


def decoded(data, height, width):
    """Bit by bit, with the codes looked up in dictionaries."""
    bits = "".join(f"{b:08b}" for b in data)
    short = [dict(zip(c, range(64))) | {x: 64 * (k + 1) for k, x in enumerate([*long, *G.BOTH_64])} for c, long in ((G.WHITE, G.WHITE_64), (G.BLACK, G.BLACK_64))]
    modes = {G.PASS: "pass", G.HORIZONTAL: "across"} | {v: k for k, v in G.VERTICAL.items()}
    at = 0

    def code(table):
        nonlocal at
        for n in range(1, 14):
            if (x := bits[at : at + n]) in table:
                at += n
                return table[x]
        raise ValueError(bits[at : at + 20])

    def run(colour):
        total = 0
        while (n := code(short[colour])) >= 64:
            total += n
        return total + n

    out, above = [], [0] * width
    for _ in range(height):
        row, a0, colour = [], -1, 0
        while a0 < width:
            start = max(a0, 0)
            b1 = a0 + 1 if a0 >= 0 else 0
            while b1 < width and not (above[b1] != colour and (above[b1 - 1] if b1 else 0) == colour):
                b1 += 1
            b2 = b1
            while b2 < width and above[b2] != colour:
                b2 += 1
            mode = code(modes)
            if mode == "pass":
                row += [colour] * (b2 - start)
                a0 = b2
            elif mode == "across":
                for c in (colour, 1 - colour):
                    n = run(c)
                    row += [c] * n
                    start += n
                a0 = start
            else:
                row += [colour] * (b1 + mode - start)
                a0, colour = b1 + mode, 1 - colour
        assert len(row) == width
        out.append(row)
        above = row
    assert bits[at : at + 24] == G.END and len(bits) - at - 24 < 8
    return np.array(out)


def test_codes_are_free_of_prefixes():
    for short, long in ((G.WHITE, G.WHITE_64), (G.BLACK, G.BLACK_64)):
        codes = sorted([*short, *long, *G.BOTH_64])
        assert len(short) == 64 and len(long) == 27 and len(G.BOTH_64) == 13
        assert not any(b.startswith(a) for a, b in zip(codes, codes[1:])) and not any(c.startswith("00000000") for c in codes)
    modes = sorted([G.PASS, G.HORIZONTAL, *G.VERTICAL.values()])
    assert not any(b.startswith(a) for a, b in zip(modes, modes[1:]))


@pytest.mark.parametrize("seed", range(25))
def test_coded_pages_are_decoded_to_the_same_bits(seed):
    rng = np.random.default_rng(seed)
    height, width = int(rng.integers(1, 20)), int(rng.choice([1, 2, 7, 8, 64, 200, 5300]))
    kind = seed % 5
    if kind == 0:
        black = rng.random((height, width)) < 0.5
    elif kind == 1:
        black = np.zeros((height, width), bool)
    elif kind == 2:
        black = np.ones((height, width), bool)
    else:
        black = np.repeat(rng.random((height, width // 9 + 1)) < 0.4, 9, 1)[:, :width]
        black = np.roll(black, 2, 1) if kind == 3 else black | np.roll(black, 1, 0)
    assert (decoded(G.coded(black), height, width) == black).all()


def test_known_bytes():
    assert G.coded(np.zeros((1, 8), bool)).hex() == "80080080"  # one upright code, then the end of block
    assert G.coded(np.zeros((0, 8), bool)).hex() == "001001"


def test_coded_pages_query(spark):
    import __spark_entry__ as entry
    from quire.plans.bindings_more import grey_pages

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("the driver's tables are not here")
    pixels = {r.id: np.array(r.v).reshape(8, 8) < 128 for r in grey_pages(spark, sf).collect()}
    rows = entry.queries()["coded_pages"](spark, sf).collect()
    assert len(rows) == len(pixels)
    for r in rows:
        assert (decoded(bytes.fromhex(r.coded), 8, 8) == pixels[r.id]).all() and r.around > 300


def test_marks_without_pages(spark):
    rows = spark.createDataFrame([(1, 4, [1, 0, 0, 1], "mine"), (2, 0, [], "mine"), (3, None, None, None)], "id long, width int, m array<int>, coded string")
    got = {r.id: r.coded for r in G.group4(rows, "m").collect()}
    assert (decoded(bytes(got[1]), 1, 4) == [[1, 0, 0, 1]]).all() and got[2] is None and got[3] is None


# ---- copies


def test_large_files_are_copied_in_pieces(spark, tmp_path):
    """A file larger than what a task may hold: Python workers may use 64 MB more than they begin with, the file has 200."""
    big, n = tmp_path / "big.bin", 200
    block = random.Random(1).randbytes(1 << 20)
    digest = hashlib.sha256()
    with open(big, "wb") as f:
        for _ in range(n):
            f.write(block)
            digest.update(block)
    digest.update(b"tail")
    (tmp_path / "small.bin").write_bytes(b"abc")
    uri = lambda name: f"file://{tmp_path}/{name}"
    plan = spark.createDataFrame([(1, uri("big.bin"), uri("out/big.bin"), bytearray(b"tail"), "x"), (2, uri("small.bin"), uri("out/small.bin"), None, "x"), (3, uri("small.bin"), uri("SMALL.bin"), None, "x"), (4, uri("gone.bin"), uri("out/gone.bin"), None, "x")], "id long, source string, target string, section binary, Status string")

    def limited(batches):
        import resource

        begin = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        yield from batches
        assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - begin < 64 << 10, "too much memory"

    out = {r.id: r for r in copy_files(plan.drop("Status"), section="section").mapInArrow(limited, "id long, source string, target string, section binary, status string, size long, sha256 string").collect()}
    assert (out[1].status, out[1].size, out[1].sha256) == ("ok", (n << 20) + 4, digest.hexdigest())
    assert (tmp_path / "out/small.bin").read_bytes() == b"abc" and out[3].status == "sameFile" and out[4].status == "missing"
    assert sorted(os.listdir(tmp_path / "out")) == ["big.bin", "small.bin"] and os.path.getsize(tmp_path / "out/big.bin") == (n << 20) + 4


def test_a_copy_that_fails_leaves_the_old_target(tmp_path):
    from quire.sources import copies

    (tmp_path / "a").write_bytes(b"new" * 10)
    (tmp_path / "b").write_bytes(b"old")

    with pytest.raises(TypeError):
        copies._copied(f"file://{tmp_path}/a", f"file://{tmp_path}/b", 5, 4)  # fails behind the last piece
    assert (tmp_path / "b").read_bytes() == b"old" and sorted(os.listdir(tmp_path)) == ["a", "b"]
    assert copies._copied(f"file://{tmp_path}/a", f"file://{tmp_path}/b", None, 4)[0] == "ok" and (tmp_path / "b").read_bytes() == b"new" * 10


# ---- envelopes


def envelope_rows(spark, n, first=0):
    return spark.range(first, first + n).select(F.col("id").alias("pos"), F.col("id").cast("string").alias("id"), F.lit("file:///x").alias("folderURL"), F.col("id").alias("savedBytes"))


def test_an_envelope_is_replaced_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/env"
    history.write_history(envelope_rows(spark, 3), envelope_rows(spark, 10).select("savedBytes"), path)
    told = lambda: ([r.id for r in history.read_history(spark, path).orderBy("pos").collect()], spark.read.json(path).collect()[0].lifetimeSavedBytes)
    assert told() == (["0", "1", "2"], 45)
    broken = envelope_rows(spark, 5, 7).withColumn("savedBytes", F.raise_error(F.lit("killed")).cast("long"))
    with pytest.raises(Exception, match="killed"):
        history.write_history(broken, 1, path)
    assert told() == (["0", "1", "2"], 45)

    def torn(*_):
        raise OSError("killed before the rename")

    with monkeypatch.context() as m:
        m.setattr(history, "_replace", torn)
        with pytest.raises(OSError):
            history.write_history(envelope_rows(spark, 5, 7), 1, path)
    assert told() == (["0", "1", "2"], 45) and [x for x in os.listdir(tmp_path / "env") if not x.startswith(".")] == [history.NAME]
    history.write_history(envelope_rows(spark, 2, 7), 99, path)
    assert told() == (["7", "8"], 99)
    history.write_history(envelope_rows(spark, 0), envelope_rows(spark, 0).select("savedBytes"), path)
    assert told() == ([], 0)


# ---- outcomes


def test_outcomes_of_a_stream_are_taken_in_once(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", O.STORE)
    source, table, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "row long, k long, kind string, size long"

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        ticks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        O.ingested(O.first_outcomes(ticks, "row", "k", "kind", ["done", "failed"]), table, checkpoint).awaitTermination()
        return sorted((r.row, r.k, r.kind) for r in spark.read.schema(schema).parquet(table).collect())

    feed([(1, 5, "done", 1), (1, 3, "failed", 1), (1, 1, "tick", 0), (2, 1, "tick", 0)])
    assert run() == [(1, 3, "failed")]
    feed([(1, 9, "done", 7), (2, 4, "done", 2), (3, 1, "done", 3), (3, 1, "done", 3)])
    want = [(1, 3, "failed"), (2, 4, "done"), (3, 1, "done")]
    assert run() == want
    last = max(int(x) for x in os.listdir(os.path.join(checkpoint, "commits")) if x.isdigit())
    for name in (f"{last}", f".{last}.crc"):  # as if the driver had died before the batch was committed
        if os.path.exists(os.path.join(checkpoint, "commits", name)):
            os.remove(os.path.join(checkpoint, "commits", name))
    assert run() == want
    feed([(2, 8, "failed", 2), (4, 2, "failed", 2)])
    assert run() == [*want, (4, 2, "failed")]
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_tables_staged_in_a_scope_are_deleted_at_its_end(spark, tmp_path):
    from quire.plans.staging import stage, staged

    with staged(spark):
        kept = stage(spark.range(5), "a").inputFiles()
        with staged(spark):
            inner = stage(spark.range(3), "b").inputFiles()
        assert not any(os.path.exists(f.removeprefix("file://")) for f in inner) and all(os.path.exists(f.removeprefix("file://")) for f in kept)
    outside = stage(spark.range(2), "c")
    assert not any(os.path.exists(f.removeprefix("file://")) for f in kept) and outside.count() == 2
