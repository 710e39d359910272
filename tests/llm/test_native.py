"""Line dedup and exact dedup against brute force, with nulls, repeats, long texts and clashing columns."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm.exact_dedup import exact_dedup, filter_bits
from quire.llm.line_dedup import line_dedup

BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, kept string, n_lines string, row string, id int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "mine", "mine", "mine", 1) for i, t in rows], SCHEMA)


def strip(t):
    return "".join(c for c in t or "" if c not in BLANKS)


def random_rows(seed, n=400):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "γάμμα", "x\ty", "z", " ", "\x0b"]
    return [(rng.choice([k, k, k, None, 7]), rng.choice([None, "", " ".join(rng.choices(words, k=rng.randint(0, 4))), f"only {k}"])) for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_dedup_equals_brute_force(spark, seed):
    rows = random_rows(seed) + [(5000, "y" * 200_000), (5001, "y " * 200_000)]
    got = exact_dedup(docs(spark, rows)).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[strip(t)].append((-len(t or ""), i is None, i))
    assert len(got) == len(rows)
    for r in got:
        g = groups[strip(r.text)]
        assert (r.keep_id, r.group_size, r.text_sha256) == (min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2], len(g), hashlib.sha256(strip(r.text).encode()).hexdigest())
    for key in groups:
        assert sum(r.kept for r in got if strip(r.text) == key) == 1
    assert got[0].row == "mine"


def test_exact_dedup_of_nothing(spark):
    out = exact_dedup(docs(spark, []))
    assert out.count() == 0 and {"keep_id", "group_size", "kept", "text_sha256"} <= set(out.columns)


def test_filter_grows_with_the_rows():
    assert filter_bits(0) == 4096 and filter_bits(1000) == 16384 and filter_bits(10**12) >= 16 * 10**12


def test_exact_dedup_without_a_broadcast(spark, monkeypatch):
    rows = random_rows(9)
    want = sorted(map(repr, exact_dedup(docs(spark, rows)).select("doc_id", "keep_id", "group_size", "text_sha256").collect()))
    monkeypatch.setattr("quire.llm.exact_dedup.BROADCAST_BITS", 0)
    assert sorted(map(repr, exact_dedup(docs(spark, rows)).select("doc_id", "keep_id", "group_size", "text_sha256").collect())) == want


def test_columns_that_clash_in_another_case(spark):
    rows = spark.createDataFrame([(1, "a", "x", "y", 2), (2, "a", "x", "y", 2), (3, None, None, None, None)], "doc_id long, text string, KEPT string, N_Lines string, Row int")
    out = exact_dedup(rows)
    assert out.columns == ["doc_id", "text", "N_Lines", "Row", "keep_id", "group_size", "kept", "text_sha256"] and out.where("kept").count() == 2
    out = line_dedup(rows)
    assert out.columns == ["doc_id", "text", "KEPT", "Row", "n_lines", "n_dropped"] and out.count() == 3


def test_one_of_many_rows_that_repeat_id_and_text(spark):
    out = exact_dedup(spark.createDataFrame([(1, "same text")] * 500 + [(2, "same text")] * 3, "doc_id long, text string"))
    assert out.where("kept").count() == 1 and {tuple(r) for r in out.select("keep_id", "group_size").collect()} == {(1, 503)}


def lines_brute(rows, min_chars=40, min_docs=5):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(BLANKS).translate(upper)
    where = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            where[key(x)].add(i)
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = []
        for x in ls:
            ids = where[key(x)]
            last = max((j for j in ids if j is not None), default=None)
            if len(key(x)) >= min_chars and len(ids) >= min_docs and i != last:
                continue
            kept.append(x)
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("seed", [3, 4])
def test_line_dedup_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    common = ["The same Long line that many documents hold, forty and more", "ÉÉ the same long line with accents that is long enough here", "short", "", "  \tpadded  line that is long enough to be counted by its key\r", "x" * 39]
    rows = [(rng.choice([k, k, k, 3, None]), rng.choice([None, "\n".join(rng.choice([str.upper, str, lambda s: " " + s])(rng.choice(common)) for _ in range(rng.randint(0, 6)))])) for k in range(60)]
    rows += [(1000, "\n".join(["w" * 50, common[0]] * 3000))]
    got = line_dedup(docs(spark, rows)).collect()
    assert sorted(repr((r.doc_id, r.n_lines, r.n_dropped, r.text)) for r in got) == lines_brute(rows)


def test_line_dedup_of_nothing(spark):
    assert line_dedup(docs(spark, [])).count() == 0


def test_no_python_in_the_native_plans(spark):
    rows = docs(spark, [(k, f"text {k % 3}") for k in range(9)])
    for out in (exact_dedup(rows), line_dedup(rows)):
        plan = out._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_hot_group_of_copies(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy of one text").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    out = exact_dedup(rows)
    assert out.where("kept").count() == 2001 and out.where("group_size = 1000 AND keep_id = 0").count() == 1000
