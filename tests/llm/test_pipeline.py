"""The pipeline keeps each document once, and no toxic, poor or near-equal ones."""

import os

import pytest

import corpus_pipeline
from quire.plans.staging import stage

SF = "/root/testdata/sf0.1"  # the smaller tables have too few toxic texts a language to learn from
needs = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@needs
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    known = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    sizes = [docs.count()]
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, SF), name)
        assert docs.columns == columns
        sizes.append(docs.count())
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        told = left & set(known)
        if name == "toxicity":
            assert sum(known[i].toxic for i in told) <= 0.02 * len(known)
            assert sum(1 - known[i].toxic for i in told) >= 0.98 * sum(1 - r.toxic for r in known.values())
        if name == "quality":
            assert sum(1 - known[i].quality for i in told) <= 0.02 * len(known)
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.6 * sizes[0]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == left


SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, KEPT string, Score double"


@needs
@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows_in_each_stage(spark, name):
    step = dict(corpus_pipeline.STAGES)[name]
    long = "the river ran by the old house and the boy went down to it " * 3000
    base = [f"w{k}" for k in range(80)]
    near = " ".join([*base[:79], "end"])
    rows = [(1, None), (2, ""), (3, " \n"), (None, near), (5, " ".join(base)), (5, " ".join(base)), (None, "only words of its own"), (8, long), (None, None)]
    docs = spark.createDataFrame([(*r, "x", 0.5) for r in rows], SCHEMA)
    assert step(spark, docs.limit(0), SMALL).count() == 0
    out = step(spark, docs, SMALL)
    if name == "packing":
        assert out.groupBy().sum("length").first()[0] > 30_000 and out.where("doc_id IS NULL").count() == 3
        return
    assert out.columns == docs.columns
    got = sorted((str(r.doc_id), (r.text or "")[:9]) for r in out.collect())
    if name == "exact_dedup":
        assert got == sorted([("3", " \n"), ("None", near[:9]), ("5", "w0 w1 w2 "), ("None", "only word"), ("8", "the river")])
    if name == "ngram_join":
        assert got == sorted([("1", ""), ("2", ""), ("3", " \n"), ("5", "w0 w1 w2 "), ("None", "only word"), ("8", "the river"), ("None", "")])
    if name in ("toxicity", "quality"):
        assert got.count(("5", "w0 w1 w2 ")) in (0, 2)
