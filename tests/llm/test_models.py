"""Classifiers, language model and rules: contracts on small tables, held-out accuracy on the driver's."""

import collections
import math
import os
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import lm_scoring, quality_classifier, quality_rules, textkernel, toxicity
from quire.llm.textkernel import BYTES_FOLDED, chunks

SF = "/root/testdata/sf0.1"
held = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "x"), (5, "word " * 40_000), (6, "word " * 60 + "\n" + "word " * 60), (7, "ß é\x85 #*$%&|<>\n\na b c\na b c"), (None, "no id"), (4, "x")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1.5, "x", "src", "en") for i, t in rows], "doc_id long, text string, score double, predicted string, source string, lang string")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_flat_texts_with_offsets_and_nulls():
    col = pa.array(["skip", None, "a b", "", "é\x0bz  "])[1:]
    [(a, b, w)] = list(chunks(col))
    assert (a, b) == (0, 4) and w.per_doc().tolist() == [0, 2, 0, 2]
    assert [bytes(w.buf[s:e]) for s, e in zip(w.start, w.end)] == [b"a", b"b", "é".encode(), b"z"]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcÉß") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    seen = {}
    for _, _, w in chunks(pa.array([" ".join(words), "\n".join(words[::-1])])):
        for s, e, h in zip(w.start, w.end, w.hash):
            assert seen.setdefault(bytes(w.buf[s:e]), h) == h
    assert len(set(seen.values())) == len(seen)


def twins(letters):
    """Two words that a polynomial modulo a power of two cannot tell apart."""
    a = "a"
    while len(a) < letters:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("letters", [1024, 4096])
def test_twin_words_and_lines(spark, letters):
    a, b = twins(letters)
    [(_, _, w)] = list(chunks(pa.array([f"{a} {b}"])))
    assert w.hash[0] != w.hash[1] and w.number[0] != w.number[1]
    rows = [(1, f"{a}\n{b}"), (2, f"{a} x y {b} x y"), (3, f"{a} x y {a} x y\n{b}\n{b}")]
    out = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, rows), labels(spark, [])).collect()}
    assert {i: (out[i].n_dup_lines, out[i].n_repeat_words) for i in out} == {i: base_rules(t)[3:] for i, t in rows}
    held_out = next(k for k in range(100, 999) if zlib.crc32(str(k).encode()) % 7 == 2)
    known = {r.doc_id: r.n_known for r in lm_scoring.lm_scores(frame(spark, [(0, a), (held_out, b)])).collect()}
    assert known[held_out] == 1


def test_bytes_decide_where_hashes_meet(monkeypatch):
    real = textkernel.hashes
    monkeypatch.setattr(textkernel, "hashes", lambda low, start, end: real(low, start, end) % np.uint64(5))
    rng = random.Random(2)
    texts = ["\n".join(" ".join(rng.choice(["long word number", "x", "yy", "zzz"]) + str(rng.randint(0, 9)) for _ in range(9)) for _ in range(6)) for _ in range(20)]
    [(_, _, w)] = list(chunks(pa.array(texts)))
    words = [bytes(w.buf[i:j]) for i, j in zip(w.start, w.end)]
    assert len(set(words)) == len(set(w.number.tolist())) == len(set(zip(words, w.number.tolist())))
    field = quality_rules.Field(np.zeros(quality_rules.N_FEATURES), np.zeros((2, 2)), np.zeros(2))
    counts, _ = quality_rules.measure(w, field)
    assert [tuple(int(counts[c][k]) for c in quality_rules.MEASURES) for k in range(20)] == [base_rules(t) for t in texts]


def test_numbers_of_runs_are_exact():
    number = np.random.default_rng(5).integers(0, 1 << 31, 400) * np.array([1, 0] * 200)
    for size in (1, 2, 3, 5):
        runs = [tuple(number[k : k + size]) for k in range(len(number) - size + 1)]
        got = textkernel.exact_windows(number, size).tolist()
        assert len(set(runs)) == len(set(got)) == len(set(zip(runs, got)))


@pytest.mark.parametrize("rows", [[], [(9, 1, 1)], [(1, 1, 0), (6, 0, 1), (7, 1, 0), (5, 0, 1), (4, None, None)]])
def test_classifiers_on_odd_rows(spark, rows):
    for fn, args in ((toxicity.toxicity, {}), (quality_classifier.quality, {})):
        out = fn(frame(spark, ODD), labels(spark, rows), **args).collect()
        assert len(out) == len(ODD) and all(0 <= r.score <= 1 and r.source == "src" for r in out)
        assert {r.doc_id: r.held_out for r in out if r.doc_id} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in ODD if i}
        assert len({r.score for r in out if not (r.text or "").strip()}) == 1
        assert fn(frame(spark, []), labels(spark, rows)).count() == 0


def base_rules(t):
    t = t or ""
    ws = WORD.findall(t)
    seen, again = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    triples = collections.Counter(zip(ws, ws[1:], ws[2:]))
    covered = {k + j for k in range(len(ws) - 2) if triples[tuple(ws[k : k + 3])] > 1 for j in range(3)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), again, len(covered)


def test_base_rules_equal_brute_force(spark):
    rng = random.Random(6)
    rows = ODD + [(100 + k, "".join(rng.choice(["a ", "b\t", "c\n", "d é", "| #"]) for _ in range(rng.randint(0, 200)))) for k in range(150)]
    out = quality_rules.quality_rules(frame(spark, rows), labels(spark, [(1, 1, 0), (6, 0, 1), (7, 1, 0), (5, 0, 1)])).collect()
    got = sorted(repr(tuple(r[:6])) for r in out)
    assert got == sorted(repr((i, *base_rules(t))) for i, t in rows)
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.content_share >= 0.5)


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(2)
    for n in range(1, 7):
        field = quality_rules.Field(rng.normal(size=3), rng.normal(size=(2, 2)), rng.normal(size=2))
        x = rng.normal(size=(n, 3))

        def weight(path):
            out = field.begin[path[0]] + sum(field.step[a, b] for a, b in zip(path, path[1:]))
            return out + sum((x[t] @ field.emit) * path[t] for t in range(n))

        best = max((tuple(k >> t & 1 for t in range(n)) for k in range(1 << n)), key=weight)
        assert tuple(field.decode(x, np.array([0, n]))) == best


@held
def test_lines_of_texts_of_both_kinds_are_marked_line_by_line(spark):
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    pools = {0: [], 1: [], "fit": ([], [])}
    for r in spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id").isin(list(known))).orderBy("doc_id").collect():
        v, n = known[r.doc_id], len(r.text.split())
        if zlib.crc32(str(r.doc_id).encode()) % 5 and len(pools["fit"][0]) < 1600:
            pools["fit"][0].append(r.text)
            pools["fit"][1].append(v)
        elif n >= (60 if v else 30):
            pools[v].append(r.text)
    field = quality_rules.fit(*pools["fit"], 0.87)
    right = total = both = 0
    for k in range(60):
        parts = [(pools[1][k % len(pools[1])], 1), (pools[0][k % len(pools[0])], 0)][:: 1 if k % 2 else -1]
        [(_, _, w)] = list(chunks(pa.array(["\n".join(t for t, _ in parts)])))
        lines = quality_rules.lines(w)
        mark = field.decode(lines.features, lines.first(1))
        want = np.concatenate([np.full(t.count("\n") + 1, v) for t, v in parts])
        right, total, both = right + (lines.words * (mark == want)).sum(), total + lines.words.sum(), both + (0 < mark.mean() < 1)
    assert right > 0.95 * total and both > 50


def test_factorisation_equals_all_pairs():
    rng = np.random.default_rng(3)
    size = (1 << quality_classifier.BITS) + quality_classifier.N_STATS
    m = quality_classifier.Machine(0.1, rng.normal(size=size), rng.normal(size=(size, quality_classifier.FACTORS)), np.zeros(quality_classifier.N_STATS), np.ones(quality_classifier.N_STATS))
    [(_, _, w)] = list(chunks(pa.array(["one two two three"]), BYTES_FOLDED))
    x = rng.normal(size=(1, quality_classifier.N_STATS))
    value = collections.Counter()
    for h in w.hash:
        value[int(h) >> (64 - quality_classifier.BITS)] += quality_classifier.SHARE / 4
    for k in range(quality_classifier.N_STATS):
        value[(1 << quality_classifier.BITS) + k] = x[0, k]
    keys = list(value)
    want = m.bias + sum(m.linear[k] * value[k] for k in keys)
    want += sum(m.factors[a] @ m.factors[b] * value[a] * value[b] for i, a in enumerate(keys) for b in keys[:i])
    assert math.isclose(m.raw(w, x)[0][0], want, rel_tol=1e-9)


def test_subsequence_kernel_equals_brute_force():
    def letters(word):
        [(_, _, w)] = list(chunks(pa.array([word]), BYTES_FOLDED))
        return toxicity.letter_rows(w)[0]

    def features(row):
        out = collections.Counter()
        for i in range(len(row)):
            for j in range(i + 1, len(row)):
                for k in range(j + 1, min(len(row), i + toxicity.SPAN + 1)):
                    if row[i] and row[j] and row[k]:
                        out[row[i], row[j], row[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    for a, b in (("idiot", "idxiot"), ("moron", "m.o.r.o.n"), ("trash", "thrash")):
        x, y = letters(a), letters(b)
        f, g = features(x[0].tolist()), features(y[0].tolist())
        want = sum(f[s] * g[s] for s in f) / toxicity.scale(x)[0] / toxicity.scale(y)[0]
        assert math.isclose(float(toxicity.project(x, toxicity.embed(y, np.arange(toxicity.LETTERS**3)), np.arange(toxicity.LETTERS**3))[0, 0]), want, rel_tol=1e-4)
    assert (letters("moron") == letters("m.o.r.o.n")).all() and (letters("moron") == letters("m o r o n")).all()


def test_lm_contract(spark):
    rng = random.Random(9)
    rows = [r for r in ODD] + [(200 + k, " ".join(rng.choice(["The", "the", "cat", f"rare{k}", "über"]) for _ in range(rng.randint(0, 80)))) for k in range(120)]
    out = lm_scoring.lm_scores(frame(spark, rows)).collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = lambda t: [*WORD.findall((t or "").translate(low)), None]
    is_held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = collections.Counter(w for i, t in rows if not is_held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out)
    want = sorted((str(i), is_held(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows)
    assert got == want and all(r.score < 0 for r in out)
    assert lm_scoring.lm_scores(frame(spark, [])).count() == 0


def test_lm_knows_the_order_of_words(spark):
    rng = random.Random(12)
    after = {f"w{k}": [f"w{(7 * k + j) % 40}" for j in range(1, 3)] for k in range(40)}

    def walk(n):
        out = ["w0"]
        while len(out) < n:
            out.append(rng.choice(after[out[-1]]))
        return out

    rows = [(k, " ".join(walk(60))) for k in range(400)]
    odd = [w for i, t in rows[:60] if zlib.crc32(str(i).encode()) % 7 == 2 for w in [t.split()]]
    mixed = [(next(j for j in range(10_000 * (k + 1), 10_000 * (k + 2)) if zlib.crc32(str(j).encode()) % 7 == 2), " ".join(rng.sample(w, len(w)))) for k, w in enumerate(odd)]
    out = {r.doc_id: r for r in lm_scoring.lm_scores(frame(spark, rows + mixed)).collect()}
    held = [r for i, r in out.items() if r.held_out and i < 10_000]
    assert len(held) > 30 and sum(r.score for r in held) / sum(r.n_tokens for r in held) > -0.6  # two words may follow; -1.6 without order
    assert sum(out[i].score for i, _ in mixed) / sum(out[i].n_tokens for i, _ in mixed) < -1.3


def test_predictive_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    n = rng.poisson(2, 50)
    t = np.minimum(n, 1)
    c = t + rng.poisson(1, 50)  # other contexts' tables
    root = np.minimum(c, 1)
    now = lm_scoring.Weights(0.7, 2.0, 0.4, 3.0, c.sum(), root.sum(), 50)
    parent = np.r_[now.parent(c, root), now.parent(np.zeros(1), np.zeros(1))]
    assert np.isclose(parent.sum(), 1)
    p = now.predict(np.r_[n, 0], np.r_[t, 0], np.full(51, n.sum()), np.full(51, t.sum()), parent)
    assert np.isclose(p.sum(), 1)


def test_score_with_all_dishes_at_one_table(spark):
    rng = random.Random(19)
    rows = [(k, " ".join(rng.choice(["the", "cat", "sat", "on", f"w{k % 7}"]) for _ in range(rng.randint(0, 30)))) for k in range(80)]
    out = lm_scoring.lm_scores(frame(spark, rows), samples=0).collect()
    texts = {i: [*t.split(), None] for i, t in rows}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    pairs = collections.Counter(p for i in train for p in zip(["^", *texts[i]], texts[i]))
    guests, tables, tops = collections.Counter(), collections.Counter(), collections.Counter()
    for (x, w), n in pairs.items():
        guests[x] += n
        tables[x] += 1
        tops[w] += 1
    d, s, d0, s0 = 0.8, 1.0, 0.5, 1.0
    parent = lambda w: ((tops[w] - d0 if tops[w] else 0) + (s0 + d0 * len(tops)) / (len(tops) + 1)) / (s0 + sum(tops.values()))
    chance = lambda x, w: ((pairs[x, w] - d if pairs[x, w] else 0) + (s + d * tables[x]) * parent(w)) / (s + guests[x])
    for r in out:
        assert math.isclose(r.score, sum(math.log10(chance(*p)) for p in zip(["^", *texts[r.doc_id]], texts[r.doc_id])), rel_tol=1e-5)


def test_scores_do_not_depend_on_batches_or_shards(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice("abcdefgh") + str(int(rng.expovariate(0.2))) for _ in range(60))) for k in range(300)]
    want = {r.doc_id: (r.n_known, r.base_score, r.score) for r in lm_scoring.lm_scores(frame(spark, rows), samples=0).collect()}
    monkeypatch.setattr("quire.llm.lm_scoring.BLOCK_BYTES", 9000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r.doc_id: (r.n_known, r.base_score, r.score) for r in lm_scoring.lm_scores(frame(spark, rows).repartition(5), samples=0).collect()}
        more = {r.doc_id: r.score for r in lm_scoring.lm_scores(frame(spark, rows).repartition(3)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    assert len(got) == 300 and all(np.allclose(got[i], want[i], rtol=1e-5) for i in want)
    assert abs(sum(more.values()) - sum(w[2] for w in want.values())) < 0.1 * abs(sum(w[2] for w in want.values()))


def test_customers_leave_and_come_back():
    rng = np.random.default_rng(4)
    n = np.array([1, 2, 30, 400])
    seats = lm_scoring.Seats(n, np.array([1, 1, 2, 3]), np.array([1, 2, 29, 1, 398, 1, 1]), n)
    seen = []
    for _ in range(300):
        seats.sweep(lambda dish: np.full(len(dish), 2.0), 0.5, rng)
        assert (seats.n == n).all() and (seats.packed() > 0).all() and seats.packed().sum() == n.sum()
        seen.append(seats.t.copy())
    ways = np.array([0.0, 1.0])  # of n customers at t tables: the law is fresh ** t times these
    for i in range(1, 30):
        ways = np.r_[ways, 0.0] * (i - 0.5 * np.arange(len(ways) + 1)) + np.r_[0.0, ways]
        ways /= ways.max()
    law = ways * 2.0 ** np.arange(len(ways))
    mean = np.mean(seen[20:], 0)
    assert mean[0] == 1 and abs(mean[1] - 1.8) < 0.1 and abs(mean[2] - (law * np.arange(len(law))).sum() / law.sum()) < 0.3
    start = lm_scoring.forward(np.array([0, 1, 2, 100_000]), np.full(4, 0.5), 0.5, rng)
    assert start[0] == 0 and start[1] == 1 and start[3] < 50


def test_discount_and_strength_are_found_again():
    rng = np.random.default_rng(8)
    d, s, c, t, sizes = 0.6, 5.0, [], [], []
    for _ in range(300):  # restaurants of new dishes only: the seating tells the parameters
        tables = []
        for i in range(60):
            if rng.random() * (s + i) < s + d * len(tables):
                tables.append(1)
            else:
                tables[rng.choice(len(tables), p=(np.array(tables) - d) / (i - d * len(tables)))] += 1
        c.append(60)
        t.append(len(tables))
        sizes += tables
    at, got = (0.3, 1.0), []
    for _ in range(60):
        parts = lm_scoring.strength_parts(np.array(c), np.array(t), *at, rng)
        at = lm_scoring.sampled(*parts, lm_scoring.closed_parts(np.array(sizes), at[0], rng), rng)
        got.append(at)
    assert np.allclose(np.mean(got[20:], 0), [d, s], atol=[0.05, 1.2])


@held
def test_held_out_accuracy(spark):
    docs, known = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    for fn, name, least in ((toxicity.toxicity, "toxic", 0.94), (quality_classifier.quality, "quality", 0.98)):
        out = fn(docs.select("doc_id", "text"), known).join(known, "doc_id").where("held_out").select("predicted", name).collect()
        assert np.mean([r.predicted == r[name] for r in out]) > least
        if name == "toxic":  # of the toxic ones, and of those called toxic
            assert np.mean([r.predicted for r in out if r.toxic == 1]) > 0.88 and np.mean([r.toxic for r in out if r.predicted == 1]) > 0.9


def test_lines_without_end_in_a_training_text_are_cut():
    """One text of 40,000 lines does not stretch the others' batch, and its lines are sampled."""
    began = time.monotonic()
    texts = [f"a plain line of words number {k}.\nAnd one more, with an end." for k in range(40)] + ["\n".join(f"BUY {k} || now" for k in range(40_000))] + [f"# {k} | {k} |\n>>> {k}" for k in range(40)]
    field = quality_rules.fit(texts, [1] * 40 + [0] * 41, 0.5, rounds=10, most_lines=2_000)
    assert time.monotonic() - began < 60
    w = textkernel.words(*textkernel.flat(pa.array([texts[0], texts[40]])), textkernel.BYTES_FOLDED)
    own = quality_rules.lines(w)
    mark = field.decode(own.features, own.first(2))
    assert mark[own.doc == 0].mean() > 0.5 > mark[own.doc == 1].mean()


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_of_many_texts_are_decoded_as_one_by_one(seed):
    rng = np.random.default_rng(seed)
    field = quality_rules.Field(rng.normal(size=3), rng.normal(size=(2, 2)), rng.normal(size=2))
    length = rng.integers(0, 9, 60)
    x, first = rng.normal(size=(length.sum(), 3)), np.r_[0, np.cumsum(length)]
    whole = field.decode(x, first)
    for a, b in zip(first[:-1], first[1:]):
        assert (field.decode(x[a:b], np.array([0, b - a])) == whole[a:b]).all()


@held
def test_model_beats_the_base_on_held_out_text(spark):
    out = lm_scoring.lm_scores(spark.read.parquet(f"{SF}/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_rows_that_fill_a_block_are_scored_as_one(spark, monkeypatch):
    """A row repeated a thousand times, with an id and without one, trains a thousand times and lies in one place once."""
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice("abcd") for _ in range(20))) for k in range(100)]
    rows += [(5, "same old text " * 30)] * 1000 + [(None, "quite another " * 20)] * 500
    monkeypatch.setattr("quire.llm.lm_scoring.BLOCK_BYTES", 20_000)
    few = lm_scoring.once(spark.createDataFrame([(i, t, False) for i, t in rows], "id long, text string, held_out boolean"))
    assert few.count() == 102 and few.agg({"copies": "sum"}).collect()[0][0] == 1600
    got = lm_scoring.lm_scores(frame(spark, rows), samples=0).collect()
    monkeypatch.setattr("quire.llm.lm_scoring.COPIES", 10**9)
    want = lm_scoring.lm_scores(frame(spark, rows), samples=0).collect()
    key = lambda r: (str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 3))
    assert len(got) == len(rows) and sorted(map(key, got)) == sorted(map(key, want))


def test_a_sweep_moves_all_customers():
    """The tables of large dishes settle, on average, where one by one moves settle too."""
    n = np.r_[np.full(100, 600), np.full(100, 150)]
    ends = []
    for moves in (64, 10_000):
        rng, t = np.random.default_rng(1), []
        seats = lm_scoring.Seats(n, np.ones(200, int), n.copy(), n)
        for turn in range(40):
            seats.sweep(lambda dish: np.full(len(dish), 4.0), 0.5, rng, moves)
            assert (seats.n == n).all() and seats.packed().sum() == n.sum() and (seats.packed() > 0).all()
            t += [seats.t.reshape(2, 100).mean(1)] if turn >= 15 else []
        ends.append(np.mean(t, 0))
    assert np.allclose(ends[0], ends[1], rtol=0.1)


def test_distinct_numbers_equal_numpys():
    """Also where the bits beside the place do not tell values apart, and for none, one and the largest."""
    rng, top = np.random.default_rng(5), np.uint64(2**64 - 1)
    hashes = rng.integers(0, 2**64, 40_000, np.uint64)
    near = (rng.integers(0, 3, 5_000).astype(np.uint64) << np.uint64(62)) | rng.integers(0, 50, 5_000).astype(np.uint64)
    for values in (hashes[rng.integers(0, 9_000, 100_000)], near, rng.integers(0, 7, 300).astype(np.uint64), np.array([top, 0, top, 1], np.uint64), hashes[:1], hashes[:0], np.zeros(9, np.uint64)):
        got, want = lm_scoring.distinct(values), np.unique(values, return_inverse=True)
        assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1]) and got[0].dtype == np.uint64


def test_tokens_of_a_block_are_numbered_by_plain_sorts(monkeypatch):
    """Two sorts of places with np.unique were a quarter of the time of a block, which is read twice."""
    texts, where = pa.array(["a b a", "", "b c", "a b a"]), lm_scoring.Map(3, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    monkeypatch.setattr(np, "unique", None)
    b = lm_scoring.block_of(texts, np.array([1, 1, 0, 2]), where)
    assert b.cut[-1] == len(b.word) == len(b.n) == 8 and b.n.sum() == 4 + 1 + 2 * 4 and list(b.doc) == [0] * 4 + [1] + [2] * 3 + [3] * 4
    assert list(b.pair[:4]) == list(b.pair[-4:]) and (np.diff(where.shard(b.word, b.context)) >= 0).all()


def test_scoring_works_on_small_parts_of_a_batch():
    """What a task holds beside its batch stays small, whatever the batch's size, and scores do not depend on the parts."""
    rng = np.random.default_rng(3)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz    ", np.uint8)
    texts = [rng.choice(letters, 4000).tobytes().decode() for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts)], ["doc_id", "text"])
    model = toxicity.Model(rng.normal(size=toxicity.LETTERS**3).astype(np.float32), 0.1, np.array([1.0, 0.5]), 0.0)
    tracemalloc.start()
    got = list(toxicity.marked(model.score, "text")(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 80e6
    assert [x for g in got for x in g.column("doc_id").to_pylist()] == list(range(1000))
    whole = np.concatenate([model.score(w) for _, _, w in chunks(batch.column("text"), BYTES_FOLDED)])
    assert np.array_equal(np.concatenate([g.column("score").to_numpy() for g in got]), whole)


def test_context_rows_carry_no_more_than_the_sweep_reads():
    """Rows of contexts hold no counts or bytes that nothing reads: there are millions of them a sweep."""
    texts = pa.array(["a b a b a b c"] * 20)
    where = lm_scoring.Map(1, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    sent = lm_scoring.request(where)(iter([pa.RecordBatch.from_arrays([texts, pa.array([1] * 20), pa.array([0] * 20, pa.int32())], ["text", "trains", "block"])]))
    state = pa.Table.from_batches(list(lm_scoring.opened(where)(sent)))
    kind = state.column("kind").to_numpy()
    known = state.filter(pa.array(kind == lm_scoring.TABLES))
    assert known.num_rows and known.column("c").null_count == known.num_rows
    own, told = state.filter(pa.array(kind == lm_scoring.STATE)).select(["shard", "x", "t", "raw"]), known.select(["shard", "x", "t", "raw"])
    none = np.zeros(0, np.int64)
    out = pa.Table.from_batches(list(lm_scoring.reseated(lm_scoring.Weights(), where, none, none, 1, False, False)(iter(pa.concat_tables([own, told]).to_batches()))))
    assert (out.column("kind").to_numpy() == lm_scoring.TABLES).sum() == known.num_rows


def test_a_block_and_a_state_take_little_memory():
    """Words of a whole block at once took 15 times its text, and each number of a state eight bytes: executors passed their memory."""
    rng = np.random.default_rng(5)
    kinds = np.array([f"word{k:x}" for k in range(20_000)])
    texts = pa.array([" ".join(kinds[(rng.random(500) ** 4 * len(kinds)).astype(int)]) for _ in range(1600)])
    where = lm_scoring.Map(1, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    trains = np.ones(len(texts), np.int64)
    tracemalloc.start()
    b = lm_scoring.block_of(texts, trains, where)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 10 * texts.nbytes, most / texts.nbytes
    token, doc = lm_scoring.tokens(textkernel.words(*textkernel.flat(texts), BYTES_FOLDED))
    assert np.array_equal(b.doc, doc) and np.array_equal(b.word[b.pair], token)

    sent = lm_scoring.request(where)(iter([pa.RecordBatch.from_arrays([texts, pa.array(trains), pa.array([0] * len(texts), pa.int32())], ["text", "trains", "block"])]))
    raw = next(x for x in lm_scoring.opened(where)(sent) if x.column("kind")[0].as_py() == lm_scoring.STATE).column("raw")[0].as_py()
    z = lm_scoring.state_from(raw)
    assert len(raw) < 16 * (len(z["words"]) + len(z["x"])), len(raw) / (len(z["words"]) + len(z["x"]))
    n = b.n[b.n > 1]
    assert sorted(z["pn"]) == sorted(n) and len(z["w"]) == len(z["x"]) == len(n) and (np.diff(z["w"]) >= 0).all() and z["n"].sum() == len(token)
    big = {"words": np.arange(3).astype(np.uint64), "w": np.array([0, 0, 2], np.int32), "x": np.arange(5, 8).astype(np.uint64), "pn": np.array([2, 255, 1 << 40]), "sample_t_2": np.array([254, 256, 0])}
    back = lm_scoring.state_from(lm_scoring.state_of(**big))
    assert back.keys() == big.keys() and all(np.array_equal(back[k], big[k]) for k in big)


def test_a_worker_gives_memory_back_when_its_task_has_ended(monkeypatch):
    """Workers that wait kept some 60 MB of their last task each, beside those that work."""
    told = []
    monkeypatch.setattr(lm_scoring, "released", lambda: told.append("released"))

    def run(batches):
        yield from batches
        told.append("end")

    assert list(lm_scoring.lean(run)(iter([1, 2]))) == [1, 2] and told == ["end", "released"]
