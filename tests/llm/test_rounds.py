"""Conversation repair, vector codes and chat formatting against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import turn_repair
from quire.llm.chat_format import format_conversations, format_turns, parse, under_mask
from quire.llm.turn_repair import damaged, repair
from quire.llm.vector_codes import DECODED, Part, book_digest, compress, encoded, label_errors

BLANKS = " \t\n\x0b\x0c\r"
ROWS = "conv_id long, turn long, role string, text string, audit string, G string, cost int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "mine", "mine", 1) for r in rows], ROWS)


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(BLANKS)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def all_edits(rows):
    """The cheapest and ASCII-least edits by trying all."""
    found, best = faults(rows), [4 * len(rows), "D" * len(rows), ""]

    def go(at, cost, audit, roles, lines):
        if cost > best[0]:
            return
        if at == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles) and (cost, audit) < tuple(best[:2]):
            best[:] = [cost, audit, "\n".join(lines)]
        for role in ("user", "assistant"):
            go(at, cost + 3, audit + "I", roles + role[0], [*lines, f"{role}:"])
        if at < len(rows):
            role, text = rows[at]
            go(at + 1, cost + 4, audit + "D", roles, lines)
            if found[at] not in ("blank", "duplicate"):
                late = 3 * (found[at] == "truncated")
                go(at + 1, cost + late, audit + "K", roles + (role[:1] or "-"), [*lines, f"{role}:{text}"])
                for new in ("user", "assistant"):
                    go(at + 1, cost + 3 + late, audit + "R", roles + new[0], [*lines, f"{new}:{text}"])

    go(0, 0, "", "", [])
    return best


def forwards(rows):
    """The same by the cheapest and ASCII-least edits to each state so far."""
    found, step = faults(rows), {0: ("su", 2, "user"), 1: ("u", 2, "user"), 2: ("a", 3, "assistant"), 3: ("u", 2, "user")}
    best = {0: (0, "", ())}

    def better(table, state, value):
        if state not in table or value[:2] < table[state][:2]:
            table[state] = value

    def filled(table):
        for _ in range(3):
            for state, (cost, audit, lines) in list(table.items()):
                better(table, step[state][1], (cost + 3, audit + "I", (*lines, f"{step[state][2]}:")))
        return table

    for (role, text), fault in zip(rows, found):
        new = {}
        for state, (cost, audit, lines) in filled(best).items():
            better(new, state, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            late = 3 * (fault == "truncated")
            if role[:1] and role[0] in step[state][0]:
                better(new, {"s": 1, "u": 2, "a": 3}[role[0]], (cost + late, audit + "K", (*lines, f"{role}:{text}")))
            better(new, step[state][1], (cost + 3 + late, audit + "R", (*lines, f"{step[state][2]}:{text}")))
        best = new
    filled(best)
    cost, audit, lines = min(best[s] for s in (0, 3) if s in best)
    return [cost, audit, "\n".join(lines)]


def wanted(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role if role is not None else " ", text if text is not None else " "))
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (*r[:3], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
        turns, turns_of = [r[1] for r in own if r[0]], [(r[2], r[3]) for r in own]
        found, (cost, audit, text) = faults(turns_of), forwards(turns_of)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(turns_of, turns_of[1:])]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(found.count(x) for x in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


ROLES = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "server"]
TEXTS = ["Yes.", "No!", "cut", "cut", "", " \n\t", None, "é?\n", "Yes.", "\x0b. "]


def talk(rng, n):
    return [(rng.choice(ROLES), rng.choice([*TEXTS, f"{k}."])) for k in range(n)]


def test_forward_program_equals_all_edits():
    rng = random.Random(5)
    for _ in range(150):
        rows = [(r or " ", t or " ") for r, t in talk(rng, rng.randint(0, 3))]
        assert forwards(rows) == all_edits(rows)


@pytest.mark.parametrize("batch, limit", [(10_000, 16_384), (7, 5)])
def test_repair_equals_brute_force(spark, monkeypatch, batch, limit):
    """With small buffers nearly all conversations are cut into fragments."""
    rng = random.Random(batch)
    rows = [(conv, rng.choice([k, k, k, 3, None]), r, t) for conv in [*range(60), None] for k, (r, t) in enumerate(talk(rng, rng.randint(1, 9)))]
    rows += [(700, k, r, t) for k, (r, t) in enumerate(talk(rng, 300))]  # more than half of all rows
    rows += [(701, 1, "user", "Same.")] * 50 + [(702, 0, "user", "x" * 300_000), (702, 1, "assistant", "y" * 300_000 + ".")]
    rng.shuffle(rows)
    monkeypatch.setattr(turn_repair, "ROWS", limit)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = repair(table(spark, rows).repartition(3)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = wanted(rows)
    assert len(got) == len(want)
    for r in got:
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == want[r.conv_id], r.conv_id
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in r.turns).encode()).hexdigest() == r.repaired_sha256


def test_a_hot_conversation_is_spread_over_tasks(spark):
    rows = spark.range(90_000).select(F.when(F.col("id") % 3 > 0, 5).otherwise(F.col("id")).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.col("id").cast("string"), F.lit(".")).alias("text"))
    out = repair(rows.repartition(6), keep_texts=False)
    hot = out.where("conv_id = 5").collect()[0]
    n = 60_000
    assert len(hot.audit.replace("I", "")) == n and hot.turns is None and hot.cost == hot.audit.count("I") * 3 + hot.audit.count("R") * 3 + hot.audit.count("D") * 4
    assert out.count() == 30_001


def test_damage(spark):
    rows = [(k, t, "assistant", "A. b! c? d") for k in [*range(40), None] for t in (0, 1, None)]
    got = defaultdict(list)
    for r in damaged(table(spark, rows)).collect():
        got[r.conv_id, r.turn].append((r.role, r.text, r.gone))
    for k, t, role, text in rows:
        code = zlib.crc32(f"{' ' if k is None else k}:{' ' if t is None else t}".encode()) % 20
        one = ("user" if code == 4 else role, {1: "", 2: "A b c d"}.get(code, text), code == 0)
        assert got[k, t] == [one] * (2 if code == 3 else 1)


def test_repair_of_nothing_and_of_dropped_rows(spark):
    assert repair(table(spark, [])).count() == 0
    gone = table(spark, [(1, 0, "user", "x."), (1, 1, "user", "y."), (2, 0, "user", "x.")]).withColumn("gone", F.col("conv_id") == 1)
    got = {r.conv_id: r for r in repair(gone, gone_col="gone").collect()}
    assert (got[1].cost, got[1].audit, got[1].gaps, got[1].repaired_sha256) == (0, "", 0, hashlib.sha256(b"").hexdigest())
    assert (got[2].cost, got[2].audit) == (3, "KI")


# ---- vector codes


def lloyd(x, parts, entries, rounds):
    n, dim = x.shape
    width = max(1, -(-dim // parts))
    full = np.zeros((n, parts * width), np.int64)
    full[:, :dim] = x
    v = full.reshape(n, parts, width)
    book = v[:entries].transpose(1, 0, 2).copy()
    for k in range(rounds + 1):
        d = ((v[:, :, None, :] - book[None]) ** 2).sum(3)
        code = d.argmin(2)
        if k < rounds:
            for p in range(parts):
                for e in range(book.shape[1]):
                    own = v[code[:, p] == e, p]
                    if len(own):
                        book[p, e] = own.sum(0) // len(own)
    return code, d.min(2).sum(1), book


def test_lower_bounds_never_rise_by_coding():
    b = np.r_[0.0, 0.5, 1.0, 1.0000001, 2.0, np.geomspace(1, 1e9, 5000)]
    low = DECODED[encoded(b)]
    assert (low <= b).all() and (low[b > 2][: 4000] > 0.95 * b[b > 2][: 4000])[b[b > 2][:4000] < 2**15].all()


@pytest.mark.parametrize("spread", [3, 40, 5000])
def test_pruned_assignments_equal_all_distances(spread):
    rng = np.random.default_rng(spread)
    x, old = rng.integers(-spread, spread, (2000, 4)), rng.integers(-spread, spread, (32, 4))
    new = old + rng.integers(-2, 3, old.shape)
    code, upper, lower = Part(old, None).first(x)
    part = Part(new, old)
    got, up, low = part.again(x, code, upper, DECODED[encoded(lower)])
    d = ((x[:, None] - new[None]) ** 2).sum(2)
    assert (got == d.argmin(1)).all()
    assert (up >= np.sqrt(d.min(1))).all() and (low <= np.sqrt(d) * (1 + 1e-7)).all()


@pytest.mark.parametrize("dim, entries", [(32, 16), (20, 64), (1, 4), (0, 4)])
def test_codes_equal_plain_rounds(spark, dim, entries):
    rng = np.random.default_rng(dim)
    grid = rng.integers(-6, 7, (300, dim)) / 16  # many ties
    rows = [(k * 3, [float(y) for y in v], int(k % 4) if k % 5 else None) for k, v in enumerate(grid)]
    rows += [(1000 + k, rows[7][1], 2) for k in range(200)]  # a hot vector and label
    bad = [(-1, None, 1), (-2, [None] * dim, 1), (-3, [float("nan")] * dim, 1), (-4, [float("inf")] * dim, 1)] + ([(5000, [0.5] * (dim + 1), 1)])
    bad = bad if dim else [bad[0], bad[-1]]
    frame = spark.createDataFrame([(*r, "mine", 1.5) for r in [*rows[::-1], *bad]], "vec_id long, embedding array<float>, label int, code string, X double")
    out, book = compress(frame, entries=entries, rounds=3)
    code, error, want = lloyd(np.floor(np.array([r[1] for r in rows]).reshape(len(rows), dim) * 256).astype(np.int64), 16, entries, 3)
    assert (book == want).all() and book_digest(book) == hashlib.sha256(",".join(map(str, want.ravel())).encode()).hexdigest()
    got = {r.id: r for r in out.collect()}
    assert len(got) == len(rows)
    for k, r in enumerate(rows):
        assert (list(got[r[0]].code), got[r[0]].error, got[r[0]].label) == (code[k].tolist(), error[k], r[2])
    sums = {r.label: r.label_error for r in label_errors(out).collect()}
    assert sums == {x: sum(int(e) for e, r in zip(error, rows) if r[2] == x) for x in {r[2] for r in rows}}


def test_codes_of_few_large_and_no_vectors(spark):
    schema = "vec_id long, embedding array<double>, label int"
    out, book = compress(spark.createDataFrame([], schema))
    assert out.count() == 0 and book.size == 0
    out, book = compress(spark.createDataFrame([(None, [1e300] * 16, None), (4, [-1e300] * 16, None)], schema))
    assert {r.id: r.error for r in out.collect()} == {None: 0, 4: 0} and book.shape == (16, 2, 1)
    out, _ = compress(spark.createDataFrame([(1, [1.0] * 16, 1)] * 5, schema), entries=2)
    assert [r.error for r in out.collect()] == [0] * 5


# ---- chat format

CONTROL = ["<s>[INST]", "[/INST]", "<s>[", "</s>", "[/SYS]", "<s>", "<", "[", "\\", "<\\", "[\\", "\\\\", "]", "a", "é\n", " ", "$1", "[/ROLE]", "<s>[ROLE]"]


def chats(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(CONTROL) for _ in range(rng.randint(0, 4)))
    rows = [(rng.choice([k // 5, k // 5, None]), rng.choice([k, 1, None]), rng.choice(["user", "assistant", "system", "assistant", None, "", word()]), rng.choice([word(), word(), None])) for k in range(n)]
    return rows + [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (900, 1, "assistant", "z<s>" * 50_000), (901, 0, "user", "same")] + [(901, 0, "user", "same")] * 30


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_formatted_conversations_read_back(spark, seed):
    rows = chats(seed)
    frame = spark.createDataFrame([(*r, "mine", "mine") for r in rows], "conv_id long, turn long, role string, text string, formatted string, Segment string")
    out = format_conversations(frame).withColumn("read", parse(F.col("formatted"))).withColumn("loss", under_mask(F.col("formatted"), F.col("marks")))
    want = defaultdict(list)
    for conv, turn, role, text in rows:
        want[conv].append((turn is not None, turn or 0, role or "", text or ""))
    got = out.collect()
    assert len(got) == len(want)
    for r in got:
        own = [x[2:] for x in sorted(want[r.conv_id])]
        assert [(t.role, t.text) for t in r.read] == own
        assert r.loss == "".join(t for role, t in own if role == "assistant")
        assert [m.offset for m in r.marks] == [m.start() for m in re.finditer(r"<s>\[", r.formatted)]
        assert all(r.formatted[m.start + m.length :].startswith("</s>") for m in r.marks if m.length)


def test_plain_texts_are_not_escaped_and_odd_ones_are(spark):
    rows = [(1, 0, "user", "a < b is [1]"), (2, 0, "user", "fine"), (3, 0, "user", "<s>"), (4, 0, "user", "a<\\b")]
    got = {r.conv: r.segment for r in format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1] == "<s>[INST]a < b is [1][/INST]" and got[2] == "<s>[INST]fine[/INST]"
    assert got[3] == "<s>[INST]<\\s>[/INST]"  # the mark after it would begin a turn
    assert got[4] == "<s>[INST]a<\\\\\\b[/INST]"


def test_what_is_no_conversation_does_not_parse(spark):
    bad = ["x<s>[INST]a[/INST]", "<s>[INST]a[/INST]x", "<s>[INST]a", "<s>[WHAT]a</s>", "<s>[ROLE]a</s>"]
    got = spark.createDataFrame([(x,) for x in bad], "s string").select(parse(F.col("s")).alias("p")).collect()
    assert [r.p is None or r.p == [None] for r in got] == [True] * len(bad)
    assert spark.sql("SELECT '' AS s").select(parse(F.col("s")).alias("p")).collect()[0].p == []


def test_formatting_runs_no_python_and_takes_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = format_conversations(empty)
    assert out.count() == 0 and "Python" not in out._jdf.queryExecution().toString()
