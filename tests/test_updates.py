"""Endings, locks, updates and positioned text on hand-built files."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.sources import content, documents as D, files, locks, structure as S, updates as U


def build(objects, trailer=b"/Root 1 0 R", form="table", gap=b""):
    """A file of (number, body) with a table of references or an object of them."""
    out, at = b"%PDF-1.5\n", {}
    for n, body in objects:
        at[n] = len(out)
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n" + gap
    place, size = len(out), max(at) + 1
    if form == "stream":
        rows = b"".join(b"\x01" + struct.pack(">I", at.get(k, 0)) for k in range(size))
        out += b"%d 0 obj\n<< /Type /XRef /Size %d /W [1 4 0] %s /Length %d >>\nstream\n" % (size, size + 1, trailer, len(rows)) + rows + b"\nendstream\nendobj\n"
    else:
        out += b"xref\n0 %d\n" % size + b"".join(b"%010d 00000 n \n" % at.get(k, 0) for k in range(size)) + b"trailer\n<< /Size %d %s >>\n" % (size, trailer)
    return out + b"startxref\n%d\n%%%%EOF\n" % place


def stream(data, head=b""):
    return b"<< %s /Length %d >>\nstream\n" % (head, len(data)) + data + b"\nendstream"


DECOY = b"trailer\n<< /Root 9 0 R /Encrypt 8 0 R >>\n5 0 obj\n<< /Type /Page >>\nendobj\nstartxref\n3\n%%EOF\n"
BASE = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /XObject << /Im 4 0 R >> >> /MediaBox [10 20 210 420] >>"), (3, b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>"), (4, stream(b"q Q"))]


def table(spark, rows):
    return spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in rows], "f string, content binary")


@pytest.mark.parametrize("form", ["table", "stream"])
def test_words_in_streams_are_no_ending(spark, form):
    data = build([*BASE, (7, stream(DECOY))], form=form)
    late = data[: data.rindex(b"startxref")] + b"startxref\n999999\n%%EOF\n"
    ends = {r.f: r for r in S.parsed(table(spark, [("a", data), ("lost", late), ("none", data[:30]), ("text", b"hello"), ("null", None)]), "f").where("obj IS NULL").select("f", "ending.*").collect()}
    for name in ("a", "lost"):
        assert (ends[name].state, ends[name].root, ends[name].form, ends[name].encrypted) == ("open", 1, form, False)
    assert [ends[x].state for x in ("none", "text", "null")] == ["corrupt", "corrupt", "missing"]
    seen = {r.f: (r.status, r.page_count) for r in D.inspected(table(spark, [("a", data), ("lost", late)]), "f").collect()}
    assert seen == {"a": ("ok", 1), "lost": ("ok", 1)}


def test_earlier_sections_are_followed(spark):
    data = build(BASE)
    place = int(re.search(rb"startxref\n(\d+)", data)[1])
    more = data + b"xref\n0 0\ntrailer\n<< /Size 12 /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (place, len(data))
    r = S.parsed(table(spark, [("a", more)]), "f").where("obj IS NULL").select("ending.*").collect()[0]
    assert (r.root, r.size, r.startxref) == (1, 12, len(data))


@pytest.mark.parametrize("value, want", [
    (b"[1 0 R 2 0 R]", [(1, 0), (2, 0)]), (b"1 0 R 2 3 R", [(1, 0), (2, 3)]), (b"[1 0 R << /A 5 0 R /B [6 0 R] >> 2 0 R]", [(1, 0), (2, 0)]), (b"[(3 0 R) <334052> % 4 0 R\n 5 1 R]", [(5, 1)]),
    (b"[[7 0 R] 8 0 R]", [(8, 0)]), (b"[1 << >> 0 R]", []), (b"[1 2 3 0 R]", [(3, 0)]), (b"[/R 0 R]", []), (b"", []), (b"[((1 0 R) 2 0 R) 9 0 R]", [(9, 0)]),
])
def test_references_pass_over_what_is_nested(spark, value, want):
    assert S.refs_of(value) == want
    got = spark.createDataFrame([(bytearray(value),)], "v binary").select(content.references(F.col("v")).alias("r")).collect()[0].r
    assert [(x.obj, x.gen) for x in got] == want


# ---- locks


def test_ciphers_equal_published_vectors():
    key, plain = bytes(range(16)), bytes.fromhex("00112233445566778899aabbccddeeff")
    for k, want in ((key, "69c4e0d86a7b0430d8cdb78070b4c55a"), (bytes(range(32)), "8ea2b7ca516745bfeafc49904b496089")):
        block = np.frombuffer(plain, np.uint8)[None]
        out = locks.aes_encrypted(locks.round_keys(k), block)
        assert out.tobytes().hex() == want and (locks.aes_decrypted(locks.round_keys(k), out) == block).all()
    assert locks.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3" and locks.rc4(b"Wiki", b"pedia").hex() == "1021bf0420"
    data = bytes(range(256))
    assert locks.cbc_decrypted(key, plain, locks.cbc_encrypted(key, plain, data)) == data


IDENT = bytes(range(16))


def legacy(revision, version, method, password=b""):
    """The key and dictionary of a file locked with a user password, by the published steps."""
    size, owner = (5, 16)[revision > 2], bytes(range(32))
    digest = hashlib.md5((password + locks.FILL)[:32] + owner + struct.pack("<i", -4) + IDENT).digest()
    for _ in range(50 if revision > 2 else 0):
        digest = hashlib.md5(digest[:size]).digest()
    key = digest[:size]
    if revision == 2:
        user = locks.rc4(key, locks.FILL)
    else:
        user = hashlib.md5(locks.FILL + IDENT).digest()
        for turn in range(20):
            user = locks.rc4(bytes(k ^ turn for k in key), user)
        user += bytes(16)
    more = b"/Length %d " % (8 * size) + (b"/StmF /StdCF /CF << /StdCF << /CFM /%s >> >> " % method if version >= 4 else b"")
    return key, b"<< /Filter /Standard /V %d /R %d /P -4 %s/O <%s> /U <%s> >>" % (version, revision, more, owner.hex().encode(), user.hex().encode())


def modern(revision, password=b""):
    digest = locks.hardened if revision == 6 else lambda p, salt: hashlib.sha256(p + salt).digest()
    user = digest(password, b"validate") + b"validate" + b"keysalt!"
    key = bytes(range(7, 39))
    wrapped = locks.cbc_encrypted(digest(password, b"keysalt!"), bytes(16), key)
    return key, b"<< /Filter /Standard /V 5 /R %d /P -4 /StmF /StdCF /CF << /StdCF << /CFM /AESV3 >> >> /O <%s> /U <%s> /UE <%s> >>" % (revision, bytes(48).hex().encode(), user.hex().encode(), wrapped.hex().encode())


def sealed(key, method, data, obj):
    if method == "AESV3":
        own = key
    else:
        own = hashlib.md5(key + struct.pack("<I", obj)[:3] + b"\0\0" + (b"sAlT" if method == "AESV2" else b"")).digest()[: min(16, len(key) + 5)]
    if method == "RC4":
        return locks.rc4(own, data)
    n = 16 - len(data) % 16
    return bytes(16) + locks.cbc_encrypted(own, bytes(16), data + bytes([n]) * n)


LOCKED = [(2, 1, b"", "RC4"), (3, 2, b"", "RC4"), (4, 4, b"V2", "RC4"), (4, 4, b"AESV2", "AESV2"), (5, 5, b"", "AESV3"), (6, 5, b"", "AESV3")]


@pytest.mark.parametrize("revision, version, name, method", LOCKED)
def test_files_open_without_a_password(spark, revision, version, name, method):
    rows = []
    for which, password in (("empty", b""), ("word", b"secret")):
        key, lock = modern(revision, password) if revision >= 5 else legacy(revision, version, name, password)
        inner = b"1 0 2 34 3 68 "
        inner += b"<< /Type /Catalog /Pages 2 0 R >> ".ljust(34) + b"<< /Type /Pages /Kids [3 0 R] >>  ".ljust(34) + b"<< /Type /Page /Parent 2 0 R /Contents 6 0 R >>"
        packed, shown = sealed(key, method, zlib.compress(inner), 4), sealed(key, method, b"BT (x) Tj ET", 6)
        parts = [(4, stream(packed, b"/Type /ObjStm /N 3 /First 14 /Filter /FlateDecode")), (5, lock), (6, stream(shown))]
        rows.append((which, build(parts, b"/Root 1 0 R /Encrypt 5 0 R /ID [<%s> <00>]" % IDENT.hex().encode(), "stream")))
    got = {r.f: (r.status, r.page_count, r.has_text) for r in D.inspected(table(spark, rows), "f").collect()}
    assert got == {"empty": ("ok", 1, True), "word": ("encrypted", None, None)}


def test_an_unknown_or_missing_lock_stays_locked(spark):
    other = build([*BASE, (5, b"<< /Filter /Custom /V 1 /R 2 >>")], b"/Root 1 0 R /Encrypt 5 0 R")
    gone = build(BASE, b"/Root 1 0 R /Encrypt 50 0 R")
    assert {r.status for r in D.inspected(table(spark, [("a", other), ("b", gone)]), "f").collect()} == {"encrypted"}


# ---- updates


def layered(spark, rows, text):
    source = table(spark, rows)
    marks = spark.createDataFrame([(f, p, k, t, 0.1, 0.2, 0.5, 0.05) for f, p, k, t in text], "f string, page long, run int, text string, x double, y double, w double, h double")
    out = source.join(U.text_sections(source, marks, "f"), "f").withColumn("after", files.incremental(F.col("content"), F.col("section")))
    return {r.f: r for r in out.collect()}


def entries_right(before, after):
    """Every offset of the new table of references points at its object."""
    place = int(re.findall(rb"startxref\s+(\d+)", after)[-1])
    part = after[place:]
    if part.startswith(b"xref"):
        n = None
        for line in part.split(b"trailer")[0].split(b"\n")[1:-1]:
            f = line.split()
            if len(f) == 2:
                n = int(f[0])
            else:
                assert after[int(f[0]) :].startswith(b"%d %d obj" % (n, int(f[1])))
                n += 1
        return "table"
    head = S.values(after, part.index(b"<<") + place)
    index, wide = [int(x) for x in head["Index"].strip(b"[] ").split()], int(head["W"].split()[2])
    data = part[part.index(b"stream\n") + 7 :]
    for first, n in zip(index[::2], index[1::2]):
        for obj in range(first, first + n):
            row, data = data[: 3 + wide], data[3 + wide :]
            assert row[0] == 1 and after[int.from_bytes(row[1 : 1 + wide], "big") :].startswith(b"%d %d obj" % (obj, int.from_bytes(row[1 + wide :], "big")))
    return "stream"


SHARED = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R 6 0 R] /Count 2 /Resources 8 0 R >>"), (3, b"<< /Type /Page /Parent 2 0 R /Contents [4 0 R 5 0 R] >>"), (4, stream(b"q")), (5, stream(b"Q")),
          (6, b"<< /Type /Page /Parent 2 0 R /Rotate 90 >>"), (8, b"<< /Font 9 0 R /XObject << >> >>"), (9, b"<< /F1 10 0 R >>"), (10, b"<< /Type /Font >>")]


@pytest.mark.parametrize("form", ["table", "stream"])
def test_text_is_put_behind_the_old_bytes(spark, form):
    rows = [("inherited", build(BASE, form=form)), ("shared", build(SHARED, form=form)), ("own", build([*BASE[:2], (3, b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 9 0 R >> >> >>"), BASE[3]], form=form)), ("bare", build(BASE, form=form))]
    text = [("inherited", 0, 1, "b(c)"), ("inherited", 0, 0, "a"), ("shared", 0, 0, "one"), ("shared", 1, 0, "two"), ("own", 0, 0, "ω and é"), ("bare", 0, 0, "")]
    got = layered(spark, rows, text)
    assert {f: r.status for f, r in got.items()} == {"inherited": "ok", "shared": "ok", "own": "ok", "bare": "unchanged"}
    for f, data in rows:
        after = bytes(got[f].after)
        assert after.startswith(data) and (f == "bare" or entries_right(data, after) == form)
    made = table(spark, [(f, bytes(r.after)) for f, r in got.items()])
    told = S.parsed(made, "f").cache()
    heads = {(r.f, r.obj): bytes(r.head) for r in told.where("obj IS NOT NULL").collect()}
    page = S.values(heads["inherited", 3])
    assert S.refs_of(page["Contents"])[0] == (4, 0) and len(S.refs_of(page["Contents"])) == 2
    assert b"/XObject << /Im 4 0 R >>" in page["Resources"] and U.FONT.encode() in page["Resources"]
    assert b"Resources" not in heads["shared", 3] and heads["shared", 8] == SHARED[6][1] and U.FONT.encode() in heads["shared", 9] and b"/F1 10 0 R" in heads["shared", 9]
    assert len(S.refs_of(S.values(heads["shared", 3])["Contents"])) == 3 and len(S.refs_of(S.values(heads["shared", 6])["Contents"])) == 1
    own = S.values(S.values(heads["own", 3])["Resources"])["Font"]
    assert b"/F1 9 0 R" in own and U.FONT.encode() in own
    runs = {}
    for r in U.file_runs(made, "f").collect():
        runs.setdefault((r.f, r.page), []).append((r.run, r.text, r.visible, round(r.x, 2), round(r.y, 2), round(r.w, 2), round(r.h, 2)))
    assert sorted(runs["inherited", 0]) == [(0, "a", False, 0.1, 0.2, 0.5, 0.05), (1, "b(c)", False, 0.1, 0.2, 0.5, 0.05)]
    assert [x[1] for x in runs["own", 0]] == ["? and é"] and [x[1] for x in runs["shared", 0]] == ["one"]
    # the second shared page is shown turned: the run goes up the page's own left side
    (_, word, _, x, y, w, h), = runs["shared", 1]
    assert word == "two" and (x, y) == (round(1 - 0.2 - 0.05, 2), 0.1) and (w, h) == (0.05, 0.5)


def test_what_cannot_be_updated(spark):
    odd = [("page", build(BASE)), ("contents", build([*BASE[:2], (3, b"<< /Type /Page /Parent 2 0 R /Contents 99 0 R >>"), BASE[3]])), ("direct", build([*BASE[:2], (3, b"<< /Type /Page /Parent 2 0 R /Contents (x) >>"), BASE[3]])),
           ("font", build([*BASE[:2], (3, b"<< /Type /Page /Parent 2 0 R /Resources << /Font 70 0 R >> >>"), BASE[3]])), ("cut", build(BASE)[:60]), ("fine", build(BASE)), ("size", build(BASE, b"/Root 1 0 R /Size 50"))]
    got = layered(spark, odd, [(f, 5 if f == "page" else 0, 0, "t") for f, _ in odd])
    assert {f: r.status for f, r in got.items()} == {"page": "unsupported", "contents": "unsupported", "direct": "unsupported", "font": "unsupported", "cut": "corrupt", "fine": "ok", "size": "ok"}
    assert got["page"].section is None and bytes(got["page"].after) == odd[0][1]
    assert b"\n5 0 obj\n<< /Type /Font" in bytes(got["fine"].section)


def test_no_files_give_no_sections(spark):
    assert layered(spark, [], []) == {}


# ---- positioned text


def brute(ops):
    """Runs of operators by 3 x 3 matrices."""
    m = lambda a, b, c, d, e, f: np.array([[a, b, 0], [c, d, 0], [e, f, 1.0]])
    ctm, stack, text, line, size, scale, char, word, lead, rise, out = np.eye(3), [], np.eye(3), np.eye(3), 0, 1, 0, 0, 0, 0, []
    for op, *n in ops:
        if op == "q":
            stack.append((ctm, size, scale, char, word, lead, rise))
        elif op == "Q" and stack:
            ctm, size, scale, char, word, lead, rise = stack.pop()
        elif op == "cm":
            ctm = m(*n) @ ctm
        elif op == "Tm":
            text = line = m(*n)
        elif op == "BT":
            text = line = np.eye(3)
        elif op in ("Td", "TD", "T*"):
            lead = -n[1] if op == "TD" else lead
            line = m(1, 0, 0, 1, *(n if n else (0, -lead))) @ line
            text = line
        elif op == "Tf":
            size = n[0]
        elif op == "Tz":
            scale = n[0] / 100
        elif op == "Tc":
            char = n[0]
        elif op == "Tw":
            word = n[0]
        elif op == "TL":
            lead = n[0]
        elif op == "Ts":
            rise = n[0]
        elif op == "Tj":
            wide = sum((0.5 * size + char + (word if c == " " else 0)) * scale for c in n[0])
            end = m(1, 0, 0, 1, wide, 0) @ text
            corners = np.array([np.array([0, y, 1]) @ t @ ctm for t in (text, end) for y in (rise, rise + size)])
            out.append((n[0], *corners[:, :2].min(0), *corners[:, :2].max(0)))
            text = end
    return out


def written(ops):
    lines = []
    for op, *n in ops:
        lines.append(" ".join([*(f"({x})" if isinstance(x, str) else f"{x}" if op != "Tf" else f"/F {x}" for x in n), op]))
    return "\n".join(lines).encode("latin-1")


@pytest.mark.parametrize("seed", range(5))
def test_boxes_equal_matrix_products(seed):
    rng, number = random.Random(seed), lambda: round(rng.uniform(-3, 3), 2)
    ops = []
    for _ in range(300):
        op = rng.choice(["q", "Q", "cm", "Tm", "BT", "Td", "TD", "T*", "Tf", "Tz", "Tc", "Tw", "TL", "Ts", "Tj", "Tj", "Tj"])
        n = {"cm": 6, "Tm": 6, "Td": 2, "TD": 2, "Tf": 1, "Tz": 1, "Tc": 1, "Tw": 1, "TL": 1, "Ts": 1}.get(op, 0)
        ops.append((op, rng.choice(["ab c", "é", " "])) if op == "Tj" else (op, *(number() if op != "Tz" else 90.0 + number() for _ in range(n))))
    got, want = content.shown(written(ops)), brute(ops)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1:5] for g in got], [w[1:] for w in want], rtol=1e-9, atol=1e-6)


def test_operators_of_text():
    show = lambda data, widths=None: [(r[0], *(round(x, 6) for x in r[1:5]), r[5]) for r in content.shown(data, widths)]
    assert show(b"BT /F 10 Tf [(A\\(b) -500 <4344>] TJ ET") == [("A(bCD", 0, 0, 30, 10, True)]
    assert show(b"BT /F 10 Tf 3 Tr 12 TL (a) ' (b) Tj 1 2 (c) \" ET") == [("a", 0, -12, 5, -2, False), ("b", 5, -12, 10, -2, False), ("c", 0, -24, 7, -14, False)]
    assert show(b"BI /W 1 ID (x) Tj \x00\xff EI BT /F 4 Tf (y) Tj ET % (z) Tj")[0][0] == "y"
    assert show(b"BT /F 10 Tf (AB) Tj ET", {"F": (65, [0.25, 1.0])}) == [("AB", 0, 0, 12.5, 10, True)]
    assert show(b"") == [] and show(b"(a Tj") == [] and show(b"Q Q cm Tm Tf Tj TJ ' \"") == []


def test_fonts_of_pages_have_widths_and_lines_are_joined(spark):
    parts = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R] /MediaBox [0 0 100 200] >>"), (3, b"<< /Type /Page /Parent 2 0 R /Contents 7 0 R /Resources 4 0 R >>"), (4, b"<< /Font << /F1 5 0 R >> >>"),
             (5, b"<< /Type /Font /FirstChar 65 /Widths 6 0 R >>"), (6, b"[1000 250]"), (7, b"[8 0 R 9 0 R]"), (8, stream(b"BT /F1 10 Tf 10 100 Td (A) Tj (B) Tj ET")), (9, stream(zlib.compress(b"BT /F1 10 Tf 50 100 Td (A) Tj 0 -20 Td (low) Tj ET"), b"/Filter /FlateDecode"))]
    runs = U.file_runs(table(spark, [("a", build(parts))]), "f")
    assert [(r.text, round(r.x, 4), round(r.w, 4)) for r in runs.orderBy("run").collect()] == [("A", 0.1, 0.1), ("B", 0.2, 0.025), ("A", 0.5, 0.1), ("low", 0.5, 0.15)]
    assert [(r.line, r.text, round(r.x, 3), round(r.w, 3)) for r in content.text_lines(runs, "f").orderBy("line").collect()] == [(0, "AB A", 0.1, 0.5), (1, "low", 0.5, 0.15)]


def test_joins_of_staged_rows_are_no_broadcasts(spark):
    """Staged rows of like files take so little of the disk that any number of them would be broadcast."""
    page = b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R /Resources << /Font << /F1 4 0 R >> >> >>"
    data = build([(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>"), (3, page), (4, b"<< /Type /Font >>"), (5, stream(b"BT (x) Tj ET"))])
    plan = U.file_runs(table(spark, [("a", data), ("b", data)]), "f")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_the_object_of_a_reference_takes_no_python(spark):
    """With all cores at work each Python step of a stage has a process for every core."""
    raw = [b"12 0 R", b" 3\t4\n R ", b"1234567890 99999 R", b"12345678901 0 R", b"1 0 R 2 0 R", b"[1 0 R]", b"<< /A 1 0 R >>", b"1 R", b"1 0 r", b"\xe9 1 0 R", b"1\x0b0\x0cR", b"1\x850 R", b"", None]
    told = table(spark, [(str(k), v) for k, v in enumerate(raw)]).select(F.col("f").cast("int").alias("k"), content.reference(F.col("content")).alias("obj"))
    assert "EvalPython" not in told._jdf.queryExecution().executedPlan().toString()
    assert [r.obj for r in told.orderBy("k").collect()] == [(S.ref_of(v) or (None,))[0] for v in raw]
