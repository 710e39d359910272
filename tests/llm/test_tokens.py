"""BPE and packing against the tokenizers library; windows never exceed the capacity."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

from quire.llm.bpe import Bpe, bpe_round_trip  # noqa: E402
from quire.llm.packing import difference, pack, windows_of  # noqa: E402

ALPHABET = "aaabcde  \n\t\r\x0b\x0c\x1c\x85\xa0  　ÉéÀß'ſİΣσ́ẛ中文𝔸🎉١３'st're'LL!!?<|endoftext|>_-"


def texts(n=600):
    rng = random.Random(3)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["", " ", "a ", " a", "a  b", "a" * 3000, "<|endoftext|>x<|startoftext|> y<|endoftext|>", "ΑΣ ΣΑΣ", "aaaa aaa aa"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_and_texts_equal_the_library(name):
    own, lib = Bpe(P.path(name)), tokenizers.Tokenizer.from_file(P.path(name))
    want = [e.ids for e in lib.encode_batch(texts(), add_special_tokens=False)]
    got = own.encode(texts())
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert [own.decode(x) for x in got] == [lib.decode(x, skip_special_tokens=False) for x in want]
    assert own.encode(texts()[:50]) == got[:50]  # known words


def twins(letters):
    a = "a"
    while len(a) < letters:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("letters", [1024, 4096])
def test_twin_words_have_ids_of_their_own(name, letters):
    own, lib = Bpe(P.path(name)), tokenizers.Tokenizer.from_file(P.path(name))
    both = [f"{t} q" for t in twins(letters)]
    for rows in (both, both[::-1], both[:1], both[1:]):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(rows)] == [e.ids for e in lib.encode_batch(rows, add_special_tokens=False)]


def test_words_of_one_hash_have_ids_of_their_own(monkeypatch):
    from quire.llm import textkernel

    real = textkernel.hashes
    monkeypatch.setattr(textkernel, "hashes", lambda low, start, end: real(low, start, end) % np.uint64(7))
    own, lib = Bpe(P.path("byte_bpe_50k.json")), tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [" ".join(f"word{k}" for k in range(j, j + 9)) for j in range(12)]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(rows)] == [e.ids for e in lib.encode_batch(rows, add_special_tokens=False)]


def test_words_are_forgotten_without_harm(monkeypatch):
    monkeypatch.setattr("quire.llm.bpe.KEPT_WORDS", 5)
    own, lib = Bpe(P.path("byte_bpe_50k.json")), tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for t in texts(60):
        assert np.frombuffer(own.encode([t])[0], "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


def test_round_trip_rows(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "Hello  world", "x"), (None, "w " * 50_000, "x")], "doc_id long, text string, ids string")
    got = bpe_round_trip(rows, P.path("word_bpe_49k.json")).collect()
    assert len(got) == 4 and sorted(r.n_tokens for r in got) == [0, 0, 2, 50_000]
    lib = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in (None, "", "Hello  world", "w " * 50_000)]
    assert sorted(bytes(r.ids) for r in got) == sorted(np.array(x, "<u4").tobytes() for x in want)
    assert sorted(r.decoded for r in got) == sorted(lib.decode(x, skip_special_tokens=False) for x in want)
    assert bpe_round_trip(rows.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_differencing_balances():
    rng = random.Random(1)
    sizes = [rng.randint(1, 256) for _ in range(900)]
    out = difference(sizes, 100)
    assert sorted(k for w in out for k in w) == list(range(900))
    sums = [sum(sizes[k] for k in w) for w in out]
    assert max(sums) - min(sums) < 60
    full = windows_of(sizes, 1024)
    assert all(sum(sizes[k] for k in w) <= 1024 for w in full) and len(full) <= sum(sizes) / 1024 * 1.05 + 2
    assert windows_of([1024, 1024, 1], 1024) and windows_of([5], 1024) == [[0]]


def test_pack_covers_each_id_once(spark):
    lib = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    rows = [(k, rng.choice([None, "", "word " * rng.randint(0, 3000), "é\n" * rng.randint(0, 300)])) for k in range(120)] + [(7, "again")]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), P.path("byte_bpe_50k.json")).collect()
    by_window, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length
        by_window[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for parts in by_window.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    for i, t in rows:
        if i == 7:
            continue
        want = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        parts = sorted(by_doc[i], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in parts) == want and {r.doc_tokens for r in parts} == {len(want) // 4}
        assert zlib.crc32(bytes(parts[0].ids)) == zlib.crc32(want[: 4 * parts[0].length])
    assert pack(spark.createDataFrame([], "doc_id long, text string"), P.path("byte_bpe_50k.json")).count() == 0
