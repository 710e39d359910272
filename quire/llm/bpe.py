"""BPE encoding and decoding with the vocabulary file of a public tokenizer.

The distinct new words of a chunk are merged together: their symbols lie in one flat array, each
round looks the adjacent pairs up in the sorted pair keys, and merges in every word its pairs of
lowest rank.  Words that a worker has met are kept in bounded arrays, found by 64-bit hash and compared.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quire.llm.textkernel import BLANK, PAD, SPACE_ONLY, equal_bytes, flat, spans, words

# Fixed values of the byte-level pre-tokenizer: its pattern, and the bytes that stand for themselves.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

KEPT_WORDS, KEPT_BYTES = 1_000_000, 1 << 25
_SHIFT = 32
_NONE = np.iinfo(np.int64).max


def byte_names() -> list[str]:
    """The character that stands for each byte in the vocabulary: printable ones as they are, the rest from 256 on."""
    spare = iter(range(256, 512))
    return [chr(b) if b in PRINTABLE else chr(next(spare)) for b in range(256)]


class Bpe:
    """A vocabulary with its merges.  encode() gives ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        names = byte_names()
        self.inner = np.array([vocab.get(c, -1) for c in names], np.int64)
        self.final = np.array([vocab.get(c + suffix, -1) for c in names], np.int64)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
        key = np.array([a << _SHIFT | b for a, b, _ in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.merged = key[order], order, np.array([c for *_, c in pairs], np.int64)[order]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        kinds = {x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])}
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        own = next((s["pattern"]["Regex"] for s in steps if s["type"] == "Split"), BYTE_LEVEL)
        self.find = regex.compile(own.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"(?!\S)", r"(?!\P{White_Space})")).findall
        self.names = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = token
        self.bytes_out = {c: b for b, c in enumerate(names)} if (spec["decoder"] or {}).get("type") == "ByteLevel" else None
        self.byte_level = self.bytes_out is not None
        self.space = b" " if self.byte_level else b""
        self._forget()

    def _forget(self) -> None:
        """Known units: sorted hashes with each one's number; by number the ids of the units and their bytes."""
        self.hash, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.ids = np.zeros(1, np.int64), np.zeros(0, "<u4")
        self.ends, self.bytes = np.zeros(1, np.int64), np.zeros(PAD, np.uint8)

    def normal(self, text: str) -> str:
        if not text.isascii():
            if self.nfc:
                text = unicodedata.normalize("NFC", text)
            if self.lower:
                text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()  # no final sigma
        elif self.lower:
            text = text.lower()
        return text

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and where each piece's ids begin (with the end)."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(sizes)
        symbol = self.inner[raw]
        symbol[ends - 1] = self.final[raw[ends - 1]]
        word = np.repeat(np.arange(len(pieces)), sizes)
        known = symbol >= 0  # a vocabulary without all bytes has no id for some
        symbol, word = symbol[known], word[known]
        done_symbols, done_words = [], []
        at = np.full(len(symbol), -1)  # each symbol's pair with the next one, in keys
        rank = np.full(len(symbol), _NONE)
        look = np.arange(len(symbol))  # pairs to look up: at first all, then those beside a merge
        while len(symbol):
            look = look[look < len(symbol) - 1]
            look = look[word[look] == word[look + 1]]
            key = symbol[look] << _SHIFT | symbol[look + 1]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[found] == key
            at[look], rank[look] = found, np.where(hit, self.ranks[found], _NONE)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(symbol)]))
            stay = lowest != _NONE
            if not stay.all():
                done_symbols.append(symbol[~stay])
                done_words.append(word[~stay])
                if not stay.any():
                    break
            left = (rank == lowest) & stay
            spot = np.flatnonzero(left)
            if (spot[1:] == spot[:-1] + 1).any():  # of a, a, a only the first two merge
                run = np.arange(len(left)) - np.maximum.accumulate(np.where(left, -1, np.arange(len(left))))
                spot = np.flatnonzero(left & (run % 2 == 1))
            symbol[spot] = self.merged[at[spot]]
            fresh = np.zeros(len(symbol), bool)
            fresh[spot] = True
            stay[spot + 1] = False
            symbol, word, at, rank, fresh = symbol[stay], word[stay], at[stay], rank[stay], fresh[stay]
            fresh[:-1] |= fresh[1:]
            look = np.flatnonzero(fresh)
            rank[look] = _NONE
        if not done_symbols:
            return np.zeros(0, np.int64), np.zeros(len(pieces) + 1, np.int64)
        symbol, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbol[order], np.searchsorted(word[order], np.arange(len(pieces) + 1))

    def whole(self, text: str) -> bytes:
        """Ids of a text taken as one, with the special tokens that it spells out."""
        out = []
        cut = self.split_special.split(text) if self.split_special else [text]
        for k, part in enumerate(cut):
            if k % 2:
                out.append(np.array([self.special[part]]))
            elif part and (pieces := self.find(self.normal(part))):
                out.append(self.merge([p.encode() for p in pieces])[0])
        return np.concatenate(out).astype("<u4").tobytes() if out else b""

    def _learn(self, units: list[bytes], inner: list[bool]) -> None:
        """Adds the ids of new units; inner ones follow a space, which a byte-level piece takes along."""
        pieces: list[bytes] = []
        ends = [0]
        for raw, follows in zip(units, inner):
            space = self.space if follows else b""
            text = raw.decode()
            if text.isalpha():
                pieces.append(space + raw)
            else:
                pieces += [p.encode() for p in self.find(space.decode() + text)]
            ends.append(len(pieces))
        ids, at = self.merge(pieces) if pieces else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        self.at = np.r_[self.at, self.at[-1] + at[ends][1:]]
        self.ids = np.r_[self.ids, ids.astype("<u4")]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text.  What lies between spaces is split and encoded once: no piece reaches over
        a lone space, but that a byte-level piece takes it along.  Texts with more than lone spaces
        between words, and those that may spell special tokens, are taken whole."""
        apart = {k for k, t in enumerate(texts) if "<|" in t or (self.byte_level and ("  " in t or t.endswith(" ")))}
        raw = [b"" if k in apart else self.normal(t).encode() for k, t in enumerate(texts)]
        w = words(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64), blank=SPACE_ONLY if self.byte_level else BLANK)
        head = (w.start == w.offsets[w.doc]) if self.byte_level else np.zeros(len(w.start), bool)
        digest, pick, unit = np.unique(np.where(head, ~w.hash, w.hash), return_index=True, return_inverse=True)
        if len(self.hash) > KEPT_WORDS or len(self.bytes) > KEPT_BYTES:
            self._forget()
        spot = np.searchsorted(self.hash, digest)
        new = np.ones(len(digest), bool)
        new[spot < len(self.hash)] = self.hash[spot[spot < len(self.hash)]] != digest[spot < len(self.hash)]
        number = np.empty(len(digest), np.int64)
        number[~new] = self.number[spot[~new]]
        if new.any():
            fresh = pick[new]
            data = w.low.tobytes()
            units = [data[a:b] for a, b in zip(w.start[fresh].tolist(), w.end[fresh].tolist())]
            number[new] = np.arange(len(self.at) - 1, len(self.at) - 1 + len(fresh))
            self._learn(units, (~head[fresh]).tolist())
            self.ends = np.r_[self.ends, self.ends[-1] + np.cumsum(w.end[fresh] - w.start[fresh])]
            self.bytes = np.r_[self.bytes[:-PAD], np.frombuffer(b"".join([*units, bytes(PAD)]), np.uint8)]
            keys, numbers = np.r_[self.hash, digest[new]], np.r_[self.number, number[new]]
            order = np.argsort(keys, kind="stable")
            self.hash, self.number = keys[order], numbers[order]
        number = number[unit]
        same = equal_bytes(w.low, w.start, w.end, self.bytes, self.ends[number], self.ends[number + 1])
        apart.update(w.doc[~same].tolist())  # another unit has the hash
        begin, size = self.at[number], self.at[number + 1] - self.at[number]
        to = np.r_[0, np.cumsum(size)]
        out = self.ids[np.repeat(begin - to[:-1], size) + np.arange(to[-1])].tobytes()
        cut = (to[w.first()] * 4).tolist()
        return [self.whole(texts[k]) if k in apart else out[a:b] for k, (a, b) in enumerate(zip(cut, cut[1:]))]

    def decode(self, ids: bytes) -> str:
        """The text of ids: names joined by spaces, or bytes put together where the file names a byte-level decoder."""
        tokens = map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist())
        if self.bytes_out is None:
            return " ".join(tokens)
        return bytes(map(self.bytes_out.__getitem__, "".join(tokens))).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """The vocabulary of a file, read once by each worker."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def text_slices(batch: pa.RecordBatch, column: str, most: int = 1 << 21) -> Iterator[tuple[int, int, list[str]]]:
    """(from, to, texts) for ranges of a batch's rows of about `most` bytes, two megabytes if not told; null counts as empty."""
    texts = batch.column(column)
    for a, b in spans(flat(texts)[1], most):
        yield a, b, ["" if t is None else t for t in texts.slice(a, b - a).to_pylist()]


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, n_tokens, ids (binary, little-endian unsigned 32-bit) and decoded.

    The ids are those of the tokenizer's file without added special tokens; special tokens that the
    text spells out are encoded as such.  A null or empty text has no ids and decodes to an empty
    text.  Rows that repeat an id each give their row; other columns of docs are left out.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for a, b, texts in text_slices(batch, "text"):
                ids = bpe.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())],
                    ["id", "n_tokens", "ids", "decoded"],
                )

    from pyspark.sql import functions as F

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, n_tokens long, ids binary, decoded string").withColumnRenamed("id", id_col)
