"""Words of many texts at once: one flat byte buffer, word bounds, and 64-bit word hashes in numpy.

A word is a run of bytes outside space, tab, newline, vertical tab, form feed and carriage return.
A hash mixes each block of eight bytes with a key of its place and adds the results up.  Where equality
decides a result, the bytes are compared as well: see dense() and equal_bytes().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 21
PART_BYTES = 1 << 19  # of text at a time where a chunk's arrays are many times its text
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_R = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection whose outputs look random."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: Byte values that hashes and comparisons see: as they are, or with A-Z as a-z.
BYTES = np.arange(256, dtype=np.uint8)
BYTES_FOLDED = BYTES.copy()
BYTES_FOLDED[65:91] += 32
PAD = 8
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def mapped(buf: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values[buf] for a value of each byte, as bytes translate: without an index of each."""
    return np.frombuffer(buf.tobytes().translate(values.tobytes()), values.dtype)


def padded(buf: np.ndarray, values: np.ndarray = BYTES) -> np.ndarray:
    """The buffer's bytes as hashes see them, with eight zeros behind."""
    out = np.zeros(len(buf) + PAD, np.uint8)
    out[: len(buf)] = buf if values is BYTES else mapped(buf, values)
    return out


def _eights(low: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of a padded buffer on, as one number."""
    return np.ndarray((len(low) - PAD + 1,), "<u8", low, 0, (1,))


def _later(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of ranges over eight bytes: which they are, and for each further block its range, place, and where ranges begin."""
    long = np.flatnonzero(size > 8)
    n = (size[long] - 1) // 8
    first = np.cumsum(n) - n
    turn = np.arange(n.sum()) - np.repeat(first, n) + 1
    return long, np.repeat(long, n), turn, first


def hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges of a padded buffer."""
    if not len(start):
        return np.zeros(0, U64)
    eight, size = _eights(low), end - start
    out = mix((eight[start] & _MASK[np.minimum(size, 8)]) ^ U64(_R))
    long, of, turn, first = _later(size)
    if len(long):
        at = start[of] + 8 * turn
        block = eight[at] & _MASK[np.minimum(end[of] - at, 8)]
        out[long] += np.add.reduceat(mix(block ^ mix((turn + 1).astype(U64) * U64(_R))), first)
    return mix(out + size.astype(U64) * U64(0xD6E8FEB86659FD93))


def equal_bytes(one: np.ndarray, start: np.ndarray, end: np.ndarray, two: np.ndarray, start2: np.ndarray, end2: np.ndarray) -> np.ndarray:
    """Whether ranges of one padded buffer have the bytes of ranges of another."""
    a, b, size = _eights(one), _eights(two), end - start
    mask = _MASK[np.minimum(size, 8)]
    out = (size == end2 - start2) & ((a[start] & mask) == (b[start2] & mask))
    long, of, turn, _ = _later(np.where(out, size, 0))
    if len(long):
        at = 8 * turn
        mask = _MASK[np.minimum(size[of] - at, 8)]
        out[of[(a[start[of] + at] & mask) != (b[start2[of] + at] & mask)]] = False
    return out


@dataclass
class Words:
    buf: np.ndarray  # bytes of all texts of the chunk
    offsets: np.ndarray  # of the texts in buf, one more than there are texts
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  # the text's place in the chunk
    hash: np.ndarray
    low: np.ndarray  # buf as hashes see it, padded

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    def per_doc(self, values: np.ndarray | None = None) -> np.ndarray:
        """The number of words of each text, or the sum of a value over them."""
        out = np.bincount(self.doc, values, minlength=self.n_docs)
        return out.astype(np.int64) if values is None else out

    @cached_property
    def number(self) -> np.ndarray:
        """A number of each word, the same for the same word and for no other."""
        return dense(self.low, self.start, self.end, self.hash)

    def first(self) -> np.ndarray:
        """Where each text's words begin among all words; one more entry at the end."""
        return np.searchsorted(self.doc, np.arange(self.n_docs + 1))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of strings; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of `most` bytes together; one longer text is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


SPACE_ONLY = np.arange(256) == 0x20


def words(buf: np.ndarray, offsets: np.ndarray, values: np.ndarray = BYTES, blank: np.ndarray = BLANK) -> Words:
    n, low = len(buf), padded(buf, values)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(buf, offsets, none, none, none, np.zeros(0, U64), low)
    inside = mapped(buf, ~blank)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    return Words(buf, offsets, start, end, doc, hashes(low, start, end), low)


def chunks(texts: pa.Array, values: np.ndarray = BYTES, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(from, to, words) for ranges of rows of a column, about `most` bytes of text at a time."""
    buf, offsets = flat(texts)
    for a, b in spans(offsets, most):
        part = offsets[a : b + 1]
        yield a, b, words(buf[part[0] : part[-1]], part - part[0], values)


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the `size` words from each word on, and whether they lie in one text."""
    n = len(w.hash) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, bool)
    out = np.zeros(n, U64)
    for k in range(size):
        out += w.hash[k : k + n] * U64(pow(_R, 2 * k + 1, 1 << 64))
    return mix(out), w.doc[:n] == w.doc[size - 1 :]


def dense(low: np.ndarray, start: np.ndarray, end: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Numbers of byte ranges, the same for ranges of the same bytes and for no others."""
    _, pick, number = np.unique(digest, return_index=True, return_inverse=True)
    if not len(digest) or equal_bytes(low, start, end, low, start[pick][number], end[pick][number]).all():
        return number
    raw, seen = low.tobytes(), {}  # hashes collide: the bytes themselves
    return np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(start.tolist(), end.tolist())], np.int64)


def exact_windows(number: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the runs of `size` numbers (under 2**32) from each place on."""
    n = max(0, len(number) - size + 1)
    out, k = number[:n].astype(U64), 1
    while k < size and n:
        bits = int(number.max()).bit_length()
        if int(out.max()).bit_length() + bits > 64:
            out = np.unique(out, return_inverse=True)[1].astype(U64)
        out = out << U64(bits) | number[k : k + n].astype(U64)
        k += 1
    return np.unique(out, return_inverse=True)[1]


def copies(doc: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of numbered items of several texts: how often the item is found in its text, and whether it came before."""
    if not len(number):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    _, first, inverse, count = np.unique(doc.astype(U64) << U64(32) | number.astype(U64), return_index=True, return_inverse=True, return_counts=True)
    return count[inverse], first[inverse] != np.arange(len(number))


def prefix(flags: np.ndarray) -> np.ndarray:
    """Running counts with a zero in front: counts of a range are differences."""
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out
