"""Quality by a factorisation machine over hashed words and structure statistics.

The score is w0 + sum w_i x_i + sum over i < j of <v_i, v_j> x_i x_j, and the pairwise part is taken
in linear time as half of (sum v_i x_i)^2 - sum v_i^2 x_i^2 for each factor.  The metadata that counts
is the text's own length; language, source and ids are no inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from quire.llm.textkernel import BYTES_FOLDED, Words, copies, exact_windows, prefix, words
from quire.llm.toxicity import scored
from quire.llm.training import labelled_sample, released

BITS, FACTORS, SHARE = 14, 4, 8.0  # hashed words, factors, and the scale of a word's share of the text
N_STATS = 15


def _flags(allowed: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(allowed)] = True
    return out


SYMBOLS, UPPER, LOWER, DIGITS = _flags(b"#*$%&|<>"), _flags(bytes(range(65, 91))), _flags(bytes(range(97, 123))), _flags(b"0123456789")
BLANKS, SHOUT, BAR, STOPS, NEWLINE = _flags(b" \t\n\x0b\x0c\r"), _flags(b"!"), _flags(b"|"), _flags(b".,;:?"), _flags(b"\n")
HIGH, TAIL = np.arange(256) >= 128, (np.arange(256) & 0xC0) == 0x80


def statistics(w: Words) -> np.ndarray:
    """Structure of each text, one row a text."""
    low, high = w.offsets[:-1], w.offsets[1:]

    def count(table: np.ndarray) -> np.ndarray:
        p = prefix(table[w.buf])
        return (p[high] - p[low]).astype(np.float64)

    n = w.per_doc().astype(np.float64)
    size, some = np.maximum(1, (high - low) - count(BLANKS)), np.maximum(1, n)
    points = (high - low) - count(TAIL)
    again = np.zeros(len(w.hash), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    often, before = copies(w.doc, w.number)
    triple = exact_windows(w.number, 3)
    whole = w.doc[: len(triple)] == w.doc[len(w.doc) - len(triple) :]
    at = w.doc[: len(triple)][whole]
    _, seen = copies(at, triple[whole])
    letters = np.maximum(1, count(UPPER) + count(LOWER))
    return (n > 0)[:, None] * np.stack([
        np.log1p(points), np.log1p(n), size / some, np.sqrt(count(SYMBOLS) / size), np.sqrt(count(SHOUT) / size), np.sqrt(count(BAR) / some),
        np.sqrt(count(UPPER) / letters), np.sqrt(count(DIGITS) / size), np.sqrt(w.per_doc(again) / some), w.per_doc(before) / some,
        np.bincount(at, seen, minlength=w.n_docs) / some, np.log1p(n / (1 + count(NEWLINE))), count(HIGH) / size, count(STOPS) / some,
        np.sqrt(w.per_doc(often.astype(np.float64)) / some / some),
    ], 1)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray  # of hashed words, then of statistics
    factors: np.ndarray
    centre: np.ndarray
    spread: np.ndarray

    def score(self, w: Words) -> np.ndarray:
        x = np.clip((statistics(w) - self.centre) / self.spread, -4, 4)
        return 1 / (1 + np.exp(-np.clip(self.raw(w, x)[0], -30, 30)))

    def raw(self, w: Words, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """The sum before the logistic curve, the factors' sums, and what the gradient needs of the words."""
        slot = (w.hash >> np.uint64(64 - BITS)).astype(np.int64)
        own = SHARE / np.maximum(1, w.per_doc())[w.doc]  # of a token; a word's value is its tokens' sum
        often, _ = copies(w.doc, w.number)
        y = self.bias + w.per_doc(self.linear[slot] * own) + x @ self.linear[1 << BITS :]
        sums = np.stack([w.per_doc(self.factors[slot, f] * own) for f in range(FACTORS)], 1) + x @ self.factors[1 << BITS :]
        squares = w.per_doc((self.factors[slot] ** 2).sum(1) * own * own * often) + (x**2) @ (self.factors[1 << BITS :] ** 2).sum(1)
        return y + 0.5 * ((sums**2).sum(1) - squares), sums, (slot, own, often)


def fit(texts: list[str], labels: list[int], share: float, epochs: int = 30, rate: float = 0.03, penalty: float = 1e-4) -> Machine:
    """Fits by Adam on logistic loss, the classes weighted as in all labelled rows; one class alone gives its share."""
    rng = np.random.default_rng(5)
    size = (1 << BITS) + N_STATS
    m = Machine(float(np.log((share + 1e-3) / (1 - share + 1e-3))), np.zeros(size), np.zeros((size, FACTORS)), np.zeros(N_STATS), np.ones(N_STATS))
    if len(set(labels)) < 2:
        return m
    m.factors = rng.normal(0, 0.02, (size, FACTORS))
    target = np.array(labels, np.float64)
    weight = np.where(target > 0, share / target.mean(), (1 - share) / (1 - target.mean()))
    raw = [t.encode() for t in texts]
    stats = []

    def part(pick: np.ndarray) -> Words:
        own = [raw[k] for k in pick]
        return words(np.frombuffer(b"".join(own), np.uint8), np.r_[0, np.cumsum([len(r) for r in own])].astype(np.int64), BYTES_FOLDED)

    for k in range(0, len(raw), 256):
        stats.append(statistics(part(np.arange(k, min(len(raw), k + 256)))))
    stats = np.concatenate(stats)
    m.centre, m.spread = stats.mean(0), stats.std(0) + 1e-6
    stats = np.clip((stats - m.centre) / m.spread, -4, 4)
    batches = [(pick, part(pick)) for pick in np.array_split(rng.permutation(len(raw)), -(-len(raw) // 256))]
    one, two, turn = np.zeros((size, FACTORS + 1)), np.zeros((size, FACTORS + 1)), 0
    for _ in range(epochs):
        for pick, w in batches:
            x = stats[pick]
            y, sums, (slot, own, often) = m.raw(w, x)
            g = weight[pick] * (1 / (1 + np.exp(-np.clip(y, -30, 30))) - target[pick]) / len(pick)
            grad = np.zeros((size, FACTORS + 1))
            push = g[w.doc] * own
            grad[: 1 << BITS, 0] = np.bincount(slot, push, 1 << BITS)
            grad[1 << BITS :, 0] = x.T @ g
            own_square = np.bincount(slot, push * own * often, 1 << BITS)
            for f in range(FACTORS):
                grad[: 1 << BITS, f + 1] = np.bincount(slot, push * sums[w.doc, f], 1 << BITS) - own_square * m.factors[: 1 << BITS, f]
                grad[1 << BITS :, f + 1] = x.T @ (g * sums[:, f]) - ((x**2).T @ g) * m.factors[1 << BITS :, f]
            grad += penalty * np.c_[m.linear, m.factors]
            turn += 1
            one, two = 0.9 * one + 0.1 * grad, 0.99 * two + 0.01 * grad**2
            move = rate * one / (1 - 0.9**turn) / (np.sqrt(two / (1 - 0.99**turn)) + 1e-6)
            m.linear, m.factors = m.linear - move[:, 0], m.factors - move[:, 1:]
            m.bias -= rate * g.sum()
    m.linear, m.factors = m.linear.astype(np.float32), m.factors.astype(np.float32)
    return m


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = 1500, threshold: float = 0.3) -> DataFrame:
    """docs with held_out, score and predicted added, which replace columns so named in any case.

    The machine is fitted on at most per_class labelled texts of each class outside bucket 0; the
    score is then a function of the whole text alone.  A null or empty text is scored like a text
    without words.  A row without an id is not held out.  Rows that repeat are scored alike; an empty
    table, or labels of one class only, give scores at the labels' share.
    """
    model = released(fit(*labelled_sample(docs, labels, "quality", per_class, id_col, text_col)))
    return scored(docs, model.score, threshold, id_col, text_col)
