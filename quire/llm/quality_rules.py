"""Quality rules: a linear-chain conditional random field marks each line as content or boilerplate.

The field's features are shares and flags of a line; Viterbi decoding gives the likeliest marks of a
text's lines in order, and the content's share of the words decides whether the text is kept.
Lines carry no labels of their own.  The field is first trained on labelled texts, each line with its
text's quality, and on splices of good and poor ones, which show it where marks change.  Lines that it
then marks against their text with near certainty change their label, and it is trained once more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.quality_classifier import BAR, BLANKS, DIGITS, HIGH, LOWER, NEWLINE, SHOUT, STOPS, SYMBOLS, TAIL, UPPER
from quire.llm.textkernel import Words, chunks, copies, dense, exact_windows, hashes, prefix
from quire.llm.training import labelled_sample, released

CONTENT = 1
N_FEATURES = 16
#: Lines of a training sequence.
LONGEST = 256


@dataclass
class Lines:
    doc: np.ndarray
    words: np.ndarray
    repeated: np.ndarray  # lines with a word that came before in their text
    features: np.ndarray

    def first(self, n_docs: int) -> np.ndarray:
        return np.searchsorted(self.doc, np.arange(n_docs + 1))


def triples(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Where three words of one text begin, and a number of the three."""
    number = exact_windows(w.number, 3)
    at = np.flatnonzero(w.doc[: len(number)] == w.doc[len(w.doc) - len(number) :])
    return at, number[at]


def lines(w: Words) -> Lines:
    """The lines of each text (an empty text has one) and their features."""
    breaks = np.flatnonzero(NEWLINE[w.buf])
    start = np.sort(np.r_[w.offsets[:-1], breaks + 1], kind="stable")
    doc = np.sort(np.r_[np.arange(w.n_docs), np.searchsorted(w.offsets[1:], breaks, "right")], kind="stable")
    last = np.r_[doc[1:] != doc[:-1], True] if len(doc) else np.zeros(0, bool)
    end = np.where(last, w.offsets[1:][doc], np.r_[start[1:], 0] - 1)
    n = np.searchsorted(w.start, end) - np.searchsorted(w.start, start)
    of = np.repeat(np.arange(len(n)), n)
    _, before = copies(doc, dense(w.low, start, end, hashes(w.low, start, end)))
    repeated = before & (n > 0)

    def count(table: np.ndarray) -> np.ndarray:
        p = prefix(table[w.buf])
        return (p[end] - p[start]).astype(np.float64)

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(of, flags, minlength=len(n)) / some

    again = np.zeros(len(w.hash), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    _, seen = copies(w.doc, w.number)
    at, triple = triples(w)
    _, old = copies(w.doc[at], triple)
    old_word = np.zeros(len(w.hash), bool)
    old_word[at] = old
    some, size = np.maximum(1, n), np.maximum(1, end - start - count(BLANKS))
    letters = np.maximum(1, count(UPPER) + count(LOWER))
    features = np.stack([
        np.ones(len(n)), np.log1p(n) / 4, np.minimum(size / some, 30) / 10, np.sqrt(count(SYMBOLS) / size), np.sqrt(count(SHOUT) / size),
        np.sqrt(np.minimum(1, count(BAR) / some)), np.sqrt(count(UPPER) / letters), np.sqrt(count(DIGITS) / size), np.sqrt(share(again)), share(seen),
        share(old_word), repeated.astype(float), (n == 0).astype(float), (n < 4).astype(float), np.minimum(1, count(STOPS) / some), np.sqrt(count(HIGH) / size),
    ], 1)
    return Lines(doc, n, repeated, features)


@dataclass
class Field:
    emit: np.ndarray  # weight of each feature for content against boilerplate
    step: np.ndarray  # (from, to)
    begin: np.ndarray

    def decode(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The likeliest marks of the lines of texts that begin at `first` (with the end)."""
        gain, length = features @ self.emit, np.diff(first)
        order = np.argsort(-length, kind="stable")
        start, length = first[:-1][order], length[order]
        live = np.searchsorted(-length, -np.arange(1, length.max(initial=0) + 1), "right")  # texts with so many lines
        (s00, s01), (s10, s11) = self.step
        one = start[: live[0]] if len(live) else start[:0]
        p = np.stack([np.full(len(one), self.begin[0]), self.begin[1] + gain[one]])
        back = np.zeros((2, len(gain)), bool)  # whether the line before is content, for either mark of a line
        for t in range(1, len(live)):  # a line of all texts that have so many
            n, at = live[t], start[: live[t]] + t
            x, y, u, v = p[0, :n] + s00, p[1, :n] + s10, p[0, :n] + s01, p[1, :n] + s11
            back[0, at], back[1, at] = y > x, v > u
            p[0, :n], p[1, :n] = np.where(y > x, y, x), np.where(v > u, v, u) + gain[at]
        out, mark = np.zeros(len(gain), np.int8), (p[1] > p[0]).astype(np.int8)
        for t in range(len(live) - 1, -1, -1):
            n = live[t]
            at = start[:n] + t
            out[at] = mark[:n]
            mark[:n] = np.where(mark[:n] == 1, back[1, at], back[0, at])
        return out


@dataclass
class Sequence:
    features: np.ndarray
    marks: np.ndarray
    weight: float


def spliced(texts: list[Sequence], labels: list[int], n: int, seed: int = 3) -> list[Sequence]:
    """n sequences made of a run of lines of one text and a run of another of the other label, in either order."""
    rng = np.random.default_rng(seed)
    pools = [[t for t, v in zip(texts, labels) if v == k and len(t.marks)] for k in (0, 1)]
    out = []
    for _ in range(n if all(pools) else 0):
        pair = [pools[k][rng.integers(len(pools[k]))] for k in rng.permutation(2)]
        cut = [(t, *np.sort(rng.integers(0, len(t.marks) + 1, 2))) for t in pair]
        cut = [(t, a, b) if a < b else (t, 0, len(t.marks)) for t, a, b in cut]
        out.append(Sequence(*(np.concatenate([getattr(t, x)[a:b] for t, a, b in cut]) for x in ("features", "marks")), sum(t.weight for t in pair) / 2))
    return out


def trained(data: list[Sequence], theta: np.ndarray, rounds: int, rate: float = 0.1, penalty: float = 1e-3) -> tuple[np.ndarray, list[np.ndarray]]:
    """Weights after some rounds of Adam on the conditional likelihood, and each sequence's chance of content by line."""
    length = np.array([len(t.marks) for t in data])
    batches = []
    for pick in np.array_split(np.argsort(length, kind="stable"), -(-len(data) // 64)):  # of similar length, at most LONGEST
        x, y, inside = np.zeros((len(pick), length[pick].max(), N_FEATURES)), np.zeros((len(pick), length[pick].max()), int), np.arange(length[pick].max()) < length[pick][:, None]
        for k, t in enumerate(pick):
            x[k, : length[t]], y[k, : length[t]] = data[t].features, data[t].marks
        batches.append((pick, x, inside, y, np.array([data[t].weight for t in pick]) / np.maximum(1, length[pick])))
    one, two = np.zeros_like(theta), np.zeros_like(theta)
    scale = sum((b[4] * b[2].sum(1)).sum() for b in batches)
    chances: list[np.ndarray] = [np.zeros(0)] * len(data)
    for turn in range(1, rounds + 1):
        emit, step, begin = theta[:N_FEATURES], theta[N_FEATURES : N_FEATURES + 4].reshape(2, 2), theta[-2:]
        grad = np.zeros_like(theta)
        for pick, x, inside, y, wt in batches:
            n, most = inside.shape
            gain = np.stack([np.zeros((n, most)), x @ emit], 2)
            fwd, bwd = np.zeros((n, most, 2)), np.zeros((n, most, 2))
            fwd[:, 0] = begin + gain[:, 0]
            for t in range(1, most):
                fwd[:, t] = np.where(inside[:, t, None], np.logaddexp(fwd[:, t - 1, :1] + step[0], fwd[:, t - 1, 1:] + step[1]) + gain[:, t], fwd[:, t - 1])
            for t in range(most - 2, -1, -1):
                ahead = gain[:, t + 1] + bwd[:, t + 1]
                bwd[:, t] = np.where(inside[:, t + 1, None], np.logaddexp(step[:, 0] + ahead[:, :1], step[:, 1] + ahead[:, 1:]), 0)
            total = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])[:, None, None]
            mark = np.exp(fwd + bwd - total) * inside[..., None]
            if turn == rounds:
                for k, t in enumerate(pick):
                    chances[t] = mark[k, : length[t], 1]
            grad[:N_FEATURES] += np.einsum("nt,ntf,n->f", y * inside - mark[..., 1], x, wt)
            for v in (0, 1):
                grad[N_FEATURES + 4 + v] += (wt * ((y[:, 0] == v) - mark[:, 0, v])).sum()
            both = inside[:, 1:]
            for i in (0, 1):
                for j in (0, 1):
                    pair = np.exp(fwd[:, :-1, i] + step[i, j] + gain[:, 1:, j] + bwd[:, 1:, j] - total[..., 0])
                    told = (y[:, :-1] == i) & (y[:, 1:] == j)
                    grad[N_FEATURES + 2 * i + j] += (wt * ((told - pair) * both).sum(1)).sum()
        grad = -grad / scale + penalty * theta
        one, two = 0.9 * one + 0.1 * grad, 0.99 * two + 0.01 * grad**2
        theta = theta - rate * one / (1 - 0.9**turn) / (np.sqrt(two / (1 - 0.99**turn)) + 1e-8)
    return theta, chances


def bounded(data: list[Sequence], labels: list[int], most: int, seed: int = 5) -> tuple[list[Sequence], list[int]]:
    """Of each label, sequences picked at random of about `most` lines together; all of them where they have no more."""
    keep = np.zeros(len(data), bool)
    for value in (0, 1):
        own = np.flatnonzero(np.array(labels) == value)
        size = np.array([len(data[k].marks) for k in own])
        if size.sum() <= most:
            keep[own] = True
            continue
        pick = np.random.default_rng(seed).permutation(len(own))
        keep[own[pick[np.cumsum(size[pick]) - size[pick] < most]]] = True
    return [d for d, k in zip(data, keep) if k], [v for v, k in zip(labels, keep) if k]


def fit(texts: list[str], labels: list[int], share: float, rounds: int = 80, sure: float = 0.98, most_lines: int = 60_000) -> Field:
    """Fits the field on labelled texts, of each label about most_lines lines; with one class alone, every line is content.

    Texts of more than LONGEST lines are cut into sequences of so many, which share the text's weight.
    """
    if len(set(labels)) < 2:
        return Field(np.r_[10.0, np.zeros(N_FEATURES - 1)], np.zeros((2, 2)), np.zeros(2))
    label = np.array(labels)
    weight = np.where(label == 1, share / (label == 1).mean(), (1 - share) / (label == 0).mean())
    data, of = [], []
    for a, b, w in chunks(pa.array(texts)):
        own = lines(w)
        first = own.first(w.n_docs)
        for k, (i, j) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            data += [Sequence(own.features[c : min(c + LONGEST, j)], np.full(min(c + LONGEST, j) - c, label[a + k]), weight[a + k] * (min(c + LONGEST, j) - c) / (j - i)) for c in range(i, j, LONGEST)]
            of += [label[a + k]] * -(-(j - i) // LONGEST)
    data, of = bounded(data, of, most_lines)
    theta, chances = trained(data + spliced(data, of, len(data) // 2), np.zeros(N_FEATURES + 6), rounds)
    for t, chance in zip(data, chances):
        t.marks = np.where(chance > sure, 1, np.where(chance < 1 - sure, 0, t.marks))
    theta, _ = trained(data + spliced(data, of, len(data) // 2), theta, rounds // 2)
    return Field(theta[:N_FEATURES], theta[N_FEATURES : N_FEATURES + 4].reshape(2, 2), theta[-2:])


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(w: Words, field: Field) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Counts of each text, and content's share of its words (0 without words)."""
    own = lines(w)
    first = own.first(w.n_docs)
    mark = field.decode(own.features, first)
    n = w.per_doc()
    inside, symbols = prefix(~BLANKS[w.buf] & ~TAIL[w.buf]), prefix(SYMBOLS[w.buf])
    at, triple = triples(w)
    often, _ = copies(w.doc[at], triple)
    covered = np.zeros(len(w.hash), bool)
    for k in range(3):
        covered[at[often > 1] + k] = True
    low, high = w.offsets[:-1], w.offsets[1:]
    out = {
        "n_words": n, "word_chars": inside[high] - inside[low], "n_symbols": symbols[high] - symbols[low],
        "n_dup_lines": np.bincount(own.doc, own.repeated, minlength=w.n_docs).astype(np.int64), "n_repeat_words": w.per_doc(covered).astype(np.int64),
    }
    return out, np.bincount(own.doc, own.words * (mark == CONTENT), minlength=w.n_docs) / np.maximum(1, n)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = 800, min_words: int = 50, max_repeat: int = 50, min_content: float = 0.5) -> DataFrame:
    """One row per row of docs: the id, five counts, base_failed, kept and content_share.

    A text fails the base rules with fewer than min_words words, or with more than max_repeat in a
    hundred of its words in three-word windows that it has twice or more.  Otherwise it is kept if
    lines marked as content hold min_content of its words or more.  A null or empty text has no words
    and fails.  The field is fitted on at most per_class labelled texts of each quality.  Rows that
    repeat an id each give their row; other columns of docs are left out.
    """
    field = released(fit(*labelled_sample(docs, labels, "quality", per_class, id_col, text_col)))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in chunks(batch.column("text")):
                counts, share = measure(w, field)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(counts[c], pa.int64()) for c in MEASURES), pa.array(share)], ["id", *MEASURES, "content_share"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = rows.mapInArrow(run, f"id {id_type}, {', '.join(f'{c} long' for c in MEASURES)}, content_share double")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    return out.select(F.col("id").alias(id_col), *MEASURES, failed.alias("base_failed"), (~failed & (F.col("content_share") >= min_content)).alias("kept"), "content_share")
