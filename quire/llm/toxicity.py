"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear support vector machine.

The strings are letter runs (words without other signs; single letters in a row count as one run).
The kernel of two strings sums decay ** (span + span) over their common subsequences of three
letters that lie within SPAN letters, and is scaled by the strings' lengths: inserted signs do not
matter to it and inserted letters only a little.  Labels belong to whole texts: as in multiple-
instance learning, the text's string of highest margin stands for it, and is chosen anew after each fit.
As the machine is linear in the landmarks' kernels, its margin is a sum of one weight a subsequence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from quire.llm.exact_dedup import others
from quire.llm.textkernel import BYTES_FOLDED, PART_BYTES, Words, chunks
from quire.llm.training import bucket, labelled_sample, released

LONG, SPAN, DECAY, LETTERS = 12, 5, 0.7, 42
WIDTH = LONG + 2  # a sign for the string's beginning and one for its end
BEGIN, END, LEAST = 40, 41, 7
STRONG = 0.7  # margin of a string that counts
LOUD, LEAST_RATIO = 0.8, 8.0  # share of toxic texts, and log likelihood ratio, of strings that clean texts have too
_POSITION = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WIDTH)], np.uint64)
STEPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN - a + 1) if a + b < SPAN + 1]
_CLASS = np.zeros(256, np.int32)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[48:58] = 27
_CLASS[128:192] = 28 + np.arange(64) % 12  # second bytes of accented letters; first bytes do not count


def letter_rows(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings as rows of letter classes (0: none), and the text of each; longer ones in overlapping windows."""
    if not len(w.start):
        return np.zeros((0, WIDTH), np.int32), np.zeros(0, np.int64)
    single = w.end - w.start == 1
    joined = np.zeros(len(single), bool)
    joined[1:] = single[1:] & single[:-1] & (w.doc[1:] == w.doc[:-1])
    head = np.flatnonzero(~joined)
    last = np.r_[head[1:], len(single)] - 1
    start, end, doc, digest = w.start[head], w.end[last], w.doc[head], np.add.reduceat(w.hash * (np.cumsum(joined).astype(np.uint64) * np.uint64(2) + np.uint64(1)), head) if joined.any() else w.hash
    _, pick, back = np.unique(digest, return_index=True, return_inverse=True)
    counted = np.zeros(len(w.buf) + 1, np.int64)
    np.cumsum(_CLASS[w.buf] > 0, out=counted[1:])
    letters = _CLASS[w.buf][_CLASS[w.buf] > 0]
    low, high = counted[start[pick]], counted[end[pick]]
    parts = np.maximum(1, -(-(high - low - LONG) // (LONG // 2)) + 1)
    of = np.repeat(np.arange(len(pick)), parts)
    turn = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    at = (low[of] + turn * (LONG // 2))[:, None] + np.arange(-1, LONG + 1)
    padded = np.r_[letters, np.int32(0)]
    rows = np.where((at >= low[of][:, None]) & (at < high[of][:, None]), padded[np.clip(at, 0, len(letters))], 0)
    rows[:, -1] = 0
    rows[(turn == 0) & (high > low)[of], 0] = BEGIN
    size = np.minimum(high[of] - low[of] - turn * (LONG // 2), LONG)
    final = np.flatnonzero((turn == parts[of] - 1) & (size > 0))
    rows[final, size[final] + 1] = END
    rows[turn > 0, 0] = 0
    # each text gets the windows of its strings
    first = np.cumsum(parts) - parts
    n = parts[back]
    row = np.repeat(first[back], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return rows, np.stack([row, np.repeat(doc, n)])


PART = 8000  # rows of which subsequences are numbered at once


def codes(rows: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each pair of steps: the subsequence at each place of each row (0: none), and its weight."""
    for a, b in STEPS:
        x, y, z = rows[:, : WIDTH - a - b], rows[:, a : WIDTH - b], rows[:, a + b :]
        yield np.where((x > 0) & (y > 0) & (z > 0), (x * LETTERS + y) * LETTERS + z, 0), DECAY ** (a + b + 1)


_SCALE = np.array([1.0, *(np.sqrt(max(1e-9, sum(max(0, n - a - b) * DECAY ** (2 * (a + b + 1)) for a, b in STEPS))) for n in range(1, WIDTH + 1))])
_SCALE[:LEAST] = _SCALE[LEAST]  # short strings stay near the bias


def scale(rows: np.ndarray) -> np.ndarray:
    return _SCALE[(rows > 0).sum(1)]


def used(rows: np.ndarray) -> np.ndarray:
    """The place of each subsequence among those that the rows have (0: none, and all that they lack)."""
    found = np.zeros(LETTERS**3, bool)
    for at in range(0, len(rows), PART):
        for code, _ in codes(rows[at : at + PART]):
            found[code] = True
    found[0] = True
    return np.where(found, np.cumsum(found) - 1, 0).astype(np.int32)


def embed(rows: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The kernel's features of a few rows, dense: (place of the subsequence, row)."""
    out = np.zeros((place.max() + 1, len(rows)), np.float32)
    line = np.arange(len(rows))[:, None]
    for code, weight in codes(rows):
        np.add.at(out, (place[code], np.broadcast_to(line, code.shape)), np.float32(weight))
    out[0] = 0
    out /= scale(rows).astype(np.float32)
    return out


def project(rows: np.ndarray, table: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Inner products of the rows' features with the columns of a table (place of the subsequence, column)."""
    out = np.zeros((len(rows), *table.shape[1:]), np.float32)
    for at in range(0, len(rows), 2000):
        for code, weight in codes(rows[at : at + 2000]):
            for k in range(code.shape[1]):
                out[at : at + 2000] += table[place[code[:, k]]] * np.float32(weight)
    return out / scale(rows).reshape(-1, *[1] * (table.ndim - 1)).astype(np.float32)


def margins(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.float32)
    for at in range(0, len(rows), PART):
        for code, weight in codes(rows[at : at + PART]):
            out[at : at + PART] += weights[code].sum(1) * np.float32(weight)
    return out / scale(rows).astype(np.float32)


def signs(f: np.ndarray, row: np.ndarray, doc: np.ndarray, n_docs: int, empty: float = -3.0) -> np.ndarray:
    """Two signs of each text from the margins of its strings; texts without strings get `empty` and none."""
    top = np.full(n_docs, empty, np.float64)
    np.maximum.at(top, doc, f[row])
    return np.stack([np.clip(top, empty, 1.0), np.log1p(np.bincount(doc, f[row] > STRONG, minlength=n_docs))], 1)


@dataclass
class Model:
    weights: np.ndarray  # of subsequences
    bias: float
    slope: np.ndarray  # of the signs
    shift: float

    def signs(self, w: Words) -> np.ndarray:
        """The highest margin of each text's strings, and the logarithm of how many are strong."""
        rows, at = letter_rows(w)
        return signs(margins(rows, self.weights) + self.bias, at[0], at[1], w.n_docs) if len(rows) else signs(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), w.n_docs)

    def score(self, w: Words) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.signs(w) @ self.slope + self.shift, -30, 30)))


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-6, rounds: int = 400) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by accelerated gradient steps."""
    x = np.c_[x, np.ones(len(x), np.float32)]
    gram = sum((x[k : k + 2000] * weight[k : k + 2000, None].astype(np.float32)).T @ x[k : k + 2000] for k in range(0, len(x), 2000))
    step = 1 / (2 * np.linalg.eigvalsh(gram.astype(np.float64))[-1] * 1.01 + penalty + 1e-9)
    w = ahead = np.zeros(x.shape[1], np.float32)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        nxt = (ahead - step * (penalty * ahead - 2 * (x.T @ (weight * y * slack).astype(np.float32)))).astype(np.float32)
        ahead, w = (nxt + k / (k + 3) * (nxt - w)).astype(np.float32), nxt
    return w[:-1], float(w[-1])


def _curve(x: np.ndarray, y: np.ndarray, share: float) -> tuple[np.ndarray, float]:
    """Slopes and shift of a logistic curve over signs, the classes weighted as in all labelled rows."""
    weight = np.where(y > 0, share / max(1, (y > 0).sum()), (1 - share) / max(1, (y < 0).sum()))
    t = np.where(y > 0, 1 - 1e-3, 1e-3)
    x = np.c_[x, np.ones(len(x))]
    ridge = np.array([1e-4, 1e-4, 1e-5])
    theta = np.array([1.0, 0.0, 0.0])
    for _ in range(60):  # Newton
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (p - t)) + ridge * theta)
        theta = theta - np.clip(step, -2, 2)
    return theta[:-1], float(theta[-1])


def _ratio(n1: np.ndarray, n0: np.ndarray, usual: float) -> np.ndarray:
    """Log likelihood ratio of n1 toxic and n0 clean texts having something, against the usual share of toxic ones."""
    part = n1 / np.maximum(1, n1 + n0)
    return n1 * np.log(np.maximum(part, 1e-9) / usual) + n0 * np.log(np.maximum(1 - part, 1e-9) / (1 - usual))


def _witnesses(value: np.ndarray, row: np.ndarray, doc: np.ndarray, least: float) -> np.ndarray:
    """The string of highest value of each text, where that is `least` or more."""
    order = np.lexsort((-value[row], doc))
    head = order[np.flatnonzero(np.r_[True, doc[order][1:] != doc[order][:-1]])] if len(order) else order
    return row[head[value[row[head]] >= least]]


def fit(texts: list[str], labels: list[int], share: float, landmarks: int = 300, negatives: int = 9000, rounds: int = 6) -> Model:
    """Fits the machine on labelled texts; without both classes every score is the share of ones."""
    label = np.array(labels)
    if len(set(labels)) < 2:
        return Model(np.zeros(LETTERS**3, np.float32), 0.0, np.zeros(2), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    parts, codes_, row, doc, at = [], [], [], [], 0
    for a, _, w in chunks(pa.array(texts), BYTES_FOLDED):
        own, (r, d) = letter_rows(w) if len(w.start) else (np.zeros((0, WIDTH), np.int32), np.zeros((2, 0), np.int64))
        parts.append(own)
        codes_.append(own.astype(np.uint64) @ _POSITION)
        row.append(r + at)
        doc.append(d + a)
        at += len(own)
    _, pick, same = np.unique(np.concatenate(codes_), return_index=True, return_inverse=True)
    rows, row, doc = np.concatenate(parts)[pick], same[np.concatenate(row)], np.concatenate(doc)
    del parts, codes_, same
    rng = np.random.default_rng(17)
    toxic = label[doc] == 1
    # the first choice: strings with four letters in a row, or a beginning, that toxic texts have beyond chance
    gram = rows[:, :-3].astype(np.int32)
    for k in (1, 2, 3):
        gram *= LETTERS
        gram += rows[:, k : rows.shape[1] - 3 + k]
    gram[(rows[:, 3:] == 0) | (rows[:, :-3] == 0)] = 0
    begun = np.cumsum(rows[:, :10].astype(np.int64) * np.array([LETTERS**k for k in range(10)], np.int64), 1)[:, 4:] * 16 + np.arange(4, 10)
    begun = np.where((rows[:, 4:10] > 0) & (rows[:, :1] == BEGIN), -begun, 0)
    there = np.zeros(LETTERS**4, bool)
    there[gram] = True
    kinds, begins = np.flatnonzero(there), np.unique(begun)
    gram = np.concatenate([(np.cumsum(there, dtype=np.int32) - 1)[gram], (np.searchsorted(begins, begun) + len(kinds)).astype(np.int32)], 1)
    kinds = np.r_[kinds, begins]
    seen = np.zeros((2, len(kinds)), np.int32)
    for v, own in zip(label, np.split(row[np.argsort(doc, kind="stable")], np.cumsum(np.bincount(doc, minlength=len(label)))[:-1])):
        seen[v, np.unique(gram[own])] += 1
    usual = label.sum() / len(label)
    odds = np.where(seen[1] > max(usual, 0.9) * seen.sum(0), _ratio(seen[1], seen[0], usual), 0).astype(np.float32)
    odds[kinds == 0] = 0
    value = odds[gram].max(1)
    del begun, gram, kinds, seen, odds
    pair = np.unique(np.stack([row, doc]), axis=1)
    n_toxic, n_clean = (np.bincount(pair[0][label[pair[1]] == v], minlength=len(rows)) for v in (1, 0))
    # a string stands for a toxic text if no clean one has it, or if far more toxic ones than chance has it do: one
    # mislabelled or quoting text rules nothing out
    loud = (n_clean == 0) | ((n_toxic > LOUD * (n_toxic + n_clean)) & (_ratio(n_toxic, n_clean, usual) > LEAST_RATIO))
    clean = np.flatnonzero((n_clean > 0) & ~loud)
    suspect = toxic & loud[row]
    plain = row[suspect & (value[row] >= 12.0)]
    positive = np.r_[plain, _witnesses(value, row[suspect], doc[suspect], 6.0)]
    negative, hard = rng.permutation(clean)[:negatives], clean[:0]
    model = Model(np.zeros(LETTERS**3, np.float32), 0.0, np.zeros(2), 0.0)
    place = used(rows)
    for _ in range(rounds if len(positive) else 0):
        kind, count = np.unique(positive, return_counts=True)
        marks = np.r_[kind[np.argsort(-count, kind="stable")][: landmarks // 3], rng.permutation(hard)[: landmarks // 3], rng.permutation(negative)[: landmarks // 2]][:landmarks]
        table = embed(rows[marks], place)
        value_, vector = np.linalg.eigh(project(rows[marks], table, place).astype(np.float64))
        keep = value_ > 1e-4 * value_[-1]
        root = (vector[:, keep] / np.sqrt(value_[keep])).astype(np.float32)
        kind, count = np.unique(positive, return_counts=True)
        own = np.r_[kind, negative, hard]
        y = np.r_[np.ones(len(kind)), -np.ones(len(negative) + len(hard))]
        mass = [count / count.sum(), np.full(len(negative), 1 / max(1, len(negative))), np.full(len(hard), 4 / max(1, len(hard)))]
        v, bias = _machine(project(rows[own], table, place) @ root, y, np.concatenate(mass))
        model = Model((table @ (root @ v)).astype(np.float32)[place] * (np.arange(LETTERS**3) > 0), bias, np.zeros(2), 0.0)
        f = margins(rows, model.weights) + bias
        hard = np.unique(np.r_[hard, clean[np.argsort(-f[clean], kind="stable")[: negatives // 6]]])
        positive = np.r_[plain, _witnesses(f, row[suspect], doc[suspect], -0.3)]
        if not len(positive):
            break
    x = signs(margins(rows, model.weights) + model.bias, row, doc, len(label))
    y = np.where(label == 1, 1.0, -1.0)
    told = (y < 0) | (x[:, 0] > np.median(x[y < 0, 0]))  # a toxic label without a string that shows it says nothing of the curve
    model.slope, model.shift = _curve(x[told], y[told], share)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = 1000) -> DataFrame:
    """docs with held_out, score and predicted added, which replace columns so named in any case.

    The machine is fitted on at most per_class labelled texts of each class outside bucket 0; the
    score is then a function of the whole text alone.  A null or empty text, and one without letters,
    scores as the least toxic text does.  A row without an id is not held out.  Rows that repeat
    are scored alike; an empty table, or labels of one class only, give scores at the labels' share.
    """
    model = released(fit(*labelled_sample(docs, labels, "toxic", per_class, id_col, text_col)))
    return scored(docs, model.score, 0.5, id_col, text_col)


def marked(score: Callable[[Words], np.ndarray], text_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches to parts of them with score added: a part's memory goes back to the system before the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in chunks(batch.column(text_col), BYTES_FOLDED, PART_BYTES):
                part, marks = batch.slice(a, b - a), pa.array(np.asarray(score(w), np.float64))
                del w
                yield pa.RecordBatch.from_arrays([*part.columns, marks], [*part.schema.names, "score"])
                released()

    return run


def scored(docs: DataFrame, score, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """docs with held_out, score and predicted; score maps the words of a chunk of texts to numbers."""
    added = ["held_out", "score", "predicted"]
    own = others(docs.columns, added)
    inner = docs.select(*[F.col(f"`{c}`") for c in own])
    schema = StructType([*inner.schema.fields]).add("score", DoubleType())
    out = inner.mapInArrow(marked(score, text_col), schema)
    return out.select(*[F.col(f"`{c}`") for c in own], F.coalesce(bucket(F.col(f"`{id_col}`"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
