"""Product codes of vectors: Lloyd's rounds by Elkan's bounds, over integers.

A state table holds for every vector its integers, its codes, an upper bound a part on the distance to
the assigned entry, and a lower bound a part and entry, in one byte each: the bound's base-2 logarithm in
sixteenths, rounded down.  After a round bounds are shifted by how far entries moved.  An entry is passed over
only where the triangle inequality puts it strictly farther away than the assigned one; the others are compared
by integer distances, ties to the lower index, so codes equal those of plain Lloyd rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans.staging import drop_stage, stage

#: Components beyond this (of 256 * x) count as it, so that squared distances fit 64 bits.
LARGEST = 1 << 26
UP, DOWN = 1 + 1e-9, 1 - 1e-9
SLICE = 1024


def usable(rows: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector is not null and holds only finite numbers."""
    v = F.col(f"`{vec_col}`")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(v.isNotNull() & ~F.coalesce(F.exists(v, bad), F.lit(False)))


def integers(v: Column) -> Column:
    """floor(256 * x) of each component."""
    return F.transform(v, lambda x: F.greatest(F.least(F.floor(F.least(F.greatest(x.cast("double"), F.lit(-1e9)), F.lit(1e9)) * 256), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))


def encoded(bound: np.ndarray) -> np.ndarray:
    """Lower bounds as bytes that stand for no more than they do."""
    steps = np.floor(16 * np.log2(np.maximum(bound, 1)) * DOWN)
    return np.where(bound < 1, 0, np.minimum(steps + 1, 255)).astype(np.uint8)


DECODED = np.r_[0.0, 2.0 ** (np.arange(255) / 16) * DOWN]


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Integer squared distances of rows to all entries."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for k in range(x.shape[1]):
        out += (x[:, k, None] - entries[None, :, k]) ** 2
    return out


class Part:
    """One part's entries, how far they moved, and half the distances between them."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None):
        self.entries = entries
        self.moved = np.sqrt(((entries - before) ** 2).sum(1).astype(float)) * UP if before is not None else None
        self.half = np.sqrt(squared(entries, entries).astype(float)) / 2 * DOWN
        other = self.half + np.where(np.eye(len(entries), dtype=bool), np.inf, 0)
        self.nearest = other.min(1)

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, upper bounds and lower bounds without earlier ones."""
        d = squared(x, self.entries)
        code = d.argmin(1)
        return code, np.sqrt(d[np.arange(len(x)), code].astype(float)) * UP, np.sqrt(d.astype(float)) * DOWN

    def again(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        upper = (upper + self.moved[code]) * UP
        lower = np.maximum(lower - self.moved, 0) * DOWN
        code = code.copy()
        on = np.flatnonzero(upper >= self.nearest[code])  # the others are strictly nearest to their entry
        if len(on):
            xs, c = x[on], code[on]
            own = ((xs - self.entries[c]) ** 2).sum(1)
            u = np.sqrt(own.astype(float)) * UP
            low = lower[on]
            low[np.arange(len(on)), c] = u * DOWN * DOWN
            near = (low <= u[:, None]) & (self.half[c] <= u[:, None])
            near[np.arange(len(on)), c] = False
            r, j = np.nonzero(near)
            exact = ((xs[r] - self.entries[j]) ** 2).sum(1)
            all_ = np.full(near.shape, np.iinfo(np.int64).max)
            all_[r, j] = exact
            all_[np.arange(len(on)), c] = own
            low[r, j] = np.sqrt(exact.astype(float)) * DOWN
            best = all_.argmin(1)
            code[on], lower[on] = best, low
            upper[on] = np.sqrt(all_[np.arange(len(on)), best].astype(float)) * UP
        return code, upper, lower


def _parts(book: np.ndarray, before: np.ndarray | None) -> list[Part]:
    return [Part(book[p], None if before is None else before[p]) for p in range(len(book))]


def _split(batch: pa.RecordBatch, parts: int, width: int) -> np.ndarray:
    column = batch.column("x")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    full = np.zeros((batch.num_rows, parts * width), np.int64)
    if batch.num_rows:
        full[:, : len(flat) // batch.num_rows] = flat.reshape(batch.num_rows, -1)
    return full.reshape(batch.num_rows, parts, width)


def _binary(a: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(a).reshape(len(a), -1)
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _bytes(column: pa.Array, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _assigned(book: np.ndarray, before: np.ndarray | None, names: list[str], last: bool):
    """A task's pass: codes and bounds of each vector, or for the last pass codes and errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, (n_parts, n_entries, width) = _parts(book, before), book.shape
        for whole in batches:
            for begin in range(0, whole.num_rows, SLICE):
                batch = whole.slice(begin, SLICE)
                x, n = _split(batch, n_parts, width), batch.num_rows
                code, upper = np.zeros((n, n_parts), np.int64), np.zeros((n, n_parts), np.float64)
                lower = np.zeros((n, n_parts, n_entries), np.uint8)
                if before is not None:
                    was, up, low = _bytes(batch.column("code"), "u1", n_parts).astype(np.int64), _bytes(batch.column("upper"), "<f4", n_parts).astype(float), _bytes(batch.column("lower"), "u1", n_parts, n_entries)
                for p, part in enumerate(parts):
                    c, u, l = part.first(x[:, p]) if before is None else part.again(x[:, p], was[:, p], up[:, p], DECODED[low[:, p]])
                    code[:, p], upper[:, p] = c, u
                    if not last:
                        lower[:, p] = encoded(l)
                columns = [batch.column(c) for c in names] + [_binary(code.astype(np.uint8))]
                if last:
                    error = np.zeros(n, np.int64)
                    for p, part in enumerate(parts):
                        error += ((x[:, p] - part.entries[code[:, p]]) ** 2).sum(1)
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(error)], names=[*names, "code", "error"])
                else:
                    up = np.nextafter(upper.astype("<f4"), np.float32(np.inf))
                    yield pa.RecordBatch.from_arrays([*columns, batch.column("x"), _binary(up), _binary(lower)], names=[*names, "code", "x", "upper", "lower"])

    return run


def _summed(shape: tuple[int, int, int]):
    """A row a part, entry and position that a task has seen: the sum and count of its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = shape
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, code = _split(batch, parts, width), _bytes(batch.column("code"), "u1", parts)
            for p in range(parts):
                np.add.at(total[p], code[:, p], x[:, p])
                count[p] += np.bincount(code[:, p], minlength=entries)
        p, e, k = (a.ravel() for a in np.indices(shape))
        seen = count[p, e] > 0
        yield pa.RecordBatch.from_arrays([pa.array(((p * entries + e) * width + k)[seen]), pa.array(total.ravel()[seen]), pa.array(count[p, e][seen])], names=["slot", "total", "n"])

    return run


def moved(state: DataFrame, book: np.ndarray) -> np.ndarray:
    """The entries after a round: floors of the means of their parts; unused ones stay."""
    sums = state.select("x", "code").mapInArrow(_summed(book.shape), "slot long, total long, n long")
    out = book.reshape(-1).copy()
    means = sums.groupBy("slot").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    for r in means.collect():  # at most a row a component of the codebooks
        out[r["slot"]] = r["total"] // r["n"]
    return out.reshape(book.shape)


def compress(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, np.ndarray]:
    """A row a usable vector: its id, label, code (bytes, one a part) and error; and the codebooks [part, entry, position].

    Rows whose vector is null or holds a null or a number that is not finite are dropped.  So are those whose
    length is not that of the row of the smallest id; a length that parts do not divide is filled up
    with zeros.  Codebooks start as the parts of the first `entries` rows by id (nulls last), then integers; with fewer rows
    they have fewer entries.  Repeated rows count each.  Integers beyond 2**26 count as that.  Up to 256 entries.
    Other columns are left out.  An empty table gives no rows and empty codebooks.
    """
    if not 1 <= entries <= 256:
        raise ValueError("from 1 to 256 entries fit a byte")
    label = F.col(f"`{label_col}`") if label_col else F.lit(None).cast("int")
    ready = usable(rows, vec_col).select(F.col(f"`{id_col}`").alias("id"), label.alias("label"), integers(F.col(f"`{vec_col}`")).alias("x"))
    first = ready.orderBy(F.col("id").asc_nulls_last(), "x").limit(1).collect()
    dim = len(first[0]["x"]) if first else 0
    ready = ready.where(F.size("x") == dim)
    width = max(1, -(-dim // parts))
    start = [r["x"] for r in ready.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()]  # `entries` vectors
    book = np.zeros((len(start), parts * width), np.int64)
    for k, x in enumerate(start):
        book[k, :dim] = x
    book = book.reshape(len(start), parts, width).transpose(1, 0, 2).copy()
    kinds = dict(ready.dtypes)
    names, schema = ["id", "label"], f"id {kinds['id']}, label {kinds['label']}, code binary"
    out_schema = f"{schema}, error long"
    if not start:
        return rows.sparkSession.createDataFrame([], out_schema), book
    state, before = ready, None
    for k in range(rounds):
        new = stage(state.mapInArrow(_assigned(book, before, names, False), f"{schema}, x array<int>, upper binary, lower binary"), f"codes{k}")
        if k:
            drop_stage(state)
        state, before, book = new, book, moved(new, book)
    return state.mapInArrow(_assigned(book, before, names, True), out_schema), book


def label_errors(codes: DataFrame) -> DataFrame:
    """Errors summed over equal labels, nulls together."""
    return codes.groupBy("label").agg(F.sum("error").alias("label_error"))


def book_digest(book: np.ndarray) -> str:
    """SHA-256 of all entries' integers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
