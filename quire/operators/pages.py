"""Pixel operators over whole pages: (id, width, and arrays of grey values or marks, row by row).

A page is one row, so nothing is shuffled: numpy works on a page at a time in Arrow batches.  The operators
of pixels.py compute the same from one row a pixel.  A value under 0 is a place without a pixel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.pixels import CHROMATIC, COLOURED, CONTRAST, DARK, ERROR, LIGHT, LOCAL_K, LOCAL_R, MODERATELY, TWO_TONE, envelope


def by_page(pages: DataFrame, inputs: list[str], outputs: dict[str, str], work: Callable[..., tuple]) -> DataFrame:
    """pages with the outputs (name: type) of work, which gets each input as a matrix; an empty page gives nulls."""
    names = [c for c in pages.columns if c not in outputs]
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        for batch in batches:
            rows = []
            for width, *values in zip(batch.column("width").to_pylist(), *(batch.column(c) for c in inputs)):
                arrays = [None if v.as_py() is None else v.values.to_numpy(zero_copy_only=False) for v in values]
                good = width and all(a is not None and len(a) for a in arrays)
                rows.append([np.asarray(x).ravel() if np.ndim(x) else x for x in work(*(a.reshape(-1, width) for a in arrays))] if good else [None] * len(outputs))
            types = types or [pa.list_(_ARROW[t[6:-1]]) if t.startswith("array<") else _ARROW[t] for t in outputs.values()]
            made = [pa.array(list(column), t) for column, t in zip(zip(*rows) if rows else [[]] * len(outputs), types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], [*names, *outputs])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), *(f"`{c}` {t}" for c, t in outputs.items())])
    return pages.select(*names).mapInArrow(run, schema)


_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def box_sum(a: np.ndarray, half: int, there: np.ndarray | None = None) -> np.ndarray:
    """Sums over the square of each pixel, clipped at the edges, from running sums: along rows, then down columns.

    Down a column only the places that are `there` count, with what lies beside them.
    """
    out = a.astype(np.int64)
    for axis in (1, 0):
        size = a.shape[axis]
        total = np.cumsum(np.concatenate([np.zeros_like(out.take([0], axis)), out], axis), axis)
        low, high = np.maximum(0, np.arange(size) - half), np.minimum(size, np.arange(size) + half + 1)
        out = total.take(high, axis) - total.take(low, axis)
        if axis == 1 and there is not None:
            out = np.where(there, out, 0)
    return out


def box_max(a: np.ndarray, half: int) -> np.ndarray:
    out = a
    for axis in (0, 1):
        wide = out
        for k in range(1, min(half, a.shape[axis] - 1) + 1):
            low, high = [slice(None)] * 2, [slice(None)] * 2
            low[axis], high[axis] = slice(k, None), slice(None, -k)
            wide = wide.copy()
            wide[tuple(high)] = np.maximum(wide[tuple(high)], out[tuple(low)])
            wide[tuple(low)] = np.maximum(wide[tuple(low)], out[tuple(high)])
        out = wide
    return out


def local_ink(pages: DataFrame, value: str, half: int = 15) -> DataFrame:
    """pages with n, s and sq (pixels, sums and squares of each pixel's surroundings) and ink, darker than those."""

    def work(v: np.ndarray) -> tuple:
        there = v >= 0
        v = np.where(there, v, 0)
        n, s, sq = box_sum(there, half, there), box_sum(v, half, there), box_sum(v.astype(np.int64) ** 2, half, there)
        mean = s / np.maximum(1, n)
        spread = np.sqrt(np.maximum(0.0, sq / np.maximum(1, n) - mean * mean))
        return n, s, sq, there & (v < mean * (1 + LOCAL_K * (spread / LOCAL_R - 1)))

    return by_page(pages, [value], {"n": "array<long>", "s": "array<long>", "sq": "array<long>", "ink": "array<boolean>"}, work)


def dilated(pages: DataFrame, mark: str, result: str, half: int = 2) -> DataFrame:
    """pages with the marks of 0 and 1 grown by half pixels in all directions."""
    return by_page(pages, [mark], {result: "array<int>"}, lambda m: (box_max(m, half),))


def masked_error(pages: DataFrame, candidate: str, original: str, region: str) -> DataFrame:
    """pages with n, error and passes: see pixels.masked_error()."""

    def work(b: np.ndarray, a: np.ndarray, m: np.ndarray) -> tuple:
        a, b = a[m == 1].astype(np.int64), b[m == 1].astype(np.int64)
        if not len(a):
            return 0, 0.0, True
        mean = int(a.sum()) / len(a)
        contrast = max(0.0, int((a * a).sum()) / len(a) - mean * mean) ** 0.5
        error = 0.0 if contrast < CONTRAST else int(np.abs(a - b).sum()) / len(a) / contrast
        return len(a), error, error <= ERROR

    out = by_page(pages, [candidate, original, region], {"n": "long", "error": "double", "passes": "boolean"}, work)
    return out.withColumn("error", F.round("error", 6))


def composite(pages: DataFrame, mask: str, front: str, back: str, result: str) -> DataFrame:
    """pages with the front's values where the mask is set, else the back's."""
    return by_page(pages, [mask, front, back], {result: "array<int>"}, lambda m, f, b: (np.where(m == 1, f, b),))


def otsu(v: np.ndarray) -> int:
    """The middle of the first and the last grey of greatest variance between classes; 127 where one would be empty at every grey."""
    n = np.bincount(v[v >= 0].ravel(), minlength=256)
    w0, s0 = np.cumsum(n), np.cumsum(n * np.arange(256)).astype(np.float64)
    at = np.flatnonzero((w0 > 0) & (w0 < w0[-1]))
    if not len(at):
        return 127
    low, high = w0[at].astype(np.float64), (w0[-1] - w0[at]).astype(np.float64)
    d = s0[at] / low - (s0[-1] - s0[at]) / high
    variance = low * high * d * d
    best = at[variance == variance.max()]
    return int(best[0] + best[-1]) // 2


def thresholds(pages: DataFrame, value: str) -> DataFrame:
    """pages with threshold: see otsu()."""
    return by_page(pages, [value], {"threshold": "int"}, lambda v: (otsu(v),))


def ink_counts(pages: DataFrame, value: str) -> DataFrame:
    """pages with threshold, n and ink: pixels darker than the page's threshold, of all."""

    def work(v: np.ndarray) -> tuple:
        limit = otsu(v)
        return limit, int((v >= 0).sum()), int(((v >= 0) & (v < limit)).sum())

    return by_page(pages, [value], {"threshold": "int", "n": "long", "ink": "long"}, work)


def statistics(pages: DataFrame, value: str, chroma: str | None = None) -> DataFrame:
    """pages with sampled, extremes, chromatic and near_bilevel: see pixels.statistics()."""

    def work(v: np.ndarray, c: np.ndarray | None = None) -> tuple:
        there = v >= 0
        return int(there.sum()), int((there & ((v <= DARK) | (v >= LIGHT))).sum()), int((there & (c > 25)).sum()) if c is not None else 0

    out = by_page(pages, [value, *([chroma] if chroma else [])], {"sampled": "long", "extremes": "long", "chromatic": "long"}, work)
    return out.withColumn("near_bilevel", (F.col("extremes") / F.col("sampled") > TWO_TONE) & (F.col("chromatic") / F.col("sampled") <= CHROMATIC))


def ink_ratio(pages: DataFrame, value: str, light: int = 245) -> DataFrame:
    """pages with n and ink: pixels under `light` on a grid of about 6,000 pixels."""

    def work(v: np.ndarray) -> tuple:
        step = max(1, int((v.size / 6000) ** 0.5))
        grid = v[::step, ::step]
        return int((grid >= 0).sum()), int(((grid >= 0) & (grid < light)).sum())

    return by_page(pages, [value], {"n": "long", "ink": "long"}, work)


def packed_bits(pages: DataFrame, value: str, limit: int = 128) -> DataFrame:
    """pages with bits and bits_width: eight pixels a byte, the first in the highest bit, ink as 0, rows filled with ones."""

    def work(v: np.ndarray) -> tuple:
        white = np.pad(v >= limit, ((0, 0), (0, -v.shape[1] % 8)), constant_values=True)
        packed = np.packbits(white, axis=1).astype(np.int32)
        return packed, packed.shape[1]

    return by_page(pages, [value], {"bits": "array<int>", "bits_width": "int"}, work)


def regions(ink: np.ndarray, least: int = 3) -> np.ndarray:
    """Sizes of the 8-connected regions of `least` pixels or more.

    Runs of ink in a row are the nodes, runs that touch in the next row the edges; labels are hooked and jumped over, so the
    rounds grow with the logarithm of a region's height.
    """
    wide = ink.shape[1] + 2
    flat = np.pad(ink, ((0, 0), (1, 1))).ravel()
    edge = np.diff(flat.astype(np.int8), prepend=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    size = last - first + 1
    low, high = np.searchsorted(last, first + wide - 1), np.searchsorted(first, last + wide + 1, "right")
    n = np.maximum(0, high - low)
    a, b = np.repeat(np.arange(len(first)), n), np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
    label = np.arange(len(first))
    while True:
        near = np.minimum(label[a], label[b])
        new = label.copy()
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, near)
        new = new[new]
        if (new == label).all():
            break
        label = new
    area = np.bincount(label, size).astype(np.int64) if len(first) else np.zeros(0, np.int64)
    return area[area >= least]


def features(pages: DataFrame, r: str, g: str, b: str) -> DataFrame:
    """pages with the features of pixels.page_features() and their verdict (null: a page of text)."""

    def work(r_: np.ndarray, g_: np.ndarray, b_: np.ndarray) -> tuple:
        there = r_ >= 0
        v = np.where(there, (r_ * 299 + g_ * 587 + b_ * 114) // 1000, -1)
        c = np.where(there, np.maximum(np.maximum(r_, g_), b_) - np.minimum(np.minimum(r_, g_), b_), 0)
        limit = otsu(v)
        ink = there & (v < limit)
        area = regions(ink)
        return limit, int(there.sum()), int(ink.sum()), int((c > COLOURED).sum()), int((c > MODERATELY).sum()), len(area), float(area.mean()) if len(area) else 0.0

    out = by_page(pages, [r, g, b], {"threshold": "int", "n": "long", "ink": "long", "coloured": "long", "moderate": "long", "components": "long", "mean_area": "double"}, work)
    share = lambda c: F.col(c) / F.col("n")
    return out.withColumn("verdict", envelope(share("ink"), share("coloured"), F.col("mean_area"), F.col("components"), share("moderate")))


def long_form(pages: DataFrame, *values: str) -> DataFrame:
    """(id, x, y, ...): a row a pixel."""
    out = pages.select("id", "width", F.posexplode(F.arrays_zip(*values)).alias("pos", "p"))
    return out.select("id", (F.col("pos") % F.col("width")).alias("x"), F.floor(F.col("pos") / F.col("width")).cast("int").alias("y"), *(f"p.{v}" for v in values))

