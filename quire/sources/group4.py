"""Two-dimensional run coding (Group 4) of black and white pages.

A row's codes depend on its own changes of colour and on those of the row above, both known beforehand, so all
rows of a page are coded at once: each step looks up the next changes of every unfinished row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the coding: modes, runs of 0 to 63 of white and of black, and of multiples of 64.
PASS, HORIZONTAL, END = "0001", "001", "000000000001000000000001"
VERTICAL = {0: "1", 1: "011", 2: "000011", 3: "0000011", -1: "010", -2: "000010", -3: "0000010"}
WHITE = (
    "00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 "
    "101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 "
    "00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 "
    "00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100"
).split()
BLACK = (
    "0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 "
    "0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001 "
    "000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 "
    "000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111"
).split()
WHITE_64 = (
    "11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 "
    "011010100 011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011"
).split()
BLACK_64 = (
    "0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 "
    "0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101"
).split()
BOTH_64 = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111".split()
LONGEST = 2560


def _numbers(codes: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([int(c, 2) for c in codes], np.int64), np.array([len(c) for c in codes], np.int64)


_SHORT = [_numbers(WHITE), _numbers(BLACK)]
_LONG = [_numbers([*WHITE_64, *BOTH_64]), _numbers([*BLACK_64, *BOTH_64])]
_UPRIGHT = _numbers([VERTICAL[k] for k in range(-3, 4)])


class _Changes:
    """Places where the colour of a row changes, of all rows in one sorted array."""

    def __init__(self, black: np.ndarray):
        height, self.width = black.shape
        before = np.zeros((height, 1), bool)
        row, at = np.nonzero(black != np.concatenate([before, black[:, :-1]], 1))
        self.span = self.width + 2
        self.keys = row * self.span + at
        self.first = np.searchsorted(self.keys, np.arange(height + 1) * self.span)

    def after(self, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Index of the first change behind `at` in a row, or of the next row's first."""
        return np.searchsorted(self.keys, row * self.span + at, "right")

    def place(self, row: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Where a change is; the row's width past its last one."""
        there = index < self.first[row + 1]
        return np.where(there, self.keys[np.minimum(index, len(self.keys) - 1)] - row * self.span if len(self.keys) else 0, self.width)


def coded(black: np.ndarray) -> bytes:
    """The bytes of a page of booleans, closed by the end of block and filled up to a byte."""
    height, width = black.shape
    own, above = _Changes(black), _Changes(np.concatenate([np.zeros((1, width), bool), black[:-1]]))
    row = np.arange(height)
    at, colour = np.full(height, -1), np.zeros(height, np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    turn = 0

    def put(rows: np.ndarray, value: np.ndarray, size: np.ndarray) -> None:
        nonlocal turn
        if len(rows):
            out.append((rows, np.full(len(rows), turn), np.broadcast_to(value, rows.shape), np.broadcast_to(size, rows.shape)))
        turn += 1

    def run(rows: np.ndarray, length: np.ndarray, kinds: np.ndarray) -> None:
        length = length.copy()
        while (more := length >= LONGEST + 64).any():
            put(rows[more], _LONG[0][0][LONGEST // 64 - 1], _LONG[0][1][LONGEST // 64 - 1])
            length[more] -= LONGEST
        for kind in (0, 1):
            big = (kinds == kind) & (length >= 64)
            part = length[big] // 64 - 1
            put(rows[big], _LONG[kind][0][part], _LONG[kind][1][part])
        for kind in (0, 1):
            mine = kinds == kind
            rest = length[mine] % 64
            put(rows[mine], _SHORT[kind][0][rest], _SHORT[kind][1][rest])

    while len(row):
        k = own.after(row, at)
        a1, a2 = own.place(row, k), own.place(row, k + 1)
        j = above.after(row, at)
        j += (j - above.first[row]) % 2 != colour
        b1, b2 = above.place(row, j), above.place(row, j + 1)
        passing, near = b2 < a1, np.abs(a1 - b1) <= 3
        upright, across = ~passing & near, ~passing & ~near
        put(row[passing], int(PASS, 2), len(PASS))
        shift = (a1 - b1)[upright] + 3
        put(row[upright], _UPRIGHT[0][shift], _UPRIGHT[1][shift])
        put(row[across], int(HORIZONTAL, 2), len(HORIZONTAL))
        run(row[across], (a1 - np.maximum(at, 0))[across], colour[across])
        run(row[across], (a2 - a1)[across], 1 - colour[across])
        at = np.where(passing, b2, np.where(upright, a1, a2))
        colour = np.where(upright, 1 - colour, colour)
        left = at < width
        row, at, colour = row[left], at[left], colour[left]
    rows, turns, value, size = (np.concatenate(c) for c in zip(*out)) if out else [np.zeros(0, np.int64)] * 4
    order = np.lexsort((turns, rows))
    value, size = np.r_[value[order], int(END, 2)], np.r_[size[order], len(END)]
    which = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    return np.packbits((value[which] >> (size[which] - 1 - place)) & 1).tobytes()


def group4(pages: DataFrame, mark: str, result: str = "coded") -> DataFrame:
    """pages with the coded bytes of their marks (1 is black), which are row by row over `width`; null for a null or empty page."""
    names, kinds = [c for c in pages.columns if c != result], dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for width, marks in zip(batch.column("width").to_pylist(), batch.column(mark)):
                a = marks.values.to_numpy(zero_copy_only=False) if marks.as_py() is not None else None
                made.append(coded(a.reshape(-1, width) == 1) if width and a is not None and len(a) else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(made, pa.binary())], [*names, result])

    return pages.select(*names).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), f"`{result}` binary"]))


def image(width: Column, height: Column, data: Column) -> Column:
    """A coded page as an image of composed(): struct(dict, data, mask)."""
    text = F.concat(
        F.lit("/Width "), width.cast("string"), F.lit(" /Height "), height.cast("string"), F.lit(" /ColorSpace /DeviceGray /BitsPerComponent 1 /Filter /CCITTFaxDecode /DecodeParms << /K -1 /Columns "),
        width.cast("string"), F.lit(" /Rows "), height.cast("string"), F.lit(" /BlackIs1 false >>"))
    return F.struct(text.alias("dict"), data.alias("data"), F.lit(None).cast("int").alias("mask"))
