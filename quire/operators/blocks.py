"""Block means of whole pages, spread over the blocks that have no pixel of the wanted kind."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.pages import by_page

#: The grey of a page without any wanted pixel.
MIDDLE = 128.0


def block_means(values: np.ndarray, wanted: np.ndarray, factor: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the wanted pixels of each block (0 where there are none), and whether there are any."""
    height, width = values.shape
    rows, columns = np.arange(0, height, factor), np.arange(0, width, factor)
    add = lambda a: np.add.reduceat(np.add.reduceat(a, rows, 0), columns, 1)
    n, s = add(wanted.astype(np.int64)), add(np.where(wanted, values, 0).astype(np.float64))
    return np.divide(s, n, out=np.zeros(n.shape), where=n > 0), n > 0


def spread(means: np.ndarray, known: np.ndarray) -> np.ndarray:
    """means with the unknown blocks filled, from the known ones outwards.

    Rounds go over the unknown blocks row by row; a block with known neighbours (of eight) takes their mean and is
    known from then on, in the same round too.  Blocks that nothing reaches take the mean of all known ones.

    Of the neighbours before a block in row order all have a smaller x + 2 y, and those behind it a larger one.  So a
    round is a sweep over x + 2 y with whole arrays, and only blocks that a newly known one touches
    are looked at: the work is linear in the blocks.
    """
    height, width = means.shape
    wide = width + 2
    colour, done, queued = np.zeros((height + 2) * wide), np.zeros((height + 2) * wide, bool), np.zeros((height + 2) * wide, bool)
    inner = (np.arange(1, height + 1)[:, None] * wide + np.arange(1, width + 1)).ravel()
    colour[inner], done[inner] = means.ravel(), known.ravel()
    inside = np.zeros(len(done), bool)
    inside[inner] = True
    before, behind = np.array([-wide - 1, -wide, -wide + 1, -1]), np.array([1, wide - 1, wide, wide + 1])
    around = np.concatenate([before, behind])
    turn = lambda at: at % wide + 2 * (at // wide)

    def open_near(at: np.ndarray, steps: np.ndarray) -> np.ndarray:
        near = np.unique((at[:, None] + steps).ravel())
        near = near[inside[near] & ~done[near] & ~queued[near]]
        queued[near] = True
        return near

    todo = open_near(np.flatnonzero(done), around)
    while len(todo):
        waves: dict[int, list[np.ndarray]] = {}

        def put(at: np.ndarray, waves: dict = waves) -> None:
            order = np.argsort(turn(at), kind="stable")
            at = at[order]
            cuts = np.flatnonzero(np.diff(turn(at))) + 1
            for part in np.split(at, cuts):
                if len(part):
                    waves.setdefault(int(turn(part[:1])[0]), []).append(part)

        put(todo)
        later, wave = [], min(waves)
        while waves:
            if wave in waves:
                at = np.concatenate(waves.pop(wave))
                total, n = np.zeros(len(at)), np.zeros(len(at), np.int64)
                for step in around:  # the sum in this order
                    there = done[at + step]
                    total = np.where(there, total + colour[at + step], total)
                    n += there
                colour[at], queued[at] = total / n, False
                done[at] = True
                put(open_near(at, behind))
                later.append(open_near(at, before))
            wave += 1
        todo = np.concatenate(later)
    out = colour[inner]
    known_now = done[inner]
    if not known_now.all():
        out[~known_now] = np.add.accumulate(out[known_now])[-1] / known_now.sum() if known_now.any() else MIDDLE
    return out.reshape(height, width)


def spread_blocks(pages: DataFrame, channels: list[str], mark: str, factor: int, flat: bool = False) -> DataFrame:
    """pages with, for each channel c, c_blocks: whole numbers of the blocks of factor x factor pixels, row by row; and block_width.

    A block has the mean of its pixels whose mark is 1, else what spreads to it from blocks that have some;
    with `flat` it has the mean of all blocks that have some.  A page without marks is middle grey.  Means are
    rounded half up.  A null or empty page has nulls.
    """

    def work(m: np.ndarray, *values: np.ndarray) -> tuple:
        out = []
        for v in values:
            means, known = block_means(v, m == 1, factor)
            if flat:
                means[~known] = np.add.accumulate(means[known])[-1] / known.sum() if known.any() else MIDDLE
            else:
                means = spread(means, known)
            out.append(np.floor(means + 0.5).astype(np.int32))
        return (*out, np.int32(-(-m.shape[1] // factor)))

    return by_page(pages, [mark, *channels], {f"{c}_blocks": "array<int>" for c in channels} | {"block_width": "int"}, work)


def long_blocks(pages: DataFrame, blocks: str, width: str = "block_width") -> DataFrame:
    """(id, block_x, block_y, v): a row a block."""
    rows = pages.select("id", F.col(width).alias("w"), F.posexplode(blocks).alias("k", "v"))
    return rows.select("id", (F.col("k") % F.col("w")).alias("block_x"), F.floor(F.col("k") / F.col("w")).cast("int").alias("block_y"), "v")
