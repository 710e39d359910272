"""Positioned text of pages: an interpreter of content streams, and lines of its runs.

The interpreter folds a page's operators over the graphics and text state and gives a run for every operator that
shows text.  A page is a row; pages are interpreted in Arrow batches where they lie.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, MapType, StringType, StructType

from quire.sources.locks import string_bytes
from quire.sources.structure import _TOKEN, name_text, refs_of, values

#: Width of a character without widths of its own, in ems.
WIDTH = 0.5
ONE = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)\Z")


def times(m: tuple, n: tuple) -> tuple:
    """The matrix that applies m first, then n."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return (a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


def shown(data: bytes, widths: dict[str, tuple[int, list[float]]] | None = None) -> list[tuple[str, float, float, float, float, bool]]:
    """(text, left, bottom, right, top, visible) of each run in the page's own space.

    A run's box goes from the baseline up by the font's size.  widths are, by font, the first code and the ems
    of it and those after; other codes are half an em.  Codes are read as Latin-1.
    """
    out: list[tuple[str, float, float, float, float, bool]] = []
    base = {"ctm": ONE, "size": 0.0, "font": "", "char": 0.0, "word": 0.0, "scale": 1.0, "lead": 0.0, "rise": 0.0, "mode": 0}
    state, stack, matrix, line = dict(base), [], ONE, ONE
    todo: list = []
    array: list | None = None

    def advance(tx: float) -> None:
        nonlocal matrix
        matrix = times((1, 0, 0, 1, tx, 0), matrix)

    def move(x: float, y: float) -> None:
        nonlocal matrix, line
        line = times((1, 0, 0, 1, x, y), line)
        matrix = line

    def show(parts: list) -> None:
        at, made = matrix, ""
        first, ems = (widths or {}).get(state["font"], (0, []))
        for part in parts:
            if isinstance(part, float):
                advance(-part / 1000 * state["size"] * state["scale"])
                continue
            codes = np.frombuffer(part, np.uint8).astype(int)
            em = np.full(len(codes), WIDTH)
            if len(ems):
                known = (codes >= first) & (codes < first + len(ems))
                em[known] = np.asarray(ems)[codes[known] - first]
            advance((em.sum() * state["size"] + len(codes) * state["char"] + (codes == 32).sum() * state["word"]) * state["scale"])
            made += part.decode("latin-1")
        if not made:
            return
        a, b = times(at, state["ctm"]), times(matrix, state["ctm"])
        low, high = state["rise"], state["rise"] + state["size"]
        points = [(m[2] * y + m[4], m[3] * y + m[5]) for m in (a, b) for y in (low, high)]
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        out.append((made, min(xs), min(ys), max(xs), max(ys), state["mode"] not in (3, 7)))

    it = _TOKEN.finditer(data)
    skip = 0
    for m in it:
        if m.start() < skip or m[0].startswith(b"%"):
            continue
        t = m[0]
        if t == b"[":
            array = []
        elif t == b"]":
            todo.append(array or [])
            array = None
        elif t[:1] in (b"(", b"<") and t != b"<<":
            (todo if array is None else array).append(string_bytes(t) or b"")
        elif _NUMBER.match(t):
            (todo if array is None else array).append(float(t))
        elif t.startswith(b"/"):
            todo.append(name_text(t))
        elif array is None:
            n = [x for x in todo if isinstance(x, float)]
            op = t.decode("latin-1")
            if op == "q":
                stack.append(dict(state))
            elif op == "Q":
                state = stack.pop() if stack else state
            elif op == "cm" and len(n) >= 6:
                state["ctm"] = times(tuple(n[-6:]), state["ctm"])
            elif op == "BT":
                matrix = line = ONE
            elif op == "Tf" and n:
                state["size"], state["font"] = n[-1], next((x for x in todo if isinstance(x, str)), "")
            elif op in ("Tc", "Tw", "TL", "Ts") and n:
                state[{"Tc": "char", "Tw": "word", "TL": "lead", "Ts": "rise"}[op]] = n[-1]
            elif op == "Tz" and n:
                state["scale"] = n[-1] / 100
            elif op == "Tr" and n:
                state["mode"] = int(n[-1])
            elif op in ("Td", "TD") and len(n) >= 2:
                state["lead"] = -n[-1] if op == "TD" else state["lead"]
                move(n[-2], n[-1])
            elif op == "Tm" and len(n) >= 6:
                matrix = line = tuple(n[-6:])
            elif op == "T*":
                move(0, -state["lead"])
            elif op in ("Tj", "'", '"'):
                if op == '"' and len(n) >= 2:
                    state["word"], state["char"] = n[-2:]
                if op != "Tj":
                    move(0, -state["lead"])
                show([x for x in todo if isinstance(x, bytes)][-1:])
            elif op == "TJ" and todo and isinstance(todo[-1], list):
                show(todo[-1])
            elif op == "ID":  # an inline image's bytes
                close = re.compile(rb"\sEI(?=\s|\Z)").search(data, m.end())
                skip = close.end() if close else len(data)
            todo = []
    return out


FONTS = "map<string, struct<first:int, widths:array<double>>>"
RUNS = "run int, text string, x double, y double, w double, h double, visible boolean"


def positioned_runs(pages: DataFrame, key: str, stream: str = "stream", fonts: str | None = None) -> DataFrame:
    """(key, page, run, text, x, y, w, h, visible): runs of pages, boxes in shares of the page's box.

    pages have page, the stream's plain bytes, and left, bottom, width and height of the page's box; fonts is a column
    of FONTS.  A page without a box or stream has no runs.  Forms that a page draws are not entered.
    """
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int32(), pa.string(), *[pa.float64()] * 4, pa.bool_()]
        for batch in batches:
            rows = []
            for name, page, data, left, bottom, width, height, given in zip(*(c.to_pylist() for c in batch.columns)):
                if data is None or not (width and height and width > 0 and height > 0):
                    continue
                ems = {k: (v["first"], v["widths"]) for k, v in given or [] if v}
                for k, (text, x0, y0, x1, y1, visible) in enumerate(shown(data, ems)):
                    rows.append((name, page, k, text, (x0 - left) / width, (y0 - bottom) / height, (x1 - x0) / width, (y1 - y0) / height, visible))
            columns = list(zip(*rows)) if rows else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(0).type), *(pa.array(c, t) for c, t in zip(columns[1:], types))], ["key", "page", "run", "text", "x", "y", "w", "h", "visible"])

    given = F.lit(None).cast(FONTS) if fonts is None else F.col(fonts).cast(FONTS)
    rows = pages.select(F.col(key), F.col("page").cast("long"), F.col(stream), *[F.col(c).cast("double") for c in ("left", "bottom", "width", "height")], given.alias("fonts"))
    return rows.mapInArrow(run, f"key {kind}, page long, {RUNS}").withColumnRenamed("key", key)


def text_lines(runs: DataFrame, key: str, gap: float = 0.15) -> DataFrame:
    """(key, page, line, text, x, y, w, h): runs of one baseline joined from left to right, lines from the top.

    A space stands where runs lie farther apart than `gap` of the line's height.
    """
    parts = F.sort_array(F.collect_list(F.struct("x", "run", "text", "w", "h")))
    lines = runs.groupBy(key, "page", F.round("y", 4).alias("at")).agg(parts.alias("parts"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("right"), F.max(F.col("y") + F.col("h")).alias("top"))
    height = F.col("top") - F.col("y")

    def add(acc: Column, p: Column) -> Column:
        apart = (acc["end"].isNotNull()) & (p["x"] - acc["end"] > gap * height)
        return F.struct((p["x"] + p["w"]).alias("end"), F.concat(acc["text"], F.when(apart, " ").otherwise(""), p["text"]).alias("text"))

    text = F.aggregate("parts", F.struct(F.lit(None).cast("double").alias("end"), F.lit("").alias("text")), add, lambda acc: acc["text"])
    order = F.sort_array(F.collect_list(F.struct((-F.col("y")).alias("down"), "x", "text", "y", (F.col("right") - F.col("x")).alias("w"), height.alias("h"))))
    return lines.withColumn("text", text).groupBy(key, "page").agg(order.alias("lines")).select(key, "page", F.posexplode("lines").alias("line", "l")).select(key, "page", "line", "l.text", "l.x", "l.y", "l.w", "l.h")


@F.udf(ArrayType(StructType().add("obj", LongType()).add("gen", LongType())), useArrow=True)
def _references(value: bytes | None) -> list[dict] | None:
    return None if value is None else [{"obj": n, "gen": g} for n, g in refs_of(bytes(value))]


def references(value: Column) -> Column:
    """References of a raw value: of an array's own level, or of a bare run of them."""
    return _references(value)


@F.udf(MapType(StringType(), BinaryType()), useArrow=True)
def _dictionary(value: bytes | None) -> dict | None:
    return None if value is None else values(bytes(value))


def dictionary(value: Column) -> Column:
    """Keys and raw values of a dictionary, null for anything else."""
    return _dictionary(value)


def reference(value: Column) -> Column:
    """The object that a raw value names; null for anything else."""
    number = F.regexp_extract(F.decode(value, "ISO-8859-1"), r"\A\s*(\d{1,10})\s+\d{1,5}\s+R\s*\z", 1)
    return F.when(number != "", number).cast("long")


def numbers(value: Column) -> Column:
    """The numbers of a raw array."""
    return F.transform(F.regexp_extract_all(F.decode(value, "ISO-8859-1"), F.lit(r"([+-]?(?:\d+\.?\d*|\.\d+))"), 1), lambda x: x.cast("double"))
