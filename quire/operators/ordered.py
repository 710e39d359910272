"""Computations whose result depends on order: running maxima, estimates of time, sections and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.scans import CHUNK, carried, chunked, folded, within
from quire.plans.staging import stage


def _before(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def monotone(rows: DataFrame, keys: list[str], order: list[str], value: str, floor: float = 0.0) -> DataFrame:
    """Rows whose value is strictly above all values before, and above the floor.  A key may hold any share of all rows."""
    chunks = carried(chunked(rows, keys, order), keys, F.max(value), "max", "__before")
    best = F.coalesce(F.greatest("__before", F.max(value).over(within(keys, order))), F.lit(floor))
    return chunks.withColumn("__best", best).where(F.col(value) > F.col("__best")).select(*rows.columns)


def page_markers(rows: DataFrame, keys: list[str], order: list[str], line: str) -> DataFrame:
    """Lines 'Page N' whose N is strictly above those before."""
    n = F.regexp_extract(line, r"^\s*Page\s+([0-9]+)\s*$", 1).try_cast("long")
    return monotone(rows.withColumn("page", n).where("page IS NOT NULL"), keys, order, "page")


def leg_eta(fraction: Column, elapsed: Column) -> Column:
    """Seconds that remain at the speed so far, from a tenth on."""
    left = F.round((1 - fraction) / (fraction / elapsed)).cast("long")
    return F.when((fraction >= 0.1) & (elapsed > 0), F.greatest(F.lit(0).cast("long"), left))


def composed_span(composed: Column, start: Column, width: Column) -> Column:
    """The part of a leg that is done, 0 to 1; null for a leg without width."""
    return F.when(width > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (composed - start) / width)))


NEWEST = 0.3


def _rates(keys: list[str], columns: list[str]):
    """Sorted ticks of ranges with i (their number among the key's valid ones), the first valid reading and the rate so far."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        held = None  # the key and range at hand, its valid ticks so far, first reading and rate
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            own = list(zip(*(batch.column(k).to_pylist() for k in (*keys, CHUNK))))
            begin = np.flatnonzero([True, *(a != b for a, b in zip(own, own[1:]))])
            part = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, n]))
            f, t = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("fraction", "elapsed"))
            with np.errstate(invalid="ignore", divide="ignore"):
                valid = (f >= 0.1) & (t > 0)
                x = np.where(valid, f / t, 0.0)
            at = np.flatnonzero(valid)
            size = np.bincount(part[at], minlength=len(begin))
            first = np.cumsum(size) - size
            i, head, rate = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            before, start, last = np.zeros(len(begin), np.int64), np.zeros(len(begin)), np.zeros(len(begin))
            if held is not None and held[0] == own[0]:
                before[0], start[0], last[0] = held[1:]
            some = np.flatnonzero((size > 0) & (before == 0))
            start[some] = x[at[first[some]]]
            order = np.argsort(-size, kind="stable")
            now, live = last.copy(), np.searchsorted(-size[order], -np.arange(1, size.max(initial=0) + 1), "right")
            for k, m in enumerate(live):  # the k-th valid tick of all keys that have so many
                key = order[:m]
                place = at[first[key] + k]
                fresh = before[key] + k == 0
                now[key] = np.where(fresh, x[place], NEWEST * x[place] + (1 - NEWEST) * now[key])
                rate[place], i[place], head[place] = now[key], before[key] + k + 1, start[key]
            held = (own[-1], int(before[-1] + size[-1]), start[-1], now[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(valid), pa.array(i), pa.array(head), pa.array(rate)], [*columns, "valid", "i", "head", "rate"])

    return run


def smoothed_eta(ticks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per tick (fraction, elapsed): the smoothed estimate eta, which does not rise.

    Repeats of a fraction are dropped first.  The rate weighs the newest reading 0.3; below a tenth
    there is no estimate and the next one starts anew.  A key may hold any share of all ticks: ranges are smoothed
    apart, as if nothing came before; a rate r before a range adds 0.7 ** i * (r - first reading) to its i-th rate.
    """
    columns = [*keys, order, "fraction", "elapsed", CHUNK]
    chunks = chunked(ticks.select(*keys, order, F.col("fraction").cast("double"), F.col("elapsed").cast("double")), keys, [order])
    chunks = carried(chunks, keys, F.max_by("fraction", order), "last", "__before")
    w = Window.partitionBy(*keys, CHUNK).orderBy(order)
    last = F.when(F.row_number().over(w) == 1, F.col("__before")).otherwise(F.lag("fraction").over(w))
    fresh = chunks.withColumn("__last", last).where(F.col("__last").isNull() | (F.col("__last") != F.col("fraction"))).select(*columns)
    kinds = dict(fresh.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "valid boolean", "i long", "head double", "rate double"])
    rated = stage(fresh.repartition(*keys, CHUNK).sortWithinPartitions(*keys, CHUNK, order).mapInArrow(_rates(keys, columns), schema), "rates")
    parts = rated.where("valid").groupBy(*keys, CHUNK).agg(F.max("i").alias("n"), F.max("head").alias("head"), F.max_by("rate", "i").alias("rate"))
    slow = lambda n, r, head: F.pow(F.lit(1 - NEWEST), n) * (r - head)
    step = lambda r, p: p["rate"] + F.coalesce(slow(p["n"], r, p["head"]), F.lit(0.0))
    rated = folded(rated, keys, parts, F.lit(None).cast("double"), step, "__rate")
    rate = F.col("rate") + F.coalesce(slow(F.col("i"), F.col("__rate"), F.col("head")), F.lit(0.0))
    left = F.when(F.col("valid"), F.floor(F.greatest(F.lit(0.0), 1 - F.col("fraction")) / rate + 0.5))
    resets = F.count_if(~F.col("valid")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    told = stage(rated.withColumns({"left": left, "resets": resets}).select(*keys, order, CHUNK, "valid", "left", "resets"), "left")
    tails = told.groupBy(*keys, CHUNK, "resets").agg(F.min("left").alias("tail")).groupBy(*keys, CHUNK).agg(F.max("resets").alias("resets"), F.max_by("tail", "resets").alias("tail"))
    lower = lambda m, p: F.when(p["resets"] > 0, p["tail"]).otherwise(F.least(m, p["tail"]))
    told = folded(told, keys, tails, F.lit(None).cast("long"), lower, "__least")
    own = F.min("left").over(Window.partitionBy(*keys, CHUNK, "resets").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    eta = F.when(F.col("valid"), F.when(F.col("resets") == 0, F.least(own, F.col("__least"))).otherwise(own))
    return told.select(*keys, order, eta.cast("long").alias("eta"))


def object_numbers(rows: DataFrame, keys: list[str], order: list[str], count: str, start: int = 3) -> DataFrame:
    """The first object number of each page when pages take `count` numbers each."""
    return rows.withColumn("first_object", F.lit(start) + F.coalesce(F.sum(count).over(_before(keys, order)), F.lit(0)))


def sections(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Runs of consecutive distinct numbers: first and size.  One sort of the rows by keys and number; no table of groups is held."""
    n, w = F.col(number), Window.partitionBy(*keys).orderBy(number)
    before, after = F.lag(number).over(w), F.lead(number).over(w)
    first = F.when(n.isNull(), F.row_number().over(w) == 1).otherwise(before.isNull() | (n > before + 1))
    last = n.isNull() | after.isNull() | (after > n + 1)
    ends = rows.select(*keys, number, first.alias("__first"), last.alias("__last")).where("__first OR __last")
    # a run's last row follows its first one, or comes in any order with it if both hold the same number
    end = F.when(F.col("__last") | F.coalesce(F.lead("__first").over(w), F.lit(True)), n).otherwise(F.lead(number).over(w))
    runs = ends.withColumn("__end", end).where("__first")
    return runs.select(*keys, n.alias("first_number"), F.coalesce((F.col("__end") - n).cast("long") + 1, F.lit(1).cast("long")).alias("size"))


def extents(rows: DataFrame, keys: list[str], offset: str, length: Column) -> DataFrame:
    """Each part ends where the next begins, the last at the buffer's end."""
    w = Window.partitionBy(*keys).orderBy(offset)
    return rows.withColumn("end_offset", F.coalesce(F.lead(offset).over(w), length))


def row_duration(ticks: DataFrame, key: str, time: str, kind: str, done: str) -> DataFrame:
    """Seconds from a row's first tick to its first terminal one."""
    return ticks.groupBy(key).agg(
        (F.min(F.when(F.col(kind) == done, F.unix_micros(F.col(time).cast("timestamp")))) - F.min(F.unix_micros(F.col(time).cast("timestamp")))).alias("micros")
    ).where("micros IS NOT NULL")


def accepted_ticks(ticks: DataFrame, key: str, order: str, end: Column) -> DataFrame:
    """Ticks up to a row's first terminal tick: later ones never reopen it."""
    ends = ticks.where(end).groupBy(F.col(key).alias("__key")).agg(F.min(order).alias("__end"))
    both = ticks.join(ends, F.col(key).eqNullSafe(F.col("__key")), "left")
    return both.where(F.col("__end").isNull() | (F.col(order) <= F.col("__end"))).select(*ticks.columns)


def first_outcomes(ticks: DataFrame, key: str, order: str, end: Column) -> DataFrame:
    """Each row's first terminal tick, taken in once."""
    values = F.struct(*[F.col(c) for c in ticks.columns])
    return ticks.where(end).groupBy(key).agg(F.min_by(values, order).alias("__v")).select("__v.*")


def page_sample(n: Column, k: Column) -> Column:
    """First and last page and the first k - 2 multiples of n div k between; all pages if k reaches n."""
    step = F.greatest(F.lit(1).cast("long"), F.floor(n / k))
    middle = F.slice(F.filter(F.sequence(step, F.greatest(step, n - 1), step), lambda x: (x != n - 1) & (x < n)), F.lit(1), F.greatest(F.lit(0), (k - 2).cast("int")))
    none = F.array().cast("array<bigint>")
    return (
        F.when((n <= 0) | (k <= 0), none).when(k >= n, F.sequence(F.lit(0).cast("long"), n - 1))
        .when(k == 1, F.array(F.lit(0).cast("long")))
        .otherwise(F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long"), n - 1), middle))))
    )
