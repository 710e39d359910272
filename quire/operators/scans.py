"""Running values of keys of any size: ranges of (key, order) are scanned apart, then each gets what came before it.

A range is what a task has after a shuffle by ranges, so the rows of a hot key lie in many.  What a range needs of
the ones before is one value, and only for the key that it begins in the middle of: at most a row a range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.plans.staging import stage

CHUNK = "__chunk"


def chunked(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows, staged, with the number of the range that each lies in; numbers rise with (keys, order)."""
    dealt = rows.repartitionByRange(*keys, *order)
    return stage(dealt.withColumn(CHUNK, F.spark_partition_id()), "ranges")


def carried(chunks: DataFrame, keys: list[str], value: Column, over: str, name: str) -> DataFrame:
    """chunks with `name`: max, min, sum or last (`over`) of an aggregate of the key's earlier ranges; null in its first range."""
    fold = {"max": F.max, "min": F.min, "sum": F.sum, "last": F.last}[over]
    own = chunks.groupBy(*keys, CHUNK).agg(value.alias("__own"))
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return joined(chunks, keys, own.withColumn(name, fold("__own").over(before)).where(F.col(name).isNotNull()), name)


def folded(chunks: DataFrame, keys: list[str], parts: DataFrame, start: Column, step: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """chunks with `name`: what a step makes of a start and the parts (a row a key and range) of the key's earlier ranges."""
    fields = [c for c in parts.columns if c not in keys and c != CHUNK]
    lists = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(CHUNK, *fields))).alias("parts")).where(F.size("parts") > 1)  # at most a part a range
    kind = f"array<struct<chunk:int,value:{parts.select(start.alias('x')).dtypes[0][1]}>>"

    def add(acc: Column, part: Column) -> Column:
        out = F.array_append(acc["out"], F.struct(part[CHUNK].alias("chunk"), acc["value"].alias("value")))
        return F.struct(step(acc["value"], part).alias("value"), out.alias("out"))

    told = F.aggregate("parts", F.struct(start.alias("value"), F.array().cast(kind).alias("out")), add, lambda acc: acc["out"])
    carry = lists.select(*keys, F.explode(told).alias("p")).select(*keys, F.col("p.chunk").alias(CHUNK), F.col("p.value").alias(name))
    return joined(chunks, keys, carry.where(F.col(name).isNotNull()), name)


def joined(chunks: DataFrame, keys: list[str], carry: DataFrame, name: str) -> DataFrame:
    """chunks with a column of carry (keys, range, name), null where it has no row."""
    carry = carry.select(*(F.col(k).alias(f"__of_{k}") for k in keys), F.col(CHUNK).alias("__of"), name)
    same = F.col(CHUNK) == F.col("__of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    carry = F.broadcast(stage(carry, "carried"))  # at most a row a range: its first key
    return chunks.join(carry, same, "left").drop("__of", *(f"__of_{k}" for k in keys))


def within(keys: list[str], order: list[str]) -> Window:
    """The rows before, of the key and of the range."""
    return Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
