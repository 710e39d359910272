"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(ident: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(ident.cast("string").cast("binary")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, most_bytes: int = 16 << 20) -> tuple[list[str], list[int], float]:
    """Texts and labels of at most per_class labelled rows of each class, and the share of ones.

    Rows of bucket 0 of the folds are held out.  The rows of smallest id hash are taken, so the sample
    does not depend on the layout of the tables, and its size does not grow with them: all of it must fit into the
    driver.  A class's rows end with the one that brings their texts to most_bytes, whatever its length.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (bucket(F.col(id_col), folds) != 0))
        .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    )
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect() if r["label"] in (0, 1)}
    taken = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(per_class)
        taken = part if taken is None else taken.unionByName(part)
    rows = (
        docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
        .join(F.broadcast(taken), "id")  # at most 2 * per_class ids
        .groupBy("id", "label").agg(F.min("text").alias("text"))
    )
    before = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, -1)  # of at most per_class rows
    rows = rows.withColumn("before", F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(before), F.lit(0)))
    rows = rows.where(F.col("before") < most_bytes).drop("before").orderBy("id").limit(2 * per_class).collect()
    total = sum(counts.values())
    return [r["text"] or "" for r in rows], [r["label"] for r in rows], counts.get(1, 0) / total if total else 0.5


def released(value=None):
    """The value, after memory that a fit on the driver, or a chunk of texts in a task, no longer uses went back to the system."""
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)
    pa.default_memory_pool().release_unused()
    return value
