"""Intermediate tables in the folder that the whole cluster shares.

A staged table cuts lineage: what reads it needs no executor that made it.  Its sizes are known to
adaptive execution, and a join of a staged table has an exchange on either side, so that a skewed
key is split at run time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local session without one gets its own."""
    found = spark.conf.get(SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
        found = f"file:///tmp/checkpoints/{uuid.uuid4().hex}"
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"
    for made in _SCOPES.get():
        made.append(path)
    return path


_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def staged(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all tables staged inside: results that read them must have been written by then."""
    made: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), made))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for path in made:
            _delete(spark, path)


def kept(df: DataFrame) -> DataFrame:
    """A staged table that outlives the scope around it; a scope further out still ends it."""
    own = {f"{b}/quire/{r.split('/')[0]}" for b, _, r in (f.rpartition("/quire/") for f in df.inputFiles())}
    tail = {x.rpartition("/quire/")[2] for x in own}
    for made in _SCOPES.get()[-1:]:
        made[:] = [x for x in made if x.rpartition("/quire/")[2] not in tail]
    return df


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stage(df: DataFrame, name: str, *parts: str, plain: tuple[str, ...] = ()) -> DataFrame:
    """Writes df as Parquet into the shared folder, by parts if some are named, and returns the table read back.

    Columns in plain are written without a dictionary of their values.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    out = df.write.options(**{f"parquet.enable.dictionary#{c}": "false" for c in plain})
    (out.partitionBy(*parts) if parts else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_rows(df: DataFrame, name: str) -> DataFrame:
    """stage(), for tables with rows of every file: no join broadcasts them.

    Their files take a hundredth of what the rows take in memory, as files resemble each other, so that by their size
    Spark would hold copies of tables that grow with the data in every task.
    """
    return stage(df, name).hint("merge")


def drop_stage(df: DataFrame) -> None:
    """Deletes a staged table that nothing will read again."""
    for base, rest in {(b, r.split("/")[0]) for b, _, r in (f.rpartition("/quire/") for f in df.inputFiles()) if b}:
        _delete(df.sparkSession, f"{base}/quire/{rest}")
