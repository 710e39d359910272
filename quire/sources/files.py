"""Files: admission, a light look inside, digests and byte sinks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.structure import scan


def admitted(rows: DataFrame, path: str = "path", extension: str = "pdf") -> DataFrame:
    """Rows whose path ends in the extension, in any case; repeats stay."""
    return rows.where(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)) == extension)


def read_files(spark: SparkSession, folder: str, extension: str = "pdf") -> DataFrame:
    return admitted(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder), extension=extension)


def inspected(files: DataFrame, content: str = "content") -> DataFrame:
    """files with status (ok, encrypted, corrupt, noPages) and page_count, from the bytes alone.

    A first look: it counts page objects at the top level, dead ones too.  documents.inspected() walks the page tree.
    """
    text = F.decode(F.coalesce(F.col(content), F.lit(b"")), "ISO-8859-1")
    sound, locked = text.startswith("%PDF-") & F.contains(text, F.lit("startxref")), text.rlike(r"/Encrypt\s+\d+\s+\d+\s+R")
    n = F.regexp_count(text, F.lit(r"/Type\s*/Page(?![A-Za-z])")).cast("long")
    status = F.when(~sound, "corrupt").when(locked, "encrypted").when(n > 0, "ok").otherwise("noPages")
    return files.withColumns({"status": status, "page_count": F.when(sound & ~locked, n)})


def objects(files: DataFrame, key: str, content: str = "content", most: int = 5_000_000) -> DataFrame:
    """(key, obj, gen, start, body_start, body_end): objects at the top level of each file.

    A stream is skipped by its /Length where that is a number, else up to endstream.
    """
    import pyarrow as pa

    kind = dict(files.dtypes)[key]
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                rows = list(scan(data.as_py() or b"", most))
                cols = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(rows), batch.column(0).type), *(pa.array(c, pa.int64()) for c in cols)], ["key", "obj", "gen", "start", "body_start", "body_end"])

    out = files.select(F.col(key), F.col(content)).mapInArrow(run, f"key {kind}, obj long, gen long, start long, body_start long, body_end long")
    return out.withColumnRenamed("key", key)


def latest(index: DataFrame, key: str) -> DataFrame:
    """The definition of each object that comes last in its file."""
    values = F.struct(*[F.col(c) for c in index.columns])
    return index.groupBy(key, "obj").agg(F.max_by(values, "start").alias("__v")).select("__v.*")


def inflated(data: Column, most: int = 1 << 26, ratio: float = 4.0) -> Column:
    """Deflated bytes, with or without a zlib header; null where broken or larger than `most` or ratio times a megabyte floor."""

    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(x: bytes | None) -> bytes | None:
            for bits in (15, -15):
                if x is None:
                    return None
                try:
                    d = zlib.decompressobj(bits)
                    limit = int(min(most, max(ratio * len(x), 1 << 20)))
                    out = d.decompress(x, limit + 1)
                    return out if len(out) <= limit and d.eof else None
                except zlib.error:
                    continue
            return None

        for part in parts:
            yield part.map(one)

    return run(data)


def appended(content: Column, section: Column) -> Column:
    """The content with a section after it; an empty section leaves it as it is."""
    return F.when(F.coalesce(F.octet_length(section), F.lit(0)) == 0, content).otherwise(F.concat(content, section))


def verbatim_prefix(before: Column, after: Column) -> Column:
    """Whether the bytes before are the beginning of those after."""
    return F.coalesce(F.substring(after, F.lit(1), F.octet_length(before)) == before, F.lit(False))


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def unescaped_name(name: Column) -> Column:
    """#XX escapes of a name as their characters."""
    parts = F.split(name, "#")
    is_hex = lambda p: p.rlike("^[0-9A-Fa-f]{2}")
    one = lambda p: F.when(is_hex(p), F.concat(F.decode(F.unhex(F.left(p, F.lit(2))), "ISO-8859-1"), F.substring(p, F.lit(3), F.length(p)))).otherwise(F.concat(F.lit("#"), p))
    return F.when(F.contains(name, F.lit("#")), F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), one), ""))).otherwise(name)


def incremental(content: Column, section: Column, most: int = 2 << 30) -> Column:
    """A file with an update behind its bytes, which stay as they are; an error for files over two gigabytes."""
    small = F.assert_true(F.coalesce(F.octet_length(content), F.lit(0)) <= most, F.lit("the file is too large"))
    return F.when(small.isNull(), appended(content, section))
