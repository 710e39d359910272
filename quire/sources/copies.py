"""Files copied by tasks in pieces, with bytes appended, between file systems that all executors reach.

A file's bytes are never a value of a row.  A task writes beside the target and renames at the end, so that an
attempt that dies leaves no half file under the target's name, and one that runs twice leaves the same bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 4 << 20
RESULT = "status string, size long, sha256 string"


def _copied(source: str, target: str, section: bytes | None, piece: int) -> tuple[str, int | None, str | None]:
    from pyarrow import fs

    reads, path = fs.FileSystem.from_uri(source)
    writes, place = fs.FileSystem.from_uri(target)
    if reads.equals(writes) and reads.normalize_path(path).casefold() == writes.normalize_path(place).casefold():
        return "sameFile", None, None
    if reads.get_file_info(path).type != fs.FileType.File:
        return "missing", None, None
    writes.create_dir(place.rpartition("/")[0], recursive=True)
    beside, digest, size = f"{place}.{uuid.uuid4().hex}.part", hashlib.sha256(), 0
    try:
        with reads.open_input_stream(path) as a, writes.open_output_stream(beside) as b:
            while part := a.read(piece):
                b.write(part)
                digest.update(part)
                size += len(part)
            if section:
                b.write(section)
                digest.update(section)
                size += len(section)
        writes.move(beside, place)
    except BaseException:
        if writes.get_file_info(beside).type == fs.FileType.File:
            writes.delete_file(beside)
        raise
    return "ok", size, digest.hexdigest()


def copy_files(plan: DataFrame, source: str = "source", target: str = "target", section: str | None = None, piece: int = PIECE) -> DataFrame:
    """plan with status, size and sha256 of each copy; the copies are made when the result is computed.

    source and target are addresses (file://, hdfs:// and whatever else pyarrow opens); section, if named, is a column
    of bytes to append.  status is ok, missing (no such file: nothing is written) or sameFile (the target is the source, in
    whatever case: nothing is written).  An existing target is replaced.  Rows are dealt out one file a task at
    a time; memory is one piece.
    """
    names, kinds = [c for c in plan.columns if c not in ("status", "size", "sha256")], dict(plan.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sections = batch.column(section).to_pylist() if section else [None] * batch.num_rows
            rows = [_copied(a, b, s, piece) for a, b, s in zip(batch.column(source).to_pylist(), batch.column(target).to_pylist(), sections)]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.string(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], [*names, "status", "size", "sha256"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), RESULT])
    return plan.select(*names).repartition(F.col(target)).mapInArrow(run, schema)
