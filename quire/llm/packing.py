"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Whole windows are cut off each document first.  The remaining pieces of a run of documents are
differenced into a number of windows: the two partial partitions of largest spread are merged with
opposing imbalances until one is left.  If a window then exceeds the capacity, there is one more.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bpe import loaded, text_slices
from quire.llm.textkernel import PART_BYTES
from quire.llm.training import released


def difference(sizes: list[int], m: int) -> list[list[int]]:
    """The places of sizes in m windows of nearly equal sums."""
    left, right = [0], [0]  # of nodes; node k + 1 up to len(sizes) is the piece k
    left += [0] * len(sizes)
    right += [0] * len(sizes)
    heap = []
    for k, size in enumerate(sizes):
        sums, nodes = np.zeros(m, np.int64), np.zeros(m, np.int64)
        sums[0], nodes[0] = size, k + 1
        heap.append((-size, k, sums, nodes))
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        _, _, s, a = heapq.heappop(heap)
        _, _, t, b = heapq.heappop(heap)
        s, b = s + t[::-1], b[::-1]
        both = np.flatnonzero((a > 0) & (b > 0))
        nodes = np.where(a > 0, a, b)
        nodes[both] = np.arange(len(left), len(left) + len(both))
        left += a[both].tolist()
        right += b[both].tolist()
        order = np.argsort(-s, kind="stable")
        s, nodes = s[order], nodes[order]
        heapq.heappush(heap, (int(s[-1] - s[0]), turn, s, nodes))
        turn += 1
    out = []
    for root in heap[0][3].tolist() if heap else []:
        pieces, stack = [], [root] if root else []
        while stack:
            x = stack.pop()
            if x <= len(sizes):
                pieces.append(x - 1)
            else:
                stack += [left[x], right[x]]
        out.append(pieces)
    return out


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most `capacity`; their number rises until the differencing keeps within it."""
    m = max(1, -(-sum(sizes) // capacity))
    while True:
        out = difference(sizes, m)
        if all(sum(sizes[k] for k in w) <= capacity for w in out):
            return [w for w in out if w]
        m += 1


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 0, max_piece: int = 256, windows: int = 128) -> DataFrame:
    """One row per piece: id, start, length, ids (binary), doc_tokens, sequence_id and offset.

    A document is its ids and then end_id; a null or empty text is end_id alone.  Pieces are whole
    windows, and of the rest at most max_piece ids.  About `windows` windows are filled at a time
    from the rows of one partition, so nothing is shuffled and a retried task packs the same again.
    Rows that repeat an id are packed as documents of their own; other columns of docs are left out,
    whatever their names; an empty table gives no pieces.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        serial = TaskContext.get().partitionId() << 33
        end = np.array([end_id], "<u4").tobytes()
        pool: list[tuple] = []  # pieces: id, start, ids, doc_tokens
        held = 0
        rows: list[tuple] = []

        def place(group: list[tuple]) -> None:
            nonlocal serial
            at = 0
            for doc, start, ids, n in group:
                rows.append((doc, start, len(ids) // 4, ids, n, serial, at))
                at += len(ids) // 4
            serial += 1

        def settle() -> None:
            nonlocal held
            for w in windows_of([len(p[2]) // 4 for p in pool], capacity):
                place([pool[k] for k in sorted(w)])
            pool.clear()
            held = 0

        def out(ids: pa.DataType) -> pa.RecordBatch:
            kinds = [ids, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            rows.clear()
            return batch

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for a, b, texts in text_slices(batch, "text", PART_BYTES):
                for doc, ids in zip(batch.column(0).slice(a, b - a).to_pylist(), bpe.encode(texts)):
                    ids += end
                    n = len(ids) // 4
                    whole = n - n % capacity
                    for start in range(0, whole, capacity):
                        place([(doc, start, ids[4 * start : 4 * (start + capacity)], n)])
                    for start in range(whole, n, max_piece):
                        pool.append((doc, start, ids[4 * start : 4 * (start + max_piece)], n))
                    held += n - whole
                    if held >= windows * capacity:
                        settle()
                yield out(kind)
                released()
        if pool:
            settle()
            yield out(kind)

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = f"id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
