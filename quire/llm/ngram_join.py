"""N-gram Jaccard join of texts by a MinHash LSH forest, with exact verification.

A text is the set of its runs of `size` words; rows of the same sequence of words are one node.  A
forest of trees holds the nodes sorted by the tree's own stretch of their signatures.  Nodes that share
a prefix are matched from the longest prefixes on; the prefixes are shortened until an isolated pair
right at the threshold is found at the target recall, whatever other pairs there are.  What is
connected by likely pairs is verified exactly, word by word: all nodes of a component against its hub,
the node with most likely partners.  Nodes that share so much with the hub that they must be linked to each other are
counted; where there are others, the component is cut again by rare runs of words, and those of them that can still
have links meet hubs or all nodes of what is left of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.components import components
from quire.llm.exact_dedup import bitmaps, filter_bits, tested
from quire.llm.textkernel import U64, Words, chunks, copies, exact_windows, flat, mix, windows, words
from quire.plans.staging import drop_stage, kept, stage, staged

TREES, DEPTH = 12, 6
HASHES = TREES * DEPTH
SLACK = 0.2  # a signature's estimate may lie so far under the similarity: four standard deviations
BLOCK = 256  # nodes of a bucket or component that meet at once
_A = mix(np.arange(1, HASHES + 1, dtype=U64)).astype(np.uint32) | np.uint32(1)
_B = mix(np.arange(1001, HASHES + 1001, dtype=U64)).astype(np.uint32)


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Per row: id, r1 and r2 (hashes of id and text), k1 and k2 (of the words' SHA-256; null without words), n words and sig.

    sig is the little-endian 32-bit minima of the hashed runs; a text of fewer than `size` words has none.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in chunks(batch.column("text")):
                digest, whole = windows(w, size)
                doc, low = w.doc[: len(digest)][whole], (digest[whole] >> U64(32)).astype(np.uint32)
                some, first = np.unique(doc, return_index=True)
                sig = np.zeros((w.n_docs, HASHES), "<u4")
                if len(some):
                    for k in range(HASHES):
                        sig[some, k] = np.minimum.reduceat(low * _A[k] + _B[k], first)
                raw, n = w.buf.tobytes(), w.per_doc()
                key = np.array([np.frombuffer(hashlib.sha256(b" ".join(raw[i:j].split())).digest()[:16], np.int64) for i, j in zip(w.offsets, w.offsets[1:])]).reshape(-1, 2)
                short = np.ones(w.n_docs, bool)
                short[some] = False
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in ("id", "r1", "r2")), *(pa.array(key[:, k].copy(), mask=n == 0) for k in (0, 1)), pa.array(n),
                     pa.array([None if x else r.tobytes() for x, r in zip(short, sig)], pa.binary())],
                    ["id", "r1", "r2", "k1", "k2", "n", "sig"],
                )

    return _told(docs, id_col, text_col).mapInArrow(run, f"id {id_type}, r1 long, r2 long, k1 long, k2 long, n long, sig binary")


def _told(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), *_hashes(id_col, text_col))


def _hashes(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Two hashes of a row's id and text; a null is told from an empty text."""
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return F.xxhash64(ident, text, text.isNull()).alias("r1"), F.xxhash64(text, F.lit(5), ident.isNull(), ident).alias("r2")


def power_of_two(least: Column) -> Column:
    """The power of two that is `least` or more: a node's block then differs little from bucket to bucket."""
    return F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(least)))).cast("long")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of sorted batches, `rows` rows or one group each, with the groups' bounds."""
    held: list[pa.RecordBatch] = []

    def bounds(table: pa.Table) -> np.ndarray:
        change = np.zeros(table.num_rows, bool)
        change[0] = True
        for k in keys:
            x = table.column(k).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        return np.r_[np.flatnonzero(change), table.num_rows]

    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            held.append(batch.slice(at, rows))
            if sum(b.num_rows for b in held) >= rows:
                table = pa.Table.from_batches(held)
                cut = bounds(table)
                if len(cut) > 2:
                    yield table.slice(0, cut[-2]), cut[:-1]
                    held = table.slice(cut[-2]).to_batches()
    if held and sum(b.num_rows for b in held):
        table = pa.Table.from_batches(held)
        yield table, bounds(table)


def joined(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest place that each of n places is connected with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def pairs_of(cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows within each group."""
    size = np.diff(cut)
    out_i, out_j = [], []
    for n in np.unique(size):
        i, j = np.triu_indices(n, 1)
        at = cut[:-1][size == n][:, None]
        out_i.append((at + i).ravel())
        out_j.append((at + j).ravel())
    return np.concatenate(out_i), np.concatenate(out_j)


def likely(threshold: float, depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From blocks of buckets, sorted by their stretches, to each node's head and how many like it were met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cut in grouped(batches, ["key", "part"], 2000):
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
            stretch = np.frombuffer(b"".join(table.column("stretch").to_pylist()), np.uint32).reshape(table.num_rows, -1)
            label, degree = np.arange(table.num_rows), np.zeros(table.num_rows, np.int64)
            begins = np.zeros(table.num_rows, bool)
            begins[cut[:-1]] = True
            for length in range(min(DEPTH, stretch.shape[1]), depth - 1, -1):
                change = begins.copy()
                change[1:] |= (stretch[1:, :length] != stretch[:-1, :length]).any(1)
                runs = np.r_[np.flatnonzero(change), table.num_rows]
                lots = np.unique(np.searchsorted(np.cumsum(np.diff(runs) ** 2), np.arange(0, (np.diff(runs) ** 2).sum(), 200_000), "left"))
                left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for a, b in zip(lots, np.r_[lots[1:], len(runs) - 1]):
                    if a < b:
                        pair = np.stack(pairs_of(runs[a : b + 1]))
                        i, j = pair[:, label[pair[0]] != label[pair[1]]]  # those not yet connected
                        alike = (sig[i] == sig[j]).mean(1)
                        degree += np.bincount(np.r_[i[alike >= threshold], j[alike >= threshold]], minlength=len(degree))
                        left.append(i[alike >= threshold - SLACK])
                        right.append(j[alike >= threshold - SLACK])
                i, j = np.concatenate(left), np.concatenate(right)
                label = joined(np.r_[i, np.arange(len(label))], np.r_[j, label], len(label))
            node = table.column("node").to_numpy()
            yield pa.RecordBatch.from_arrays([table.column("key").combine_chunks(), table.column("parts").combine_chunks(), pa.array(node), pa.array(node[label]), pa.array(degree)], ["key", "parts", "node", "head", "degree"])

    return run


def shape(threshold: float, recall: float) -> tuple[int, int]:
    """Trees and the longest prefixes at which a pair at the threshold meets with probability `recall`."""
    for depth in range(DEPTH, 0, -1):
        if 1 - (1 - threshold**depth) ** TREES >= recall:
            return TREES, depth
    return HASHES, 1  # the most that the signatures have


def forest(nodes: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) that connect the nodes (node, sig) of similar texts, and (node, degree) of those with likely partners.

    A bucket of any size is cut into parts of about BLOCK nodes.  Each part is matched by itself and
    passes on its heads, as long as that makes them half as many; those that are left then meet all
    parts against all.
    """
    trees, depth = shape(threshold, recall)
    wide = HASHES // trees
    short = F.expr(f"aggregate(sequence(0, {HASHES - 1}), X'', (s, k) -> concat(s, substring(sig, 4 * k + 1, 1)))")
    short = stage(nodes.select("node", short.alias("sig"), F.col("sig").alias("full")), "bytes")  # a byte of each minimum is enough for estimates
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    members = short.select("node", "full", tree.alias("tree")).select("node", "tree", F.xxhash64("tree", F.substring("full", F.col("tree") * (4 * wide) + 1, F.lit(4 * depth))).alias("key"))
    done: DataFrame | None = None
    turn, before = 0, 0
    while True:
        groups = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        groups = stage(groups.select("key", "size", power_of_two(F.col("size") / BLOCK).alias("parts")), "buckets")
        large = groups.where("parts > 1").agg(F.sum("size")).first()[0] or 0
        crossed = turn > 0 and large * 2 > before
        rows = members.join(groups.hint("merge"), "key").withColumn("part", F.pmod(F.xxhash64("node", F.lit(turn)), F.col("parts")))
        if crossed:
            other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
            rows = rows.withColumn("other", other).withColumn("part", F.least("part", "other") * F.col("parts") + F.greatest("part", "other"))
        rows = rows.join(short.hint("merge"), "node").withColumn("stretch", F.substring("full", F.col("tree") * (4 * wide) + 1, F.lit(4 * wide)))
        rows = rows.repartition("key", "part").sortWithinPartitions("key", "part", "stretch")
        met = stage(rows.select("key", "part", "parts", "node", "stretch", "sig").mapInArrow(likely(threshold, depth), "key long, parts long, node long, head long, degree long"), "met")
        drop_stage(groups)
        done = met if done is None else done.unionByName(met)
        if crossed or not large:
            break
        before, turn = large, turn + 1
        heads = met.where("parts > 1").select("key", F.col("head").alias("node")).distinct()
        members = stage(heads.join(members, ["key", "node"]).select("node", "tree", "key").distinct(), "heads")
    drop_stage(short)
    edges = stage(done.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct(), "forest")
    degrees = stage(done.where("degree > 0").groupBy("node").agg(F.sum("degree").alias("degree")), "degrees")
    return edges, degrees


def overlaps(doc: np.ndarray, digest: np.ndarray, n: int) -> np.ndarray:
    """How many shingles each two of n sets share: pairs are counted for rare shingles, products taken of frequent ones."""
    order = np.argsort(digest, kind="stable")
    doc, digest = doc[order], digest[order]
    first = np.flatnonzero(np.r_[True, digest[1:] != digest[:-1]]) if len(digest) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(digest)])
    out = np.zeros((n, n), np.float32)
    for m in range(2, min(16, n) + 1):
        at = first[size == m]
        if len(at):
            sets = doc[at[:, None] + np.arange(m)]
            i, j = np.triu_indices(m, 1)
            code = np.bincount((sets[:, i] * n + sets[:, j]).ravel(), minlength=n * n).reshape(n, n)
            out += code
            out += code.T
    many = first[size > 16]
    width = size[size > 16]
    for k in range(0, len(many), 2048):
        part = width[k : k + 2048]
        of = np.repeat(np.arange(len(part)), part)
        at = np.repeat(many[k : k + 2048], part) + np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part)
        has = np.zeros((n, len(part)), np.float32)
        has[doc[at], of] = 1
        out += has @ has.T
    return out


def _sets(texts: pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct runs of words of texts (text, number of the run), told apart by their bytes, and how many each has."""
    w = words(*flat(texts.combine_chunks() if isinstance(texts.combine_chunks(), pa.Array) else pa.concat_arrays(texts.chunks)))
    run = exact_windows(w.number, size)
    whole = w.doc[: len(run)] == w.doc[len(w.doc) - len(run) :]
    doc, run = w.doc[: len(run)][whole], run[whole]
    _, before = copies(doc, run)
    return doc[~before], run[~before], np.bincount(doc[~before], minlength=w.n_docs)


def to_hub(size: int, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From parts of components, the hub first, to each node's hub, whether it is linked to it and close to it, and the copies of either.

    Sets of a and b runs that share s and r with the hub's h share at least s + r - h, and are linked where they share
    t / (1 + t) of a + b.  So two nodes with s - t / (1 + t) a of h / 2 or more, close ones, are linked, to the hub as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cut in grouped(batches, ["label", "part"], 400):
            doc, run_, n = _sets(table.column("text"), size)
            group = np.repeat(np.arange(len(cut) - 1), np.diff(cut)).astype(U64)
            key = group[doc] << U64(32) | run_.astype(U64)
            hub = np.zeros(table.num_rows, bool)
            hub[cut[:-1]] = True
            both = np.bincount(doc[np.isin(key, key[hub[doc]])], minlength=len(n))
            of = cut[:-1][group.astype(np.int64)]
            linked = (both >= threshold * (n + n[of] - both) - 1e-9) & (n > 0) & ~hub
            close = linked & ((1 + threshold) * both - threshold * n >= (1 + threshold) * n[of] / 2 + 1e-9)
            node, own = table.column("node").to_numpy(), table.column("copies").to_numpy()
            at = np.flatnonzero(~hub)
            yield pa.RecordBatch.from_arrays(
                [table.column("label").combine_chunks().take(pa.array(at)), *(pa.array(x[at]) for x in (node, node[of], linked, close, own, own[of]))],
                ["label", "node", "hub", "linked", "close", "copies", "hub_copies"])

    return run


def to_all(size: int, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From blocks of rest nodes beside blocks of all nodes of their component to links counted and edges that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cut in grouped(batches, ["label", "low", "high"], 400):
            doc, run_, n = _sets(table.column("text"), size)
            column = {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("node", "side", "rest", "copies")}
            out = []
            for a, b in zip(cut[:-1], cut[1:]):
                lo, hi = np.searchsorted(doc, [a, b])
                node, side, rest, own = (column[c][a:b] for c in ("node", "side", "rest", "copies"))
                same = overlaps(doc[lo:hi] - a, np.unique(run_[lo:hi], return_inverse=True)[1], b - a)
                total = n[a:b, None] + n[None, a:b]
                link = (same >= threshold * (total - same) - 1e-6) & (same > 0) & (node[:, None] != node[None, :])
                link &= (side[:, None] == 0) & (side[None, :] == 1)  # rest ones against all
                i, j = np.nonzero(link)
                places, place = np.unique(node, return_inverse=True)
                head = joined(place[i], place[j], len(places))
                links = np.bincount(place[i], own[j], len(places)) + np.bincount(place[j], own[i] * ~rest[j], len(places))
                for k in np.flatnonzero((links > 0) | (head != np.arange(len(places)))):
                    out.append((int(places[k]), int(links[k]), int(places[head[k]])))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * 3)], ["node", "links", "to"])

    return run


def texts_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """wanted (r1, r2, ...) with the text of one row that has these hashes; only rows that pass a filter are shuffled."""
    bits = filter_bits(wanted.count())
    found = stage(bitmaps(wanted.select("r1"), bits), "filter")
    rows = tested(_told(docs, id_col, text_col).select("r1", "r2", "text"), "r1", found, bits, "among").where("among").select("r1", "r2", "text")
    return wanted.join(rows.groupBy("r1", "r2").agg(F.first("text").alias("text")).hint("merge"), ["r1", "r2"]).drop("r1", "r2")


def runs_of(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From texts to the hashes of their distinct runs of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in chunks(batch.column("text")):
                digest, whole = windows(w, size)
                doc, digest = w.doc[: len(digest)][whole], digest[whole]
                order = np.lexsort((digest, doc))
                doc, digest = doc[order], digest[order]
                first = np.r_[True, (doc[1:] != doc[:-1]) | (digest[1:] != digest[:-1])] if len(doc) else np.zeros(0, bool)
                doc, digest = doc[first], digest[first]
                n = np.bincount(doc, minlength=w.n_docs)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(digest.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("label", "node", "rest")), pa.array(n), lists], ["label", "node", "rest", "n", "runs"])

    return run


def cut_again(texts: DataFrame, members: DataFrame, size: int, threshold: float) -> DataFrame:
    """(node, label, rest): components of members (node, label, rest) that can still hold links of a rest node; others are left out.

    Runs are ordered by how many texts of the component have them, rare ones first.  Two texts of a similarity at the
    threshold share one of their first `(1 - threshold) n + 1` runs, so nodes are connected by those alone.  Runs that one text
    has by itself come first and connect nothing: texts that only share a template fall apart here.
    """
    rows = texts.select("node", "text").join(members, "node").select("label", "node", "rest", "text")
    told = stage(rows.mapInArrow(runs_of(size), "label long, node long, rest boolean, n long, runs array<long>"), "runs")
    each = told.select("label", "node", "rest", "n", F.explode("runs").alias("run"))
    shared = each.groupBy("label", "run").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    ordered = each.join(stage(shared, "shared").hint("merge"), ["label", "run"]).groupBy("label", "node", "rest", "n").agg(F.sort_array(F.collect_list(F.struct("texts", "run"))).alias("runs"))
    most = F.floor(F.col("n") * (1 - threshold) + 1e-9).cast("int") + 1 - (F.col("n") - F.size("runs")).cast("int")
    first = stage(ordered.where(most > 0).select("label", "node", "rest", F.explode(F.slice("runs", F.lit(1), most)).alias("r")).select("label", "node", "rest", "r.run"), "first")
    heads = first.groupBy("label", "run").agg(F.min("node").alias("head"), F.bool_or("rest").alias("any"), F.count(F.lit(1)).alias("met")).where("any AND met > 1")
    met = first.join(stage(heads.select("label", "run", "head"), "heads").hint("merge"), ["label", "run"]).select("node", "head")
    met = stage(met.withColumn("low", F.min("head").over(Window.partitionBy("node"))), "met")  # of one text's first runs
    # a node's edge to its lowest head, and one for each two heads that some node has: nodes of one family have the same heads
    edges = met.select(F.col("node").alias("a"), F.col("low").alias("b")).unionByName(met.select(F.col("head").alias("a"), F.col("low").alias("b"))).distinct().where("a <> b")
    out = components(stage(edges, "edges")).join(members.select("node", "rest"), "node")
    drop_stage(told)
    return stage(out, "again")


def met_all(texts: DataFrame, members: DataFrame, size: int, threshold: float) -> DataFrame:
    """(node, links, to) of rest nodes against all of their component; members are (node, label, rest)."""
    rows = stage(texts.join(members, "node"), "members")
    parts = lambda share: power_of_two(F.greatest(F.count(F.when(share, 1)) / BLOCK, F.sum(F.when(share, F.col("n")).otherwise(0)) / (1 << 20)))
    sizes = stage(rows.groupBy("label").agg(parts(F.col("rest")).alias("lows"), parts(F.lit(True)).alias("highs")), "sizes")
    rows = rows.join(sizes.hint("merge"), "label").withColumns({"l": F.pmod(F.xxhash64("node", F.lit(1)), F.col("lows")), "h": F.pmod(F.xxhash64("node", F.lit(2)), F.col("highs"))})
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    place = lambda side, low, high: F.struct(F.lit(side).alias("side"), low.alias("low"), high.alias("high"))
    none = F.array().cast("array<struct<side:int,low:bigint,high:bigint>>")
    met = F.concat(F.transform(every("lows"), lambda x: place(1, x, F.col("h"))), F.when(F.col("rest"), F.transform(every("highs"), lambda x: place(0, F.col("l"), x))).otherwise(none))
    rows = rows.withColumn("met", F.explode(met)).select("label", "met.low", "met.high", "node", "met.side", "rest", "copies", "text")
    rows = rows.repartition("label", "low", "high").sortWithinPartitions("label", "low", "high")
    return stage(rows.mapInArrow(to_all(size, threshold), "node long, links long, to long"), "links")


def met_hubs(texts: DataFrame, members: DataFrame, size: int, threshold: float) -> DataFrame:
    """(label, node, hub, linked, close, copies, hub_copies) of all nodes but the hub of each component; members are (node, label).

    The hub is the node with most likely partners."""
    rows = stage(texts.join(members, "node"), "members")
    hubs = rows.groupBy("label").agg(
        F.min_by("node", F.struct(-F.col("degree"), F.col("node"))).alias("hub"), power_of_two(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / (1 << 20))).alias("parts"))
    rows = rows.join(stage(hubs, "hubs").hint("merge"), "label")
    is_hub = F.col("node") == F.col("hub")
    part = F.explode(F.when(is_hub, F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("parts")))))
    rows = rows.withColumn("last", ~is_hub).withColumn("part", part)
    rows = rows.repartition("label", "part").sortWithinPartitions("label", "part", "last")
    return stage(rows.select("label", "part", "node", "copies", "text").mapInArrow(to_hub(size, threshold), "label long, node long, hub long, linked boolean, close boolean, copies long, hub_copies long"), "near")


def verified(docs: DataFrame, nodes: DataFrame, labels: DataFrame, degrees: DataFrame, id_col: str, text_col: str, size: int, threshold: float) -> DataFrame:
    """(node, links, to): counts of verified links, and edges that hold the verified classes together.

    All nodes of a component meet its hub.  Those close to it are linked to each other and counted without meeting.  Where
    there are others, the component is cut again by rare runs of words.  A new component of at most half the old one's
    nodes, none of them close, is treated as the old one was; in any other those that are not close meet all.  So a node
    meets a hub a logarithmic number of times, and no link within a component is left out.
    """
    told = labels.join(nodes.select("node", "copies", "n", "r1", "r2"), "node").join(degrees, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    texts = stage(texts_of(docs, stage(told.drop("label"), "candidates"), id_col, text_col), "texts")
    members, found = stage(labels.select("node", "label"), "labels"), []
    while True:
        near = met_hubs(texts, members, size, threshold)
        linked = near.where("linked")
        found.append(linked.select("node", F.col("hub_copies").alias("links"), F.col("hub").alias("to")))
        found.append(linked.groupBy(F.col("hub").alias("node")).agg(F.sum("copies").alias("links")).withColumn("to", F.col("node")))
        close = near.where("close")
        crowd = stage(close.groupBy("label").agg(F.sum("copies").alias("all"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "crowd")
        found.append(close.join(crowd, "label").select("node", (F.col("all") - F.col("copies")).alias("links"), F.col("hub").alias("to")))
        rest = near.groupBy("label").agg(F.count_if(~F.col("close")).alias("others"), F.count(F.lit(1)).alias("old")).where("others > 0 AND old > 1")
        rest = stage(rest, "rest")
        if rest.limit(1).count() == 0:
            break
        open_ = stage(near.select("label", "node", (~F.col("close")).alias("rest")).join(rest.select("label"), "label"), "open")  # the hub has met all
        old = open_.join(rest.select("label", "old"), "label").select("node", "old")
        new = cut_again(texts, open_, size, threshold).join(old, "node")
        kinds = new.groupBy("label").agg(((F.count(F.lit(1)) > BLOCK) & F.bool_and("rest") & (F.count(F.lit(1)) * 2 <= F.min("old"))).alias("anew"))
        new = stage(new.join(stage(kinds, "kinds"), "label").select("node", "label", "rest", "anew"), "new")
        found.append(met_all(texts, new.where("NOT anew").drop("anew"), size, threshold))
        members = stage(new.where("anew").select("node", "label"), "labels")
        if members.limit(1).count() == 0:
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """One row per row of docs: the id, same_id, class_id, n_copies and n_links; class_node, r1 and r2 follow.

    class_node numbers the classes (null without words), r1 and r2 are hashes of id and text.  Two rows are linked if the Jaccard similarity of their sets of `size`-word runs is `threshold` or
    more; words are runs of bytes between ASCII blanks, as they are written.  A text of fewer words is
    linked to rows of the same words only.  same_id is the smallest id of the rows of the same
    sequence of words and n_copies their number; class_id is the smallest id that links lead to, over
    any number of them.  n_links counts the rows that the row is linked to: its copies, and all rows of its
    component (those that the forest connects) whose similarity is `threshold` or more.  A null or empty text, or one of blanks, has no
    links and its own id as class.  Repeated rows are copies of each other, rows that share an id but no
    text are not; a null id is the smallest only where there is no other.  Other columns of docs are
    left out; an empty table gives no rows.
    """
    signed = stage(signatures(docs, id_col, text_col, size), "signatures")
    least = F.min(F.struct("r1", "r2"))
    nodes = signed.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), least.alias("r"))
    nodes = stage(nodes.select("k1", "k2", "first", "copies", "n", "sig", "r.r1", "r.r2").withColumn("node", F.monotonically_increasing_id()), "nodes")
    edges, degrees = forest(nodes.where("sig IS NOT NULL"), threshold, recall)
    labels = components(edges)
    with staged(docs.sparkSession):
        linked = kept(stage(verified(docs, nodes, labels, degrees, id_col, text_col, size, threshold), "verified"))
    classes = components(linked.select(F.col("node").alias("a"), F.col("to").alias("b")))
    told = nodes.select("node", "k1", "k2", "first", "copies").join(linked.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(classes, "node", "left")
    told = stage(told.withColumn("label", F.coalesce("label", "node")), "told")
    least_ = told.groupBy("label").agg(F.min("first").alias("class"))
    answer = stage(told.join(least_, "label").select("k1", "k2", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"), "class", "label"), "answer")
    for table in (nodes, edges, degrees, labels, linked, classes, told):
        drop_stage(table)
    out = signed.select("id", "k1", "k2", F.col("r1").alias("own1"), F.col("r2").alias("own2")).join(answer, ["k1", "k2"], "left")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("first", "id").alias("same_id"), F.coalesce("class", "id").alias("class_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"), F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
        F.col("label").alias("class_node"), F.col("own1").alias("r1"), F.col("own2").alias("r2"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """The rows of docs without those that are near copies of a row that stays, with all their columns.

    Of rows that links lead to, the one of the smallest id stays (a null id comes last, then the hash of
    the text decides); of rows that repeat id and text, one.  Rows without words all stay.  Only rows
    that pass a filter of the linked rows' hashes may be shuffled.  An empty table gives no rows.
    """
    linked = ngram_join(docs, id_col, text_col, size, threshold, recall).where("n_links > 0")
    rows = stage(linked.select("class_node", F.col(id_col).alias("id"), "r1", "r2"), "linked")
    best = rows.groupBy("class_node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "r1", "r2")).alias("best"))
    told = rows.distinct().join(best, "class_node").select("r1", "r2", ((F.col("best.r1") == F.col("r1")) & (F.col("best.r2") == F.col("r2"))).alias("stays"))
    told = stage(told, "stays")
    bits = filter_bits(told.count())
    found = stage(bitmaps(told.select("r1"), bits), "filter")
    drop_stage(rows)
    own = [F.col(f"own.`{c}`").alias(c) for c in docs.columns]
    hashed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), *_hashes(id_col, text_col))
    hashed = tested(hashed, "r1", found, bits, "among")
    some = hashed.where("among").join(told, ["r1", "r2"], "left")
    kept = some.where("stays").groupBy("r1", "r2").agg(F.first("own").alias("own"))
    return hashed.where("NOT among").select(*own).unionByName(some.where("stays IS NULL").select(*own)).unionByName(kept.select(*own))
