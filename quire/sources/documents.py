"""Objects inside documents: dictionaries, packed objects, live definitions and the page tree.

Files are parsed a row at a time in Arrow batches; which definition is live, what a file's budget
allows and how pages are ordered are windows and joins.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.plans.staging import stage_rows
from quire.sources.content import reference, references
from quire.sources.structure import parsed, values

BUDGET = 64 << 20
DEEPEST, NODES = 256, 500_000
entries = values


def lookup(data: Column, key: str) -> Column:
    """(status, value) of a key: found, absent, or unparseable."""
    @F.pandas_udf("status string, value binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def one(x: bytes | None) -> tuple[str, bytes | None]:
            found = entries(x) if x is not None else None
            return ("unparseable", None) if found is None else ("found", found[key]) if key in found else ("absent", None)

        for part in parts:
            yield pd.DataFrame([one(x) for x in part], columns=["status", "value"])

    return run(data)


def bodies(files: DataFrame, index: DataFrame, key: str, content: str = "content") -> DataFrame:
    """The index of objects with each one's bytes."""
    size = F.col("body_end") - F.col("body_start")
    return index.join(files.select(key, content), key).withColumn("body", F.substring(content, (F.col("body_start") + 1).cast("int"), size.cast("int"))).drop(content)


def packed(objects: DataFrame, key: str, budget: int = BUDGET) -> DataFrame:
    """(key, obj, container_start, body) of objects packed in object streams; the newest container wins.

    objects has start and body.  Streams are taken newest first until their inflated bytes reach the
    file's budget.
    """
    kind = dict(objects.dtypes)[key]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, start, body in zip(*(c.to_pylist() for c in batch.columns)):
                d = entries(body or b"")
                at = re.search(rb"stream\r?\n", body or b"")
                if not d or d.get("Type") != b"/ObjStm" or d.get("Filter") != b"/FlateDecode" or "DecodeParms" in d or not at:
                    continue
                try:
                    plain = zlib.decompressobj().decompress(body[at.end() :], budget)
                    n, first = int(d["N"]), int(d["First"])
                    numbers = [int(x) for x in plain[:first].split()[: 2 * n]]
                except (zlib.error, KeyError, ValueError):
                    continue
                pairs = sorted(zip(numbers[1::2], numbers[::2]))
                for (offset, obj), end in zip(pairs, [*(p[0] for p in pairs[1:]), len(plain) - first]):
                    part = plain[first + offset : first + end].strip()
                    if entries(part) is not None:
                        out.append((name, start, len(plain), obj, part))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 5, (batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["key", "container_start", "inflated", "obj", "body"])

    rows = objects.select(F.col(key).alias("key"), "start", "body").where(F.contains("body", F.lit("/ObjStm").cast("binary")))
    found = rows.mapInArrow(unpack, f"key {kind}, container_start long, inflated long, obj long, body binary")
    streams = found.select("key", "container_start", "inflated").distinct()
    before = F.coalesce(F.sum("inflated").over(Window.partitionBy("key").orderBy(F.desc("container_start")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    allowed = streams.withColumn("before", before).where(F.col("before") + F.col("inflated") <= budget).select("key", "container_start")
    values = F.struct("container_start", "body")
    best = found.join(allowed, ["key", "container_start"], "left_semi").groupBy("key", "obj").agg(F.max_by(values, "container_start").alias("v"))
    return best.select(F.col("key").alias(key), "obj", "v.container_start", "v.body")


def live(top: DataFrame, inner: DataFrame, key: str) -> DataFrame:
    """(key, obj, gen, body): the later of an object's two definitions; the generation is the top-level one's, else 0."""
    a = top.select(key, "obj", "gen", "start", F.col("body").alias("__top"))
    b = inner.select(key, "obj", "container_start", F.col("body").alias("__inner"))
    later = F.coalesce(F.col("container_start") > F.col("start"), F.col("start").isNull())
    return a.join(b, [key, "obj"], "full_outer").select(key, "obj", F.coalesce("gen", F.lit(0).cast("long")).alias("gen"), F.when(later, F.col("__inner")).otherwise(F.col("__top")).alias("body"))


def page_leaves(nodes: DataFrame, roots: DataFrame, key: str, deepest: int = DEEPEST, most: int = NODES, carry: list[str] | None = None) -> DataFrame:
    """(key, page, obj): the leaves below each file's root in order.

    nodes are (key, obj, kids: array of object numbers, null for a page).  A file's tree is walked in one task,
    each node once, down to `deepest` and over `most` nodes at most.  Columns named in `carry` are added: a leaf's own
    value, else its nearest ancestor's.
    """
    kinds, carry = dict(nodes.dtypes), carry or []

    def walk(table: pa.Table) -> pa.Table:
        kids = dict(zip(table.column("obj").to_pylist(), table.column("kids").to_pylist()))
        own = dict(zip(table.column("obj").to_pylist(), zip(*(table.column(c).to_pylist() for c in carry)))) if carry else {}
        stack, seen, found, carried = [(table.column("root")[0].as_py(), 1, (None,) * len(carry))], set(), [], []
        while stack and len(seen) < most:
            obj, depth, above = stack.pop()
            if obj in seen or obj not in kids:
                continue
            seen.add(obj)
            here = tuple(a if b is None else b for a, b in zip(above, own[obj])) if carry else ()
            if kids[obj] is None:
                found.append(obj)
                carried.append(here)
            elif depth < deepest:
                stack += [(k, depth + 1, here) for k in reversed(kids[obj])]
        columns = {"key": pa.array([table.column("key")[0].as_py()] * len(found), table.schema.field("key").type), "page": pa.array(range(len(found)), pa.int64()), "obj": pa.array(found, pa.int64())}
        return pa.table(columns | {c: pa.array([x[k] for x in carried], table.schema.field(c).type) for k, c in enumerate(carry)})

    rows = nodes.select(F.col(key).alias("key"), F.col("obj").cast("long").alias("obj"), F.col("kids").cast("array<long>").alias("kids"), *carry)
    rows = rows.join(roots.select(F.col(key).alias("key"), F.col("obj").cast("long").alias("root")), "key")
    schema = ", ".join([f"key {kinds[key]}, page long, obj long", *(f"`{c}` {kinds[c]}" for c in carry)])
    return rows.groupBy("key").applyInArrow(walk, schema).withColumnRenamed("key", key)


def shows_text(plain: Column) -> Column:
    """Whether the operators of a content stream's plain bytes show text."""

    @F.pandas_udf("boolean")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        show = {s.encode() for s in SHOW}

        def one(x: bytes | None) -> bool:
            return bool(set(re.sub(rb"\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>", b" ", x or b"").split()) & show)

        for part in parts:
            yield part.map(one)

    return run(plain)


def inspected(files_: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, status, page_count, has_text): a look inside each file.

    status is missing (no content), corrupt (no header, or no way to the root), encrypted (the empty password does not
    open it), noPages or ok.  Pages are the leaves of the page tree of the live definitions, packed ones
    too; has_text says whether the first page's contents show text.
    """
    told = stage_rows(parsed(files_, key, content, contents=True), "parsed")
    alive = told.where("obj IS NOT NULL")
    ends = told.where("obj IS NULL").select(key, "ending.state", F.col("ending.root").alias("obj"))
    tree = alive.join(ends.where("state = 'open'").select(key, "obj"), [key, "obj"])
    roots = tree.select(key, reference(F.col("node")["Pages"]).alias("obj")).where("obj IS NOT NULL")
    nodes = alive.where("node IS NOT NULL AND kind <> '/Catalog'").select(key, "obj", F.when(F.col("kind") != "/Page", F.col("kids")).alias("kids"))
    leaves = stage_rows(page_leaves(nodes, roots, key), "leaves")
    first = leaves.where("page = 0").join(alive.where("node IS NOT NULL").select(key, "obj", F.col("node")["Contents"].alias("streams")), [key, "obj"])
    first = first.select(key, F.explode(references(F.col("streams"))).alias("r")).select(key, F.col("r.obj").alias("obj"))
    shown = first.join(alive.where("plain IS NOT NULL").select(key, "obj", "plain"), [key, "obj"]).groupBy(key).agg(F.bool_or(shows_text(F.col("plain"))).alias("has_text"))
    out = ends.select(key, "state").join(leaves.groupBy(key).agg(F.count(F.lit(1)).alias("page_count")), key, "left").join(shown, key, "left")
    is_open = F.col("state") == "open"
    return out.select(
        key, F.when(is_open, F.when(F.col("page_count") > 0, "ok").otherwise("noPages")).otherwise(F.col("state")).alias("status"),
        F.when(is_open, F.coalesce("page_count", F.lit(0))).alias("page_count"), F.when(is_open & (F.col("page_count") > 0), F.coalesce("has_text", F.lit(False))).alias("has_text"))


def image_coverage(images: DataFrame, key: str, dpi: float = 100.0) -> DataFrame:
    """Pixels of a page's images against the page's own at a resolution; 0 for a page without area."""
    area = F.max((F.col("page_w") / 72.0 * dpi) * (F.col("page_h") / 72.0 * dpi))
    return images.groupBy(key).agg(F.coalesce(F.try_divide(F.sum(F.when((F.col("w") > 0) & (F.col("h") > 0), F.col("w") * F.col("h")).otherwise(0)).cast("double"), F.when(area > 0, area)), F.lit(0.0)).alias("coverage"))


# Operators of a content stream that draw images, show text, and paint paths or shadings.
DRAW, SHOW = ["Do"], ["Tj", "TJ", "'", '"']
PAINT = ["f", "F", "f*", "B", "B*", "b", "b*", "S", "s", "sh"]


def image_only(pages: DataFrame, key: str, stream: str = "stream") -> DataFrame:
    """Whether a page's operators draw exactly one image, show no text and paint nothing."""
    bare = F.regexp_replace(stream, r"\((?:[^()\\]|\\.)*\)", " ")
    words = pages.select(key, F.explode(F.split(bare, r"\s+")).alias("op"))
    n = lambda names: F.count_if(F.col("op").isin(names))
    return words.groupBy(key).agg(((n(DRAW) == 1) & (n(SHOW) == 0) & (n(PAINT) == 0)).alias("image_only"))


def page_geometry(text: DataFrame, geometry: DataFrame, key: str) -> DataFrame:
    """Recognised pages beside the target's geometry; an error where a document's page counts differ."""
    counts = geometry.groupBy(key).agg(F.count(F.lit(1)).alias("__have"))
    same = F.assert_true(F.col("pages") == F.col("__have"), F.lit("page counts differ"))
    return text.join(counts, key).where(same.isNull()).drop("__have").join(geometry, [key, "page"])


def packed_bits(pix: DataFrame, limit: int = 128) -> DataFrame:
    """(id, y, byte, value): eight pixels a byte, the first in the highest bit, ink as 0, rows filled with ones."""
    white = F.when(F.col("v") < limit, 0).otherwise(F.pow(F.lit(2), 7 - F.col("x") % 8)).cast("int")
    rows = pix.groupBy("id", "y", F.floor(F.col("x") / 8).cast("int").alias("byte")).agg(F.sum(white).alias("s"), F.count(F.lit(1)).alias("n"))
    return rows.select("id", "y", "byte", (F.col("s") + F.pow(F.lit(2), 8 - F.col("n")) - 1).cast("int").alias("value"))
