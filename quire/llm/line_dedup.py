"""Line dedup: long lines that many documents share stay only in the last document that holds them.

Lines are exploded with their positions, hashed, and counted by distinct documents; the positions to
drop are joined back by row and the remaining lines are put together in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.exact_dedup import bitmaps, filter_bits, others, tested
from quire.plans.staging import stage

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII blanks at its ends, A-Z lower-cased and nothing else."""
    bare = F.trim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)  # lower() is quick, and then the same
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with the text rewritten, and n_lines (before) and n_dropped added, replacing columns so named in any case.

    A text is split at newlines; a null or empty text is one empty line and comes back empty.  A line
    whose key has min_chars code points or more and is found in min_docs distinct ids or more loses
    all its lines, except in the rows of the largest id that holds it.  Rows without an id count as
    one document, which comes before all others.  Rows that share an id are one document to the
    count, and each is rewritten by itself.  An empty table gives an empty result.
    """
    ident, lines = F.col(f"`{id_col}`"), F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "\n")
    row = F.xxhash64(ident, F.col(f"`{text_col}`"))
    found = (
        docs.select(ident.alias("id"), row.alias("row"), F.posexplode(lines).alias("pos", "line"))
        .where(F.char_length("line") >= min_chars)
        .select("id", "row", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))
    )
    shared = stage(
        found.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.max(F.col("id").isNull().cast("int")).alias("nulls"), F.max("id").alias("last"))
        .where(F.col("n") + F.col("nulls") >= min_docs).select("h1", "h2", "last"), "lines")
    dropped = (
        found.join(shared, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("last")))
        .groupBy(F.col("row").alias("of"), "id").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    )  # at most the lines of one text
    own = others(docs.columns, ["n_lines", "n_dropped"])
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in own if c != text_col]).alias("own"), ident.alias("own_id"), row.alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("whole"))
    # only texts that may lose lines are shuffled
    dropped = stage(dropped, "dropped")
    bits = filter_bits(dropped.count())
    out = tested(out, "row", stage(bitmaps(dropped.select("of"), bits), "filter"), bits, "hit")
    some = out.where("hit").join(dropped, (F.col("row") == F.col("of")) & F.col("own_id").eqNullSafe(F.col("id")), "left").select("own", "whole", "gone")
    out = out.where("NOT hit").select("own", "whole", F.lit(None).cast("array<int>").alias("gone")).unionByName(some)
    out = out.withColumn("lines", F.split("whole", "\n"))
    # what stays is the runs of lines between those that go
    n_gone = F.size("gone")
    runs = F.transform(F.sequence(F.lit(0), n_gone), lambda k: F.struct(
        F.when(k == 0, 1).otherwise(F.element_at("gone", k) + 2).alias("from"),
        (F.when(k == n_gone, F.size("lines")).otherwise(F.get("gone", k)) - F.when(k == 0, 0).otherwise(F.element_at("gone", k) + 1)).alias("n")))
    kept = F.flatten(F.transform(runs, lambda r: F.slice("lines", r["from"], r["n"])))
    text = F.when(F.col("gone").isNull(), F.col("whole")).otherwise(F.array_join(kept, "\n"))
    return out.select(
        *[text.alias(c) if c == text_col else F.col(f"own.`{c}`").alias(c) for c in own], F.size("lines").cast("long").alias("n_lines"), F.coalesce(n_gone, F.lit(0)).cast("long").alias("n_dropped"))
