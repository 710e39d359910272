"""Exact dedup in two Bloom passes: only rows whose text may repeat are shuffled.

Pass one groups the 64-bit hashes of the normalised texts and sets two bits in a filter for each hash
that occurs twice; the filter grows with those, up to what is broadcast.  Pass two tests each row against the filter: a row with a clear bit is certainly
unique and passes straight through; the others are grouped by the SHA-256 of the normalised text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans.staging import drop_stage, stage

BLANKS = " \t\n\x0b\x0c\r"
BITS_A_ROW = 16
#: The largest filter (64 MB): it is broadcast.  With more hashes than it has room for, more rows that are unique are shuffled.
BROADCAST_BITS = 1 << 29
#: Bits of one bitmap; both bits of a hash lie in one.
BUCKET = 1 << 15


def normalised(text: Column) -> Column:
    """The text without any of the six ASCII blanks; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def filter_bits(rows: int, per_row: int = BITS_A_ROW) -> int:
    """The size of a filter for so many rows: it grows with them, so that the share of false hits does not."""
    return 1 << max(12, (max(rows, 1) * per_row - 1).bit_length())


def buckets(bits: int) -> int:
    """How many bitmaps a filter of so many bits has, up to the largest that is broadcast."""
    return max(1, min(bits, BROADCAST_BITS) // BUCKET)


def positions(digest: Column) -> list[Column]:
    """Two positions of a 64-bit hash within its bitmap."""
    return [F.pmod(F.xxhash64(digest, F.lit(k)), F.lit(BUCKET)) for k in (2, 3)]


def bitmaps(digests: DataFrame, bits: int) -> DataFrame:
    """(bucket, bitmap) of a filter in which the bits of the hashes of a one-column table are set."""
    digest = F.col(digests.columns[0])
    return (
        digests.select(F.pmod(digest, F.lit(buckets(bits))).alias("bucket"), F.explode(F.array(*positions(digest))).alias("position"))
        .groupBy("bucket").agg(F.bitmap_construct_agg("position").alias("bitmap"))
    )


def bit(bitmap: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (position % 8).cast("int")), F.lit(0)) == 1


def tested(rows: DataFrame, digest: str, found: DataFrame, bits: int, flag: str) -> DataFrame:
    """rows with a flag: whether both bits of the digest are set in a staged filter of bitmaps().  No row is shuffled."""
    side = F.broadcast(found.select(F.col("bucket").alias(f"{flag}_b"), F.col("bitmap").alias(f"{flag}_m")))  # at most BROADCAST_BITS
    rows = rows.join(side, F.pmod(F.col(digest), F.lit(buckets(bits))) == F.col(f"{flag}_b"), "left")
    one, two = (bit(F.col(f"{flag}_m"), at) for at in positions(F.col(digest)))
    return rows.withColumn(flag, one & two).drop(f"{flag}_b", f"{flag}_m")


def others(columns: list[str], added: list[str]) -> list[str]:
    """The columns that are not named like added ones; Spark does not tell upper from lower case."""
    return [c for c in columns if c.lower() not in {a.lower() for a in added}]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256 added, which replace columns so named in any case.

    Texts are equal when they are identical after deleting the blanks space, tab, newline, vertical
    tab, form feed and carriage return; a null text counts as empty.  Of equal texts the row with the
    most code points in the original stays, then the smallest id (a null id comes last).  Of rows
    that also share the id, one stays.  An empty table gives an empty result.
    """
    own = others(docs.columns, ["keep_id", "group_size", "kept", "text_sha256"])
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    norm = normalised(text)
    twice = stage(docs.select(F.xxhash64(norm).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "twice")
    bits = filter_bits(twice.count())
    found = stage(bitmaps(twice, bits), "bloom")
    drop_stage(twice)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("own"), F.col(f"`{id_col}`").alias("id"), F.sha2(norm.cast("binary"), 256).alias("sha"),
        (-F.char_length(text)).alias("short"), F.xxhash64(norm).alias("h"))
    rows = tested(rows, "h", found, bits, "again").drop("h")
    columns = [F.col(f"own.`{c}`").alias(c) for c in own]
    once = rows.where("NOT again").select(*columns, F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))

    again = stage(rows.where("again").drop("again").withColumn("row", F.monotonically_increasing_id()), "again")
    order = F.struct("short", F.col("id").isNull().alias("none"), "id", "row")
    groups = again.groupBy("sha").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size"))
    many = again.join(stage(groups, "copies"), "sha").select(
        *columns, F.col("best.id").alias("keep_id"), "group_size", (F.col("best.row") == F.col("row")).alias("kept"), F.col("sha").alias("text_sha256"))
    return once.unionByName(many)
