"""Races, first matches, retention and cards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.plans.staging import stage


def race(kind: Column, size: Column, baseline: Column, baseline_valid: Column, ccitt: Column, ccitt_valid: Column, mrc: Column, mrc_valid: Column, rebuild: Column, preset: Column) -> Column:
    """The shipped candidate and its runner-up, by ordered rules; a tie never beats what came before.

    status is failed (no baseline bytes, or an invalid baseline that would ship), noGain, or shipped;
    runner_up is null, baseline, mrc or original.
    """
    ok = lambda c: F.coalesce(c, F.lit(False))
    bilevel = ok((kind == "scanBilevel") & (ccitt < baseline) & (ccitt < size) & ccitt_valid)
    wants = ok((kind == "scanColour") & rebuild & (preset != "maximum"))
    layered = wants & ok((mrc < size) & mrc_valid)
    wins = layered & ok(mrc < baseline)
    parked = F.when(wins, F.when(baseline < size, "baseline").otherwise("original")).when(layered, "mrc")
    made = lambda status, winner, runner, shipped: F.struct(F.lit(status).alias("status"), winner.alias("winner"), runner.alias("runner_up"), shipped.cast("long").alias("shipped_bytes"))
    none = F.lit(None).cast("string")
    return (
        F.when(~ok(baseline > 0), made("failed", none, none, F.lit(None)))
        .when(bilevel, made("shipped", F.lit("ccitt"), none, ccitt))
        .when(wins, made("shipped", F.lit("mrc"), parked, mrc))
        .when(baseline >= size, made("noGain", none, parked, size))
        .when(~ok(baseline_valid), made("failed", none, none, F.lit(None)))
        .otherwise(made("shipped", F.lit("baseline"), parked, baseline))
    )


def newest(rows: DataFrame, order: list[Column], keep: int = 200) -> DataFrame:
    """The newest rows, at most `keep`: the list that is retained."""
    return rows.orderBy(*order).limit(keep)


def first_match(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min_by(value, order).alias(value))


def version_cards(rows: DataFrame, keys: list[str], slots: list[str]) -> DataFrame:
    """Cards of a row in slot order, of slots that are filled; an original already among them is left out.

    Rows of equal keys share one list of cards: all of a slot, by bytes, variant and url, before those of the next.
    """
    filled = {s: F.col(s).isNotNull() for s in slots}
    again = F.lit(False)
    for s in slots:
        if s != "original":
            again = again | F.coalesce(F.col(f"{s}.variant") == "original", F.lit(False))
    shown = {s: (filled[s] & ~again if s == "original" else filled[s]) for s in slots}
    flags = rows.select(*keys, *slots, *(v.cast("int").alias(f"__on_{s}") for s, v in shown.items()))
    at, cards = F.lit(0), []
    for k, s in enumerate(slots):
        cards.append(F.struct(F.col(f"__on_{s}").alias("on"), at.alias("pos"), F.lit(s).alias("slot"), F.col(f"{s}.url").alias("url"), F.col(f"{s}.bytes").alias("bytes"), F.col(f"{s}.variant").alias("variant"), F.lit(k).alias("k")))
        at = at + F.col(f"__on_{s}")
    made = lambda some: some.select(*keys, F.explode(F.array(*cards)).alias("card")).where("card.on = 1").select(*keys, "card.*")
    shared = stage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*(F.col(c).alias(f"__{c}") for c in keys)), "shared")
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("k", "bytes", "variant", "url")) - 1
    out = made(flags.join(shared, same, "left_anti")).unionByName(made(flags.join(shared, same, "left_semi")).withColumn("pos", place))
    return out.select(*keys, "pos", "slot", "url", "bytes", "variant")


def variant_pairs(rows: DataFrame, key: str, variant: str, size: str) -> DataFrame:
    """Rows that hold exactly one rebuilt and one plain version, side by side."""
    own = lambda v: F.max(F.when(F.col(variant) == v, F.col(size)))
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), own("mrc").alias("mrc_bytes"), own("plain").alias("plain_bytes"))
    return out.where("n = 2 AND mrc_bytes IS NOT NULL AND plain_bytes IS NOT NULL").drop("n")
