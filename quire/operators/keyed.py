"""Keyed lookups, set operations and the version store as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlay(jobs: DataFrame, key: str, estimates: DataFrame, failures: DataFrame, progress: DataFrame, reruns: DataFrame, analysing: DataFrame) -> DataFrame:
    """jobs with a shown state: failure over recompression over re-run over analysis over the job's own."""
    mark = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    out = jobs.join(estimates, key, "left").join(failures.select(key, F.col("message").alias("__failed")), key, "left")
    out = out.join(progress.select(key, F.col("fraction").alias("__fraction")), key, "left").join(mark(reruns, "__rerun"), key, "left").join(mark(analysing, "__analysing"), key, "left")
    shown = (
        F.when(F.col("__failed").isNotNull(), "failed").when(F.col("__fraction").isNotNull(), "running")
        .when(F.col("__rerun"), "queued").when(F.col("__analysing"), "analysing").otherwise(F.col("state"))
    )
    return out.withColumn("shown_state", shown).withColumnsRenamed({"__failed": "failure", "__fraction": "shown_fraction"}).drop("__rerun", "__analysing")


def effective(jobs: DataFrame, overrides: DataFrame, key: str, settings: dict[str, Column]) -> DataFrame:
    """Each setting from the row's own override, else the batch's; and whether any differs from the batch."""
    out = jobs.join(overrides.select(key, *(F.col(c).alias(f"__{c}") for c in settings)), key, "left")
    differs = F.lit(False)
    for name, value in settings.items():
        own = F.coalesce(F.col(f"__{name}"), value)
        out = out.withColumn(name, own)
        differs = differs | ~F.col(name).eqNullSafe(value)
    return out.withColumn("differs", differs).drop(*(f"__{c}" for c in settings))


def effective_verbs(compress: Column, ocr: Column, batch_compress: Column) -> tuple[Column, Column]:
    """An override that would leave no verb falls back to the batch's compression."""
    none = ~compress & ~ocr
    return F.when(none, batch_compress).otherwise(compress), ocr


def normalised(overrides: DataFrame, settings: dict[str, Column]) -> DataFrame:
    """Overrides without fields equal to the batch's, and without rows that override nothing."""
    out = overrides.withColumns({c: F.when(~F.col(c).eqNullSafe(v), F.col(c)) for c, v in settings.items()})
    return out.where(F.coalesce(*(F.col(c).cast("string") for c in settings)).isNotNull())


def restored(snapshot: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of either side with the snapshot's value, which is null where it had none: a deletion."""
    joined = snapshot.select(key, F.col(value).alias("__s"), F.lit(True).alias("__had")).join(current.select(key, F.col(value).alias("__c")), key, "full_outer")
    return joined.select(key, F.col("__s").alias(value), F.col("__had").isNull().alias("deleted"))


def live_only(side: DataFrame, live: DataFrame, key: str) -> DataFrame:
    return side.join(live, key, "left_semi")


def discarded(side: DataFrame, live: DataFrame, key: str) -> DataFrame:
    return side.join(live, key, "left_anti")


def first_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, the first in order."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in rows.columns]), order).alias("__v")).select("__v.*")


def page_pairs(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Pages of two documents side by side, with a flag where either is missing."""
    a, b = left.select(*keys, F.col(value).alias("left_value")), right.select(*keys, F.col(value).alias("right_value"))
    return a.join(b, keys, "full_outer").withColumn("missing", F.col("left_value").isNull() | F.col("right_value").isNull())


def output_names(rows: DataFrame, folder: str, base: str, order: str, suffix: str = "small", extension: str = "pdf") -> DataFrame:
    """<base>-<suffix>.<ext>, then -1, -2 and so on for later rows of the same reservation key.

    Right where no name is taken before; else use exact_output_names.
    """
    turn = F.row_number().over(Window.partitionBy(folder, F.lower(base)).orderBy(order)) - 1
    return rows.withColumn("output_name", _numbered(F.col(base), turn, suffix, extension))


def _numbered(base: Column, turn: Column, suffix: str, extension: str) -> Column:
    return F.concat(base, F.lit(f"-{suffix}"), F.when(turn > 0, F.concat(F.lit("-"), turn.cast("string"))).otherwise(""), F.lit(f".{extension}"))


def exact_output_names(rows: DataFrame, folder: str, base: str, order: str, suffix: str = "small", extension: str = "pdf", taken: DataFrame | None = None) -> DataFrame:
    """Names given in order, each the first number of its base that neither a row before nor `taken` (folder, name) has.

    Names of different bases never meet, whatever the case: a generated name ends with the suffix and its
    number.  So a base's rows and its taken numbers are sorted together: the i-th row gets i and the taken
    numbers before it, where the j-th taken number t counts from t - j on.
    """
    if taken is None:
        return output_names(rows, folder, base, order, suffix, extension)
    stem = f"^(.*)-{suffix}(?:-([1-9][0-9]{{0,17}}))?\\.{extension}$"
    used = taken.select(folder, F.lower("name").alias("name")).distinct().where(F.col("name").rlike(stem))
    used = used.select(folder, F.regexp_extract("name", stem, 1).alias("__key"), F.coalesce(F.nullif(F.regexp_extract("name", stem, 2), F.lit("")).cast("long"), F.lit(0)).alias("__n"))
    by = [folder, "__key"]
    free = F.col("__n") - (F.row_number().over(Window.partitionBy(*by).orderBy("__n")) - 1)
    own = rows.withColumn("__key", F.lower(base)).withColumn("__at", (F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1).cast("long"))
    both = own.withColumn("__row", F.lit(1)).unionByName(used.select(*by, free.alias("__at"), F.lit(0).alias("__row")), allowMissingColumns=True)
    before = F.count_if(F.col("__row") == 0).over(Window.partitionBy(*by).orderBy("__at", "__row").rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("__turn", F.col("__at") + before).where("__row = 1")
    return out.withColumn("output_name", _numbered(F.col(base), F.col("__turn"), suffix, extension)).select(*rows.columns, "output_name")


def free_names(asked: DataFrame, ledger: DataFrame, cards: DataFrame) -> DataFrame:
    """Of asked (owner, name) those that no other owner in the ledger (owner, name) reserves and no version card has.

    cards are (owner, slot, name); cards of originals do not count, and the asking owner's own entries in the
    ledger do not either.  Names are compared by their lower-cased keys.
    """
    key = F.lower("name").alias("__key")
    owners = ledger.groupBy(key).agg(F.min("owner").alias("__one"), F.max("owner").alias("__two"))
    held = cards.where(F.col("slot") != "original").select(key).distinct()
    out = asked.withColumn("__key", key).join(held, "__key", "left_anti").join(owners, "__key", "left")
    other = (F.col("__one") != F.col("owner")) | (F.col("__two") != F.col("owner"))
    return out.where(~F.coalesce(other, F.lit(False))).select(*asked.columns)


def runnable(jobs: DataFrame, skipped: DataFrame, plans: DataFrame, key: str) -> DataFrame:
    """(key, plan): queued rows that are not skipped, and then rows armed for another pass."""
    fresh = discarded(jobs.where(F.col("state") == "queued"), skipped, key).select(key, F.lit("first").alias("plan"))
    armed = plans.where(F.col("rerun") == "armed").join(jobs.where(F.col("state") == "done").select(key), key, "left_semi")
    return fresh.unionByName(armed.select(key, F.lit("again").alias("plan")))


def without_completed(jobs: DataFrame) -> DataFrame:
    """The list after its done and failed rows are removed; a row without a state stays."""
    return jobs.where(~F.coalesce(F.col("state").isin("done", "failed"), F.lit(False)))


def record_versions(store: DataFrame, fresh: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The store with fresh rows in place of those of their keys, and the parked files that this leaves unused."""
    kept = store.join(fresh, key, "left_anti").unionByName(fresh)
    used = fresh.select(key, F.explode("parked").alias("url"))
    old = store.join(fresh.select(key), key, "left_semi").select(key, F.explode("parked").alias("url"))
    return kept, old.join(used, [key, "url"], "left_anti")


def parked_urls(*urls: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(*urls)))


def swapped(shipped: str, parked: str, fields: list[str]) -> dict[str, Column]:
    """Both slots with each other's fields; their urls stay."""
    pick = lambda own, other: F.when(F.col(shipped).isNotNull() & F.col(parked).isNotNull(), F.struct(F.col(f"{own}.url").alias("url"), *(F.col(f"{other}.{f}").alias(f) for f in fields))).otherwise(F.col(own))
    return {shipped: pick(shipped, parked), parked: pick(parked, shipped)}


def committed(rows: DataFrame) -> DataFrame:
    """After a re-run: compressed moves shipped to previous and ships the new one; noGain marks the attempt futile."""
    won = F.col("outcome") == "compressed"
    return rows.withColumns({
        "previous": F.when(won, F.col("shipped")).otherwise(F.col("previous")),
        "shipped": F.when(won, F.col("candidate")).otherwise(F.col("shipped")),
        "futile": F.col("outcome") == "noGain",
    })
