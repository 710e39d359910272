"""Folds over rows: savings, counts, progress and screen states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.rows import degraded, partition_class, terminal


def saved_bytes(original: Column, shipped: Column) -> Column:
    """Sum of what shipping saved, over rows with a shipped version; may be negative."""
    return F.coalesce(F.sum(original - shipped), F.lit(0)).cast("long")


def batch_records(rows: DataFrame, key: str) -> DataFrame:
    """One record per run of rows (state, before, after, searchable, compress, ocr, cancelled, queued).

    file_count has all rows of the run, the rest only freshly queued ones; each row's saving is at
    least 0.  A cancelled run that delivered nothing leaves no record.
    """
    fresh = F.coalesce(F.col("queued"), F.lit(True))
    done = fresh & (F.col("state") == "done")
    out = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("file_count"),
        F.coalesce(F.sum(F.when(done, F.greatest(F.lit(0), F.col("before") - F.col("after")))), F.lit(0)).cast("long").alias("saved_bytes"),
        F.count_if(done & F.col("searchable")).alias("searchable_count"),
        F.count_if(done).alias("success_count"),
        F.coalesce(F.bool_or(fresh & (F.col("state") == "failed")), F.lit(False)).alias("problem"),
        F.coalesce(F.bool_or(done & degraded(F.col("compress"), F.col("ocr"))), F.lit(False)).alias("partial"),
        F.coalesce(F.bool_or("cancelled"), F.lit(False)).alias("cancelled"),
    )
    return out.where(~(F.col("cancelled") & (F.col("success_count") == 0)))


def finished_totals(rows: DataFrame, *keys: str) -> DataFrame:
    """Bytes before and after and the number of rows that have both, and the searchable rows."""
    sized = F.col("before").isNotNull() & F.col("after").isNotNull()
    return rows.groupBy(*keys).agg(
        F.sum(F.when(sized, F.col("before"))).alias("total_before"), F.sum(F.when(sized, F.col("after"))).alias("total_after"),
        F.count_if(sized).alias("counted"), F.count_if("searchable").alias("searchable_count"))


def pending_totals(rows: DataFrame, *keys: str) -> DataFrame:
    """Input bytes of pending rows; the predicted total only if every one of them has an estimate."""
    whole = F.count("predicted") == F.count(F.lit(1))
    return rows.groupBy(*keys).agg(
        F.sum("size").alias("input_bytes"), F.count("size").alias("sized"), F.count(F.lit(1)).alias("pending"),
        F.when(whole, F.sum("predicted")).alias("predicted_bytes"))


def run_progress(rows: DataFrame, *keys: str) -> DataFrame:
    """The run's fraction (terminal rows count 1, the running one its own), and counts of rows by class.

    Columns used: state, fraction.  An empty run has the fraction 0.
    """
    part = F.when(terminal(F.col("state")), 1.0).when(F.col("state") == "running", F.col("fraction")).otherwise(0.0)
    return rows.groupBy(*keys).agg(
        F.coalesce(F.avg(part), F.lit(0.0)).alias("run_fraction"),
        F.count_if(F.col("state") == "done").alias("delivered"), F.count(F.lit(1)).alias("total"),
        F.coalesce(F.bool_and(terminal(F.col("state"))), F.lit(False)).alias("all_finished"))


def screen_state(rows: DataFrame, *keys: str) -> DataFrame:
    """empty, working, ready, problems or finished, from flags over (state, problem, skipped)."""
    kind = partition_class(F.col("state"), F.col("problem"), F.col("skipped"))
    any_of = lambda *names: F.coalesce(F.bool_or(kind.isin(*names)), F.lit(False))
    return rows.groupBy(*keys).agg(
        F.coalesce(F.bool_or(F.col("state") == "running"), F.lit(False)).alias("__run"), any_of("delivered", "failedSkipped", "failedActionable").alias("__end"),
        any_of("failedActionable").alias("__failed"), any_of("problemUnresolved").alias("__open"), any_of("cleanPending").alias("__clean"),
        F.count(F.lit(1)).alias("n_rows"), F.count_if(kind.isin("failedActionable", "problemUnresolved")).alias("needs_attention"),
        F.count_if(kind == "cleanPending").alias("healthy_queued"),
    ).select(*keys, "n_rows", "needs_attention", "healthy_queued",
        F.when(F.col("n_rows") == 0, "empty").when(F.col("__run"), "working").when(~F.col("__end"), "ready")
        .when(F.col("__clean") & ~F.col("__failed") & ~F.col("__open"), "ready")
        .when(F.col("__failed") | F.col("__open"), "problems").otherwise("finished").alias("screen"))


def can_start(rows: DataFrame, *keys: str) -> DataFrame:
    """Some clean row waits, some verb is on, nothing runs, no problem is open, the folder exists and is writable."""
    kind = partition_class(F.col("state"), F.col("problem"), F.col("skipped"))
    return rows.groupBy(*keys).agg((
        F.bool_or(kind == "cleanPending") & F.bool_or(F.col("compress_on") | F.col("ocr_on")) & ~F.bool_or(F.col("state") == "running")
        & ~F.bool_or(kind == "problemUnresolved") & F.bool_and("folder_exists") & F.bool_and("folder_writable")).alias("can_start"))


def armed_summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Armed and waiting rows, and what re-running would save over rows with a prediction (null without any)."""
    armed = F.col("rerun") == "armed"
    return rows.groupBy(*keys).agg(
        F.count_if(armed).alias("armed"), F.count_if("waiting").alias("waiting"),
        F.sum(F.when(armed, F.col("current") - F.col("predicted"))).alias("extra_saving"),
    ).where("armed > 0")


def first_failure(rows: DataFrame, key: str, note: Column) -> DataFrame:
    """The note of the first failed row in list order; null if none failed."""
    failed = F.col("state") == "failed"
    return rows.groupBy(key).agg(F.min_by(F.when(failed, note), F.when(failed, F.col("pos"))).alias("failure_note"))


def page_rate(duration: Column, pages: Column) -> Column:
    return F.try_divide(duration.cast("double"), F.nullif(pages, F.lit(0)))


def capped_sum(value: Column, cap: int) -> Column:
    """The sum, or an error once it passes the cap."""
    total = F.sum(value)
    return F.when(F.assert_true(total <= cap, F.lit(f"more than {cap}")).isNull(), total)


#: So many presets may be compared at once.
MOST = 64


def change_quality_totals(rows: DataFrame, candidates: DataFrame, *keys: str) -> DataFrame:
    """Bytes of each group's rows under each candidate preset.

    rows have current, own_preset, predictions (map of preset to bytes), excluded and futile (array of
    presets); candidates have preset: more than MOST different ones are an error.  A row that is excluded, has the preset already or has tried
    it in vain counts its current bytes, and so does one without a prediction.
    """
    stays = F.coalesce(F.col("excluded"), F.lit(False)) | F.col("own_preset").eqNullSafe(F.col("preset")) | F.coalesce(F.array_contains("futile", F.col("preset")), F.lit(False))
    size = F.when(stays, F.col("current")).otherwise(F.coalesce(F.try_element_at("predictions", F.col("preset")), "current"))
    presets = [r["preset"] for r in candidates.select("preset").distinct().orderBy("preset").limit(MOST + 1).collect()]
    if len(presets) > MOST:
        raise ValueError(f"more than {MOST} candidate presets")
    wide = rows.withColumn("preset", F.explode(F.array(*map(F.lit, presets)).cast("array<string>")))
    return wide.groupBy(*keys, "preset").agg(F.sum(size).cast("long").alias("total_bytes"), F.count_if(~stays).alias("changed"))


def encoded_pages(verdicts: DataFrame, *keys: str) -> DataFrame:
    """How many of a document's page verdicts say that layers were encoded, of how many."""
    return verdicts.groupBy(*keys).agg(F.count_if(F.col("verdict") == "mrcEncoded").alias("encoded"), F.count(F.lit(1)).alias("pages"))


def all_finished(rows: DataFrame, *keys: str) -> DataFrame:
    """Whether a run has rows, all of them terminal and none armed for another pass."""
    armed = F.coalesce(F.col("rerun") == "armed", F.lit(False))
    return rows.groupBy(*keys).agg((F.bool_and(terminal(F.col("state"))) & ~F.bool_or(armed)).alias("all_finished"))


def lifetime(records: DataFrame) -> DataFrame:
    """What all batches have saved, and how many there are."""
    return records.agg(F.coalesce(F.sum("saved_bytes"), F.lit(0)).cast("long").alias("lifetime_saved"), F.count(F.lit(1)).alias("batches"))
