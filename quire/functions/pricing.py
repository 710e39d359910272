"""Predicted sizes of documents by kind and preset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Presets with resolution, resolution of two-tone pages, quantiser factor, background and
# foreground layer quality, and reductions: typical, of rebuilt colour scans, and by content type.
PRESETS = {"maximum": (300, 600, 0.76, 0.40, 0.30), "balanced": (150, 300, 1.5, 0.40, 0.30), "smallest": (100, 300, 3.0, 0.30, 0.25)}
TYPICAL = {"maximum": 0.10, "balanced": 0.35, "smallest": 0.55}
REBUILT = {"balanced": 0.82, "smallest": 0.90}
BY_TYPE = {
    "bornDigital": {"maximum": 0.05, "balanced": 0.10, "smallest": 0.15},
    "mixedColour": {"maximum": 0.10, "balanced": 0.35, "smallest": 0.55},
    "scanColour": {"maximum": 0.12, "balanced": 0.45, "smallest": 0.65},
    "scanBilevel": {"maximum": 0.05, "balanced": 0.20, "smallest": 0.30},
}
BASELINE = 20_000.0


# Presets that keep ink separations as they are; the others turn them into screen colours.
KEEPS_CMYK = ["maximum"]


def presets(spark: SparkSession) -> DataFrame:
    """The three presets: a table of fixed size."""
    rows = [(k, *v, k in KEEPS_CMYK) for k, v in PRESETS.items()]
    return spark.createDataFrame(rows, "preset string, dpi int, mono_dpi int, q_factor double, background double, foreground double, keeps_cmyk boolean")


def reductions(spark: SparkSession) -> DataFrame:
    """(content_type, preset, base) with the typical rows under a null type: a table of fixed size."""
    rows = [(t, p, x) for t, table in BY_TYPE.items() for p, x in table.items()]
    return spark.createDataFrame([*rows, *((None, p, x) for p, x in TYPICAL.items())], "content_type string, preset string, base double")


def payload_ratio(size: Column, pages: Column, baseline: float = BASELINE) -> Column:
    """The share of a page's bytes beyond a text page's; without pages the document is one page."""
    per_page = F.when(pages > 0, size / pages).otherwise(size.cast("double"))
    return F.when(per_page > baseline, 1.0 - F.lit(baseline) / per_page).otherwise(0.0)


def predicted(size: Column, content_type: Column, base: Column, payload: Column) -> Column:
    """Bytes after the reduction, at least one; only scans depend on their payload."""
    reduction = F.when(content_type == "bornDigital", base).otherwise(base * (0.3 + 0.7 * payload))
    return F.greatest(F.lit(1).cast("long"), (size * (1 - reduction)).cast("long"))


def price(docs: DataFrame, baseline: float = BASELINE) -> DataFrame:
    """docs (size, pages, content_type, rebuild) with every preset: predicted and is_fallback.

    The base is that of a rebuilt scan, else of the content type, else the typical one, else 0.2.  A
    document whose type or pages are unknown gets the typical reduction as a fallback.
    """
    spark = docs.sparkSession
    table = reductions(spark)
    typed = table.where("content_type IS NOT NULL").withColumnsRenamed({"base": "__typed", "content_type": "__type", "preset": "__preset"})
    typical = table.where("content_type IS NULL").select(F.col("preset").alias("__p"), F.col("base").alias("__typical"))
    rows = docs.withColumn("preset", F.explode(F.array(*map(F.lit, PRESETS))))
    rows = rows.join(F.broadcast(typed), (F.col("content_type") == F.col("__type")) & (F.col("preset") == F.col("__preset")), "left")
    rows = rows.join(F.broadcast(typical), F.col("preset") == F.col("__p"), "left")
    rebuilt = F.when(F.coalesce(F.col("rebuild"), F.lit(True)) & (F.col("content_type") == "scanColour"), F.when(F.col("preset") == "balanced", REBUILT["balanced"]).when(F.col("preset") == "smallest", REBUILT["smallest"]))
    base = F.coalesce(rebuilt, "__typed", "__typical", F.lit(0.2))
    known = F.col("content_type").isNotNull() & F.col("pages").isNotNull()
    fallback = F.greatest(F.lit(1).cast("long"), (F.greatest(F.col("size"), F.lit(1)) * (1 - F.coalesce(F.col("__typical"), F.lit(0.3)))).cast("long"))
    sure = predicted(F.col("size"), F.col("content_type"), base, payload_ratio(F.col("size"), F.col("pages"), baseline))
    return rows.withColumns({"predicted": F.when(known, sure).otherwise(fallback), "is_fallback": ~known}).drop("__type", "__preset", "__typed", "__p", "__typical")


def calibrated(raw: Column, shipped: Column, baseline: Column, same_path: Column, original: Column) -> Column:
    """A prediction scaled by what shipping has shown; null if it does not beat the original."""
    scaled = F.when(same_path & (baseline > 0), (shipped.cast("double") / baseline * raw).cast("long")).otherwise(raw)
    return F.when(scaled < original, scaled)
