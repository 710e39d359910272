"""Pixel operators over long-form pages: (id, x, y, v) with grey values 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Two-tone limits, envelope of text pages, local threshold, error limits and ink limits.
DARK, LIGHT, TWO_TONE, CHROMATIC = 40, 215, 0.92, 0.005
INK_LOW, INK_HIGH, COLOUR, MEAN_AREA, COMPONENTS, MODERATE = 0.01, 0.35, 0.35, 220.0, 40, 0.115
LOCAL_K, LOCAL_R = 0.3, 128.0
ERROR, CONTRAST = 0.33, 4.0
BARE, KEPT, GAIN, MORE, FLOOD = 0.005, 0.3, 3.0, 0.35, 0.5


def luminance(r: Column, g: Column, b: Column) -> Column:
    return F.floor((r * 299 + g * 587 + b * 114) / 1000).cast("int")


def pixels(pages: DataFrame, key: str, values: Column, width: int) -> DataFrame:
    """Long form of pages that are arrays of rows."""
    out = pages.select(F.col(key).alias("id"), F.posexplode(values).alias("pos", "v"))
    return out.select("id", (F.col("pos") % width).alias("x"), F.floor(F.col("pos") / width).cast("int").alias("y"), "v")


def histogram(pix: DataFrame) -> DataFrame:
    return pix.groupBy("id", F.col("v").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def otsu(hist: DataFrame) -> DataFrame:
    """(id, threshold): the middle of the first and the last bin of greatest variance between classes.

    127 where one class would be empty at every bin.
    """
    bins = hist.select("id").distinct().select("id", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("bin"))
    full = bins.join(hist, ["id", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    upto = Window.partitionBy("id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("id")
    sums = full.select(
        "id", "bin", F.sum("n").over(upto).alias("w0"), F.sum("n").over(whole).alias("w"),
        F.sum(F.col("bin") * F.col("n")).over(upto).cast("double").alias("s0"), F.sum(F.col("bin") * F.col("n")).over(whole).cast("double").alias("s"))
    delta = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0"))
    split = sums.where("w0 > 0 AND w > w0").withColumn("d", delta)
    split = split.withColumn("variance", F.col("w0").cast("double") * (F.col("w") - F.col("w0")).cast("double") * F.col("d") * F.col("d"))
    best = split.withColumn("best", F.max("variance").over(whole)).where("variance = best")
    found = best.groupBy("id").agg(F.floor((F.min("bin") + F.max("bin")) / 2).cast("int").alias("threshold"))
    return hist.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("threshold", F.lit(127)).alias("threshold"))


def statistics(pix: DataFrame, chroma: Column | None = None) -> DataFrame:
    """Sampled pixels, extremes and chromatic ones of each page, and whether it is nearly two-tone."""
    strong = F.lit(False) if chroma is None else chroma > 25
    out = pix.groupBy("id").agg(F.count(F.lit(1)).alias("sampled"), F.count_if((F.col("v") <= DARK) | (F.col("v") >= LIGHT)).alias("extremes"), F.count_if(strong).alias("chromatic"))
    return out.withColumn("near_bilevel", (F.col("extremes") / F.col("sampled") > TWO_TONE) & (F.col("chromatic") / F.col("sampled") <= CHROMATIC))


def envelope(ink: Column, colour: Column, area: Column, components: Column, moderate: Column) -> Column:
    """notTextDominant, then chromaPattern, else null: the page is a page of text."""
    text = ink.between(INK_LOW, INK_HIGH) & (colour <= COLOUR) & (area > 0) & (area <= MEAN_AREA) & (components >= COMPONENTS)
    return F.when(~text, "notTextDominant").when(moderate > MODERATE, "chromaPattern")


def ink_counts(pix: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Pixels darker than their page's threshold, of all."""
    return pix.join(thresholds, "id").groupBy("id", "threshold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") < F.col("threshold")).alias("ink"))


def ink_ratio(pix: DataFrame, width: int, height: int, light: int = 245) -> DataFrame:
    """The share of pixels under `light` on a grid of about 6,000 pixels."""
    step = max(1, int((width * height / 6000) ** 0.5))
    grid = pix.where((F.col("x") % step == 0) & (F.col("y") % step == 0))
    return grid.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") < light).alias("ink"))


def box(pix: DataFrame, half: int, *measures: tuple[str, str, str]) -> DataFrame:
    """Sums or maxima over the square of each pixel, clipped at the page's edge, by two passes.

    measures are (result, 'sum' or 'max', column); the result n counts the square's pixels.
    """
    across = Window.partitionBy("id", "y").orderBy("x").rangeBetween(-half, half)
    down = Window.partitionBy("id", "x").orderBy("y").rangeBetween(-half, half)
    out = pix.withColumns({"n": F.count(F.lit(1)).over(across), **{r: getattr(F, f)(c).over(across) for r, f, c in measures}})
    return out.withColumns({"n": F.sum("n").over(down), **{r: getattr(F, f)(r).over(down) for r, f, c in measures}})


def local_ink(pix: DataFrame, half: int = 15) -> DataFrame:
    """Whether each pixel is darker than its surroundings' adaptive threshold."""
    out = box(pix.withColumn("vv", F.col("v") * F.col("v")), half, ("s", "sum", "v"), ("sq", "sum", "vv"))
    mean = F.col("s") / F.col("n")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("sq") / F.col("n") - mean * mean))
    return out.select("id", "x", "y", "n", "s", "sq", (F.col("v") < mean * (1 + LOCAL_K * (spread / LOCAL_R - 1))).alias("ink"))


def dilated(mask: DataFrame, half: int = 2) -> DataFrame:
    """(id, x, y, v) marks of 0 and 1 grown by half pixels in all directions."""
    return box(mask, half, ("v", "max", "v")).select("id", "x", "y", "v")


def masked_error(candidate: DataFrame, original: DataFrame, region: DataFrame) -> DataFrame:
    """Mean difference over the region against the original's spread there, and whether that passes.

    A page without region or without contrast passes with the error 0.
    """
    keys = ["id", "x", "y"]
    both = original.withColumnRenamed("v", "a").join(candidate.withColumnRenamed("v", "b"), keys).join(region.withColumnRenamed("v", "m"), keys)
    on = F.col("m") == 1
    sums = both.groupBy("id").agg(
        F.count_if(on).alias("n"), F.coalesce(F.sum(F.when(on, F.abs(F.col("a") - F.col("b")))), F.lit(0)).alias("d"),
        F.coalesce(F.sum(F.when(on, F.col("a"))), F.lit(0)).alias("s"), F.coalesce(F.sum(F.when(on, F.col("a") * F.col("a"))), F.lit(0)).alias("sq"))
    n = F.nullif(F.col("n"), F.lit(0))
    contrast = F.sqrt(F.greatest(F.lit(0.0), F.col("sq") / n - (F.col("s") / n) * (F.col("s") / n)))
    error = F.when(F.col("n").eqNullSafe(F.lit(0)) | (contrast < CONTRAST), 0.0).otherwise(F.col("d") / n / F.nullif(contrast, F.lit(0.0)))
    return sums.select("id", "n", F.round(error, 6).alias("error"), (error <= ERROR).alias("passes"))


def block_mean(pix: DataFrame, factor: int, wanted: Column | None = None) -> DataFrame:
    """Mean of the wanted pixels of each block; the page's mean of wanted ones where a block has none."""
    wanted = F.lit(True) if wanted is None else wanted
    v = F.when(wanted, F.col("v"))
    blocks = pix.groupBy("id", F.floor(F.col("x") / factor).cast("int").alias("block_x"), F.floor(F.col("y") / factor).cast("int").alias("block_y")).agg(F.sum(v).alias("s"), F.count(v).alias("n"))
    page = Window.partitionBy("id")
    fill = F.sum("s").over(page) / F.nullif(F.sum("n").over(page), F.lit(0))
    return blocks.select("id", "block_x", "block_y", "n", F.coalesce(F.try_divide(F.col("s"), F.col("n")), fill).alias("mean"))


def composite(mask: DataFrame, front: DataFrame, back: DataFrame) -> DataFrame:
    """The front's pixels where the mask is set, else the back's."""
    keys = ["id", "x", "y"]
    out = mask.withColumnRenamed("v", "m").join(front.withColumnRenamed("v", "f"), keys).join(back.withColumnRenamed("v", "b"), keys)
    return out.select(*keys, F.when(F.col("m") == 1, F.col("f")).otherwise(F.col("b")).alias("v"))


def validated(pages: DataFrame, key: str, sampled: Column) -> DataFrame:
    """Verdict per document over pages (before, after: ink shares; page, pages).

    A page bare before must not be flooded after; any other keeps 0.3 of its ink and gains at most
    threefold or 0.35.  If no sampled page had ink, all pages of the first 64 are compared.
    """
    bare = F.col("before") < BARE
    good = F.when(bare, F.col("after") <= FLOOD).otherwise((F.col("after") >= F.col("before") * KEPT) & (F.col("after") <= F.least(F.col("before") * GAIN, F.col("before") + MORE)))
    ok = F.coalesce(good, F.lit(False))
    sums = pages.groupBy(key).agg(
        F.count_if(sampled & ~bare).alias("compared"), F.coalesce(F.bool_and(F.when(sampled, ok)), F.lit(False)).alias("first_ok"),
        F.coalesce(F.bool_and(F.when(F.col("page") < 64, ok)), F.lit(False)).alias("all_ok"), F.count(F.lit(1)).alias("n"))
    return sums.select(key, "compared", (F.col("first_ok") & ((F.col("compared") > 0) | F.col("all_ok"))).alias("valid"))


def components(pix: DataFrame, thresholds: DataFrame, least: int = 3) -> DataFrame:
    """Number and mean area of the 8-connected ink regions of `least` pixels or more, a page a group.

    Runs of ink in a row are the nodes, and runs that touch in the next row the edges; labels are hooked and jumped
    over, so the rounds grow with the logarithm of a region's height.  A page has one row even without ink.
    """
    import numpy as np
    import pandas as pd

    def count(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        ink = part[part["v"] < part["threshold"]].sort_values(["y", "x"])
        x, y = ink["x"].to_numpy(np.int64), ink["y"].to_numpy(np.int64)
        head = np.flatnonzero(np.r_[True, (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)]) if len(x) else np.zeros(0, np.int64)
        size = np.diff(np.r_[head, len(x)])
        wide = int(part["x"].max()) + 3
        first, last = y[head] * wide + x[head] + 1, y[head] * wide + x[head] + size
        # runs of the next row that begin at most one pixel behind this one's end and end at most one before its beginning
        low, high = np.searchsorted(last, first + wide - 1), np.searchsorted(first, last + wide + 1, "right")
        n = np.maximum(0, high - low)
        a = np.repeat(np.arange(len(head)), n)
        b = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        label = np.arange(len(head))
        while True:
            least_ = np.minimum(label[a], label[b])
            new = label.copy()
            for at in (a, b, label[a], label[b]):
                np.minimum.at(new, at, least_)
            new = new[new]
            if (new == label).all():
                break
            label = new
        area = np.bincount(label, size) if len(head) else np.zeros(0)
        area = area[area >= least]
        return pd.DataFrame({"id": [key[0]], "components": [len(area)], "mean_area": [float(area.mean()) if len(area) else 0.0]})

    kind = dict(pix.dtypes)["id"]
    return pix.join(thresholds, "id").groupBy("id").applyInPandas(count, f"id {kind}, components long, mean_area double")


def chroma(r: Column, g: Column, b: Column) -> Column:
    return F.greatest(r, g, b) - F.least(r, g, b)


# Spreads of the channels that make a pixel coloured, and moderately coloured.
COLOURED, MODERATELY = 40, 25


def page_features(colours: DataFrame) -> DataFrame:
    """Features of each page of (id, x, y, r, g, b) and the verdict that they give.

    Columns: threshold, n, ink, coloured and moderate pixels, components, mean_area, verdict (null: a page of text).
    """
    pix = colours.select("id", "x", "y", luminance(F.col("r"), F.col("g"), F.col("b")).alias("v"), chroma(F.col("r"), F.col("g"), F.col("b")).alias("c"))
    limits = otsu(histogram(pix))
    sums = pix.join(limits, "id").groupBy("id", "threshold").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") < F.col("threshold")).alias("ink"), F.count_if(F.col("c") > COLOURED).alias("coloured"), F.count_if(F.col("c") > MODERATELY).alias("moderate"))
    out = sums.join(components(pix, limits), "id")
    share = lambda c: F.col(c) / F.col("n")
    return out.withColumn("verdict", envelope(share("ink"), share("coloured"), F.col("mean_area"), F.col("components"), share("moderate")))
