"""The history envelope as a JSON source and sink."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = (
    "id string, date timestamp, folderName string, folderURL string, fileCount long, presetTitle string, compressOn boolean, ocrOn boolean, savedBytes long, "
    "searchableCount long, successCount long, failureNote string, partial boolean, problem boolean, cancelled boolean"
)
ENVELOPE = f"version int, batches array<struct<{', '.join(': '.join(x.rsplit(' ', 1)) for x in BATCH.split(', ')).replace(': ', ':')}>>, lifetimeSavedBytes long"
RETAINED, LONGEST = 200, 200
#: The envelope within its folder.
NAME = "envelope.json"


def decoded(batch: Column) -> Column:
    """A batch with its defaults: no successes unless given, texts cut to 200 characters."""
    out = batch
    for name, value in (
        ("successCount", F.coalesce(batch["successCount"], F.lit(0).cast("long"))),
        ("folderName", F.left(batch["folderName"], F.lit(LONGEST))),
        ("failureNote", F.left(batch["failureNote"], F.lit(LONGEST))),
    ):
        out = out.withField(name, value)
    return out


def sound(batches: Column) -> Column:
    """Every batch names a file address; one other address rejects the whole envelope."""
    return F.forall(batches, lambda b: F.coalesce(F.lower(b["folderURL"]).startswith("file:"), F.lit(False)))


def read_history(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """The batches of an envelope, newest first, at most 200; none if it is of another version or broken."""
    raw = spark.read.schema(ENVELOPE).option("mode", "PERMISSIVE").option("multiLine", True).json(path)
    good = raw.where((F.col("version") == version) & F.coalesce(sound(F.col("batches")), F.lit(False)))
    rows = good.select(F.posexplode(F.slice("batches", 1, RETAINED)).alias("pos", "b"))
    return rows.select("pos", decoded(F.col("b")).alias("b")).select("pos", "b.*")


def write_history(batches: DataFrame, lifetime: int | DataFrame, path: str, version: int = 1) -> None:
    """Replaces the envelope in the folder by one with these batches (a column pos gives their order).

    lifetime is a number, or a table whose column savedBytes is summed.  The new envelope is written beside the
    old one and takes its place by one rename, so that readers find one of the two whole, whatever fails.
    """
    spark = batches.sparkSession
    fields = [f for f in batches.columns if f != "pos"]
    ordered = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("b")))), lambda x: x["b"]), 1, RETAINED)
    kept = batches.orderBy("pos").limit(RETAINED).agg(ordered.alias("batches"))
    if isinstance(lifetime, DataFrame):
        total = lifetime.agg(F.coalesce(F.sum("savedBytes"), F.lit(0)).cast("long").alias("lifetime"))
    else:
        total = spark.range(1).select(F.lit(lifetime).cast("long").alias("lifetime"))
    both = kept.unionByName(total, allowMissingColumns=True).agg(F.first("batches", ignorenulls=True).alias("batches"), F.first("lifetime", ignorenulls=True).alias("lifetimeSavedBytes"))
    beside = f"{path.rstrip('/')}/_new-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(conf)
    try:
        both.select(F.lit(version).alias("version"), "batches", "lifetimeSavedBytes").coalesce(1).write.json(beside)
        part = next(s.getPath() for s in fs.listStatus(at(beside)) if s.getPath().getName().startswith("part-"))
        _replace(spark, part, at(f"{path.rstrip('/')}/{NAME}"))
        for old in fs.listStatus(at(path)):  # envelopes of another name
            if not old.getPath().getName().startswith(("_", ".")) and old.getPath().getName() != NAME:
                fs.delete(old.getPath(), True)
    finally:
        fs.delete(at(beside), True)


def _replace(spark: SparkSession, part, target) -> None:
    """One rename over what may be there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(part, target, options)


def release(feed: Column) -> Column:
    """Tag, page and first disk image of a release feed; null unless all addresses are pinned and the tag is sound."""
    schema = "tag_name string, html_url string, assets array<struct<browser_download_url:string>>"
    r = F.from_json(feed, schema)
    image = F.get(F.filter(r["assets"], lambda a: a["browser_download_url"].endswith(".dmg")), F.lit(0))["browser_download_url"]
    tag = F.regexp_replace(r["tag_name"], "^[vV]", "")
    host = lambda u: F.regexp_extract(u, "^https://([^/:?#]*)", 1) == "github.com"
    ok = (F.length(tag) <= 32) & (F.size(F.split(tag, r"\.")) <= 8) & tag.rlike(r"^[0-9]+(\.[0-9]+)*$") & host(r["html_url"])
    return F.when(ok, F.struct(tag.alias("version"), r["html_url"].alias("page"), F.when(host(image), image).alias("image")))
