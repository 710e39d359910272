"""Queries of whole pages: blocks that spread, coded rows, copies of files and outcomes in batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import blocks as K
from quire.plans.bindings_more import PIXELS, grey_pages
from quire.plans.bindings_rows import table
from quire.plans.staging import stage, stage_path
from quire.sources import composed as C, group4 as G
from quire.sources.copies import copy_files
from quire.sources.history import read_history, write_history
from quire.streaming import outcomes as O


def spread_blocks(spark, sf_dir):
    """Blocks of 2 x 2 pixels with the mean of their light pixels, spread over the blocks without any."""
    pages = grey_pages(spark, sf_dir).withColumn("m", F.transform("v", lambda x: (x >= 145).cast("int")))
    return K.long_blocks(K.spread_blocks(pages, ["v"], "m", 2), "v_blocks")


def coded_pages(spark, sf_dir):
    """The dark pixels of each page as coded rows, and the size of a document that holds them."""
    pages = grey_pages(spark, sf_dir).withColumn("m", F.transform("v", lambda x: (x < 128).cast("int")))
    coded = G.group4(pages, "m").select("id", "width", "coded")
    page = coded.select("id", "coded", F.lit(0).alias("page"), F.lit(72.0).alias("width"), F.lit(72.0).alias("height"), F.array(G.image(F.col("width"), F.lit(8), F.col("coded"))).cast(C.IMAGES).alias("images"), F.array().cast(C.TEXT).alias("text"))
    docs = C.composed(stage(page, "coded"), "id")
    return docs.join(coded.select("id", "coded"), "id").select("id", F.hex("coded").alias("coded"), (F.octet_length("document") - F.octet_length("coded")).cast("long").alias("around"))


def history_total(spark, sf_dir):
    """An envelope of the newest 200 orders over one of others, with the lifetime summed from all orders."""
    o = table(spark, sf_dir, "orders").select(
        (-F.col("o_orderkey")).alias("pos"), F.col("o_orderkey").cast("string").alias("id"), F.lit("file:///x").alias("folderURL"), F.round(F.col("o_totalprice") * 100).cast("long").alias("savedBytes"))
    path = stage_path(spark, "history")
    write_history(o.where("pos % 2 = 0"), 1, path)
    write_history(o, o.select("savedBytes"), path)
    total = spark.read.json(path).select(F.col("lifetimeSavedBytes").alias("lifetime"))
    rows = read_history(spark, path).agg(F.count(F.lit(1)).alias("batches"), F.max(F.col("id").cast("long")).alias("newest"), F.sum("savedBytes").alias("shown"))
    return rows.withColumn("lifetime", total.scalar())


def copied_files(spark, sf_dir):
    """The files of a table copied by tasks, and the copies read back."""
    orders = table(spark, sf_dir, "orders")
    folder = stage_path(spark, "copies")
    plan = spark.createDataFrame([(f, f"{folder}/{k}.parquet") for k, f in enumerate(sorted(orders.inputFiles()))], "source string, target string")
    copies = stage(copy_files(plan), "copied")
    found = spark.read.schema(orders.schema).parquet(folder)
    n = copies.agg(F.count_if(F.col("status") == "ok").alias("ok"), F.bool_and(F.length("sha256") == 64).alias("told"))
    out = found.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").cast("long").alias("last"))
    return out.withColumn("all_copied", n.select((F.col("ok") == plan.count()) & F.col("told")).scalar())


def streamed_outcomes(spark, sf_dir):
    """Each user's first purchase, taken out of a stream of events into a table."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    folder, schema = stage_path(spark, "outcomes"), table(spark, sf_dir, "events").schema
    spark.conf.set(setting, O.STORE)
    try:
        # a pattern, as a stream's path must be a folder or a pattern, whether the table is a folder or a file
        ticks = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").select("user_id", "event_id", "event_type", "value")
        O.ingested(O.first_outcomes(ticks, "user_id", "event_id", "event_type", ["purchase"]), f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema("user_id long, event_id long, event_type string, value double").parquet(f"{folder}/table").select("user_id", "event_id", "value")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (spread_blocks, coded_pages, history_total, copied_files, streamed_outcomes)}


def _spread_sql() -> str:
    """A step a block and round, in order; a list of means a page is carried along."""
    steps = ((-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1))
    near = ", ".join(f"CASE WHEN k % 4 + ({x}) BETWEEN 0 AND 3 AND k % 16 // 4 + ({y}) BETWEEN 0 AND 3 THEN m[k % 16 + 1 + ({x + 4 * y})] END" for x, y in steps)
    return f"""WITH RECURSIVE {PIXELS}, b AS (SELECT id, x // 2 AS block_x, y // 2 AS block_y, (sum(v) FILTER (v >= 145))::DOUBLE / nullif(count(*) FILTER (v >= 145), 0) AS mean FROM p GROUP BY 1, 2, 3),
s AS (SELECT id, 0 AS k, list(mean ORDER BY block_y, block_x) AS m FROM b GROUP BY id
  UNION ALL SELECT id, k + 1, CASE WHEN m[k % 16 + 1] IS NOT NULL OR list_count(near) = 0 THEN m ELSE list_transform(m, lambda v, i: CASE WHEN i = k % 16 + 1 THEN list_sum(near)::DOUBLE / list_count(near) ELSE v END) END
  FROM (SELECT *, [{near}] AS near FROM s WHERE k < 256)),
f AS (SELECT id, m, list_avg(m) AS fill FROM s WHERE k = 256)
SELECT id, (i % 4)::INT AS block_x, (i // 4)::INT AS block_y, floor(coalesce(m[i + 1], fill, 128.0::DOUBLE) + 0.5::DOUBLE)::INT AS v FROM f, range(16) AS r(i)"""


SQL: dict[str, str] = {
    "spread_blocks": _spread_sql(),
    "copied_files": "SELECT o_orderpriority, count(*)::BIGINT AS n, max(o_orderkey)::BIGINT AS last, true AS all_copied FROM orders GROUP BY 1",
    "streamed_outcomes": "SELECT user_id, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1",
    "history_total": """WITH o AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS saved FROM orders), n AS (SELECT * FROM o ORDER BY o_orderkey DESC LIMIT 200)
SELECT count(*)::BIGINT AS batches, max(o_orderkey)::BIGINT AS newest, sum(saved)::BIGINT AS shown, (SELECT sum(saved)::BIGINT FROM o) AS lifetime FROM n""",
}
