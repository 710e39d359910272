"""Queries of row logic, totals, joins, races and versions over stand-in columns.

lineitem stands for delivered versions: its order is the run, the price in cents the bytes before,
the discounted and taxed price those after, the return flag the state.  documents stand for files:
n_chars is the size, source the folder, lang the kind.  labels are sparse side rows.  No table holds
facts of real PDF files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import pricing, rows as R, text as T
from quire.operators import keyed as K, ordered as O, selection as S, totals as A, versions as V


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    before = cents("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run"), F.col("l_linenumber").cast("long").alias("pos"), before.alias("before"),
        F.floor(before * (100 - cents("l_discount") + cents("l_tax")) / 100).cast("long").alias("after"), F.col("l_quantity").cast("long").alias("qty"),
        F.when(F.col("l_returnflag") == "A", "failed").when(F.col("l_linestatus") == "F", "done").when(F.col("l_returnflag") == "N", "queued").otherwise("running").alias("state"),
        (F.col("l_partkey") % 3 == 0).alias("searchable"), F.when(F.col("l_suppkey") % 4 == 0, "skipped").when(F.col("l_suppkey") % 4 == 1, "noGain").when(F.col("l_suppkey") % 4 == 2, "compressed").alias("compress"),
        F.when(F.col("l_partkey") % 5 == 0, "tooFaint").when(F.col("l_partkey") % 5 == 1, "added").alias("ocr"),
        (F.col("l_linenumber") != 3).alias("queued"), (F.col("l_orderkey") % 7 == 0).alias("cancelled"))


VERSIONS = """v AS (SELECT l_orderkey AS run, l_linenumber::BIGINT AS pos, round(l_extendedprice * 100)::BIGINT AS before,
  (round(l_extendedprice * 100)::BIGINT * (100 - round(l_discount * 100)::BIGINT + round(l_tax * 100)::BIGINT)) // 100 AS after, trunc(l_quantity)::BIGINT AS qty,
  CASE WHEN l_returnflag = 'A' THEN 'failed' WHEN l_linestatus = 'F' THEN 'done' WHEN l_returnflag = 'N' THEN 'queued' ELSE 'running' END AS state,
  l_partkey % 3 = 0 AS searchable, CASE l_suppkey % 4 WHEN 0 THEN 'skipped' WHEN 1 THEN 'noGain' WHEN 2 THEN 'compressed' END AS compress,
  CASE l_partkey % 5 WHEN 0 THEN 'tooFaint' WHEN 1 THEN 'added' END AS ocr, l_linenumber <> 3 AS queued, l_orderkey % 7 = 0 AS cancelled FROM lineitem)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("n_chars").alias("size"), "source", (F.floor(F.col("n_chars") / 2000) + 1).alias("pages"),
        F.when(F.col("lang") == "en", "bornDigital").when(F.col("lang") == "de", "scanColour").when(F.col("lang") == "fr", "scanBilevel").alias("content_type"), (F.col("doc_id") % 3 != 0).alias("rebuild"))
    side = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return d.join(side, "doc_id", "left").withColumns({
        "problem": F.when(F.col("quality") == 0, F.when(F.col("doc_id") % 2 == 0, "locked").otherwise("missing")), "skipped": F.col("toxic") == 1,
        "state": F.element_at(F.array(*map(F.lit, ["queued", "analysing", "done", "failed", "running"])), (F.col("doc_id") % 5 + 1).cast("int"))})


FILES = """s AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT d.doc_id, n_chars AS size, source, n_chars // 2000 + 1 AS pages,
  CASE lang WHEN 'en' THEN 'bornDigital' WHEN 'de' THEN 'scanColour' WHEN 'fr' THEN 'scanBilevel' END AS content_type, d.doc_id % 3 <> 0 AS rebuild, quality, toxic,
  CASE WHEN quality = 0 THEN CASE WHEN d.doc_id % 2 = 0 THEN 'locked' ELSE 'missing' END END AS problem, toxic = 1 AS skipped,
  (['queued', 'analysing', 'done', 'failed', 'running'])[(d.doc_id % 5 + 1)::INT] AS state FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id)"""
CLASSED = FILES + """, k AS (SELECT *, CASE WHEN state = 'done' THEN 'delivered' WHEN state = 'failed' THEN CASE WHEN skipped THEN 'failedSkipped' ELSE 'failedActionable' END
  WHEN state = 'running' THEN 'transient' WHEN problem IS NOT NULL THEN CASE WHEN skipped THEN 'problemSkipped' ELSE 'problemUnresolved' END
  WHEN skipped THEN 'cleanSkipped' ELSE 'cleanPending' END AS cls FROM f)"""

_BASE = "CASE content_type WHEN 'bornDigital' THEN CASE preset WHEN 'maximum' THEN 0.05 WHEN 'balanced' THEN 0.10 ELSE 0.15 END WHEN 'scanColour' THEN CASE preset WHEN 'maximum' THEN 0.12 WHEN 'balanced' THEN 0.45 ELSE 0.65 END WHEN 'scanBilevel' THEN CASE preset WHEN 'maximum' THEN 0.05 WHEN 'balanced' THEN 0.20 ELSE 0.30 END END"
PRICED = f"""p AS (SELECT preset, typical::DOUBLE AS typical FROM (VALUES ('maximum', 0.10), ('balanced', 0.35), ('smallest', 0.55)) t(preset, typical)),
q AS (SELECT f.*, preset, typical, CASE WHEN rebuild AND content_type = 'scanColour' AND preset <> 'maximum' THEN CASE preset WHEN 'balanced' THEN 0.82 ELSE 0.90 END ELSE coalesce({_BASE}, typical) END::DOUBLE AS base,
  CASE WHEN size::DOUBLE / pages > 1500.0::DOUBLE THEN 1.0::DOUBLE - 1500.0::DOUBLE / (size::DOUBLE / pages) ELSE 0.0::DOUBLE END AS payload FROM f CROSS JOIN p),
r AS (SELECT *, content_type IS NULL AS is_fallback, CASE WHEN content_type IS NULL THEN greatest(1, trunc(greatest(size, 1) * (1 - typical))::BIGINT)
  ELSE greatest(1, trunc(size * (1 - CASE WHEN content_type = 'bornDigital' THEN base ELSE base * (0.3::DOUBLE + 0.7::DOUBLE * payload) END))::BIGINT) END AS predicted FROM q)"""


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.price(files(spark, sf_dir), baseline=1500.0)


def batch_savings(spark, sf_dir):
    """Runs of lineitem: records with savings, counts and flags, and their titles."""
    out = A.batch_records(versions(spark, sf_dir), "run")
    return out.withColumn("title", T.display_title(F.col("success_count"), F.col("file_count"), F.lit("Orders")))


def run_saved(spark, sf_dir):
    """Savings of delivered rows by run; may be negative."""
    return versions(spark, sf_dir).where("state = 'done'").groupBy("run").agg(A.saved_bytes(F.col("before"), F.col("after")).alias("saved"))


def finished_totals(spark, sf_dir):
    v = versions(spark, sf_dir).withColumn("after", F.when(F.col("state") == "done", F.col("after")))
    return A.finished_totals(v.where(R.terminal(F.col("state"))), "qty")


def run_fraction(spark, sf_dir):
    return A.run_progress(versions(spark, sf_dir).withColumn("fraction", F.col("qty") / 64.0), "run")


def price_presets(spark, sf_dir):
    return priced(spark, sf_dir).select("doc_id", "preset", "predicted", "is_fallback")


def preset_totals(spark, sf_dir):
    """Totals per candidate preset; rows of folder src1 always count at balanced, rows without analysis as 0."""
    p = priced(spark, sf_dir)
    own = p.where("preset = 'balanced'").select("doc_id", F.col("predicted").alias("balanced"))
    rows = p.join(own, "doc_id").withColumn("counted", F.when(F.col("is_fallback"), 0).when(F.col("source") == "src1", F.col("balanced")).otherwise(F.col("predicted")))
    return rows.groupBy("preset").agg(F.sum("counted").cast("long").alias("total"), F.count(F.lit(1)).alias("n"))


def override_pricing(spark, sf_dir):
    """Effective settings of files with sparse overrides, and the price at the effective preset."""
    f = files(spark, sf_dir)
    over = K.normalised(
        f.where("quality IS NOT NULL").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "smallest").when(F.col("doc_id") % 3 == 1, "balanced").alias("preset"), F.when(F.col("toxic") == 1, True).alias("ocr")),
        {"preset": F.lit("balanced"), "ocr": F.lit(False)})
    jobs = K.effective(f.select("doc_id"), over, "doc_id", {"preset": F.lit("balanced"), "ocr": F.lit(False)})
    compress, ocr = K.effective_verbs(F.col("doc_id") % 5 != 0, F.col("ocr"), F.lit(True))
    price = priced(spark, sf_dir).select("doc_id", "preset", "predicted")
    return jobs.join(price, ["doc_id", "preset"], "left").select("doc_id", "preset", "ocr", "differs", compress.alias("compress"), "predicted")


def calibrated_prediction(spark, sf_dir):
    v = versions(spark, sf_dir).withColumn("raw", F.floor(F.col("before") * 3 / 5).cast("long"))
    return v.select("run", "pos", pricing.calibrated(F.col("raw"), F.col("after"), F.floor(F.col("before") * 7 / 8).cast("long"), F.col("searchable"), F.col("before")).alias("predicted"))


def armed_summary(spark, sf_dir):
    v = versions(spark, sf_dir).withColumns({"rerun": F.when((F.col("state") == "done") & F.col("compress").isin("compressed", "noGain"), "armed").otherwise("none"), "waiting": R.pending(F.col("state")), "current": F.col("after")})
    return A.armed_summary(v.withColumn("predicted", F.when(F.col("searchable"), F.floor(F.col("before") / 2).cast("long"))), "run")


def row_partition(spark, sf_dir):
    f = files(spark, sf_dir)
    return f.select("doc_id", R.partition_class(F.col("state"), F.col("problem"), F.col("skipped")).alias("cls"), R.pending(F.col("state")).alias("waiting"))


def screen_state(spark, sf_dir):
    """The screen of each queue of three files; a queue's files have neighbouring ids."""
    return A.screen_state(files(spark, sf_dir).withColumn("queue", F.floor(F.col("doc_id") / 3)), "queue")


def next_queued(spark, sf_dir):
    """The first queued, unskipped row of each folder."""
    f = files(spark, sf_dir)
    skipping = f.where("skipped").select("doc_id")
    return S.first_match(K.discarded(f.where("state = 'queued'"), skipping, "doc_id").withColumn("pos", F.col("doc_id")), ["source"], "pos", "doc_id")


def row_descriptions(spark, sf_dir):
    f = files(spark, sf_dir)
    text = F.when(F.col("toxic").isNotNull(), F.col("toxic") == 1)
    kind = R.content_descriptor(F.col("content_type"), text)
    return f.select("doc_id", R.row_description(F.col("problem"), F.when(F.col("doc_id") % 11 != 0, F.col("pages")), kind).alias("line"))


def recompress_state(spark, sf_dir):
    v = versions(spark, sf_dir)
    preset = lambda k: F.element_at(F.array(*map(F.lit, ["maximum", "balanced", "smallest"])), ((F.col("qty") + k) % 3 + 1).cast("int"))
    return v.select("run", "pos", R.rerun_state(
        F.col("run") % 50 == 0, F.col("pos") == 6, F.col("state"), F.col("compress"), F.col("qty") % 9 != 0, F.col("qty") % 11 == 0,
        preset(0), F.lit("balanced"), preset(1), F.col("searchable")).alias("rerun"))


def first_failure_note(spark, sf_dir):
    v = versions(spark, sf_dir).withColumn("problem", F.when(F.col("qty") % 3 == 0, "locked").when(F.col("qty") % 3 == 1, "missing"))
    return A.first_failure(v.withColumn("pos", F.struct("pos", "before", "qty")), "run", R.failure_note(F.col("problem")))


def _batches(spark, sf_dir):
    b = A.batch_records(versions(spark, sf_dir), "run")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("placed"), F.col("o_orderpriority").alias("priority"))
    return b.join(o, "run")


RECORDS = VERSIONS + """, b AS (SELECT run, count(*) AS file_count,
  coalesce(sum(CASE WHEN queued AND state = 'done' THEN greatest(0, before - after) END), 0)::BIGINT AS saved_bytes,
  count(*) FILTER (queued AND state = 'done' AND searchable) AS searchable_count, count(*) FILTER (queued AND state = 'done') AS success_count,
  bool_or(queued AND state = 'failed') AS problem,
  bool_or(queued AND state = 'done' AND (coalesce(compress = 'skipped', false) OR coalesce(ocr IN ('tooFaint', 'cancelled', 'failed'), false))) AS partial,
  bool_or(cancelled) AS cancelled FROM v GROUP BY run HAVING NOT (bool_or(cancelled) AND count(*) FILTER (queued AND state = 'done') = 0))"""
BATCHES = RECORDS + """, h AS (SELECT b.*, o_orderdate AS placed, o_orderpriority AS priority FROM b JOIN orders ON run = o_orderkey)"""


def history_recent(spark, sf_dir):
    """The 200 newest batches with their labels, and which two are the most recent."""
    top = S.newest(_batches(spark, sf_dir), [F.desc("placed"), F.desc("run")])
    rank = F.row_number().over(Window.orderBy(F.desc("placed"), F.desc("run")))  # over 200 rows
    sub = T.batch_subtitle(F.date_format("placed", "HH:mm"), F.col("run") % 2 == 0, F.when(F.col("run") % 4 == 0, "Balanced"), F.col("run") % 3 == 0, F.when(F.col("run") % 13 == 0, "one had moved"), F.col("problem"), F.col("searchable_count"), F.col("file_count"))
    day = T.day_label(F.to_date("placed"), F.lit("1998-08-01").cast("timestamp"))
    return top.select("run", "saved_bytes", sub.alias("subtitle"), day.alias("day"), (rank <= 2).alias("recent"), (F.col("saved_bytes") <= 0).alias("no_change"))


def history_by_day(spark, sf_dir):
    """Batches by day, newest first within it."""
    b = _batches(spark, sf_dir).withColumn("day", F.to_date("placed"))
    return b.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("saved_bytes").alias("saved"), F.concat_ws(",", F.transform(F.sort_array(F.collect_list("run"), False), lambda x: x.cast("string"))).alias("runs"))


def history_day_rows(spark, sf_dir):
    """A row a batch: its day, and its rank within the day, newest first."""
    b = _batches(spark, sf_dir).select(F.to_date("placed").alias("day"), "run", "saved_bytes")
    return b.withColumn("rank", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("run"))))


def lifetime_saved(spark, sf_dir):
    """Savings of all batches, beyond those that are retained."""
    return _batches(spark, sf_dir).agg(F.sum("saved_bytes").alias("lifetime"), F.count(F.lit(1)).alias("n"))


def _race(spark, sf_dir):
    v = versions(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, ["scanBilevel", "scanColour", "bornDigital"])), (F.col("qty") % 3 + 1).cast("int"))
    part = lambda n, d: F.floor(F.col("before") * n / d).cast("long")
    r = S.race(kind, F.col("before"), F.col("after"), F.col("qty") % 10 != 0, part(9, 10), F.col("qty") % 7 != 0, part(19, 20), F.col("pos") % 4 != 0, F.col("pos") != 2, F.when(F.col("qty") % 5 == 0, "maximum").otherwise("balanced"))
    return v.select("*", F.explode(F.array(r)).alias("r"))  # an array of one: what reads r does not run the race again


def candidate_race(spark, sf_dir):
    return _race(spark, sf_dir).select("run", "pos", "r.status", "r.winner", "r.shipped_bytes")


def runner_up(spark, sf_dir):
    return _race(spark, sf_dir).groupBy(F.coalesce("r.winner", F.lit("none")).alias("winner"), F.coalesce("r.runner_up", F.lit("none")).alias("runner_up")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("r.shipped_bytes", F.lit(0))).cast("long").alias("shipped_bytes"))


_RACE_SQL = VERSIONS + """, c AS (SELECT *, (['scanBilevel', 'scanColour', 'bornDigital'])[(qty % 3 + 1)::INT] AS kind, before * 9 // 10 AS ccitt, before * 19 // 20 AS mrc,
  qty % 7 <> 0 AS cv, pos % 4 <> 0 AS mv, qty % 10 <> 0 AS bv, pos <> 2 AND qty % 5 <> 0 AS wants FROM v),
e AS (SELECT *, kind = 'scanBilevel' AND ccitt < after AND ccitt < before AND cv AS bi, kind = 'scanColour' AND wants AND mrc < before AND mv AS lay FROM c),
g AS (SELECT *, CASE WHEN NOT after > 0 THEN 'failed' WHEN bi OR (lay AND mrc < after) THEN 'shipped' WHEN after >= before THEN 'noGain' WHEN NOT bv THEN 'failed' ELSE 'shipped' END AS status,
  CASE WHEN NOT after > 0 THEN NULL WHEN bi THEN 'ccitt' WHEN lay AND mrc < after THEN 'mrc' WHEN after >= before OR NOT bv THEN NULL ELSE 'baseline' END AS winner,
  CASE WHEN NOT after > 0 OR bi THEN NULL WHEN lay AND mrc < after THEN CASE WHEN after < before THEN 'baseline' ELSE 'original' END WHEN lay AND (after >= before OR bv) THEN 'mrc' END AS runner_up,
  CASE WHEN NOT after > 0 THEN NULL WHEN bi THEN ccitt WHEN lay AND mrc < after THEN mrc WHEN after >= before THEN before WHEN NOT bv THEN NULL ELSE after END AS shipped_bytes FROM e)"""


def version_cards(spark, sf_dir):
    r = _race(spark, sf_dir).where("r.status = 'shipped'")
    slot = lambda name, size, variant: F.struct(F.concat(F.lit(name + "/"), F.col("run").cast("string"), F.lit("-"), F.col("pos").cast("string")).alias("url"), size.alias("bytes"), variant.alias("variant"))
    r = r.select("run", "pos", F.col("before").alias("size"), slot("shipped", F.col("r.shipped_bytes"), F.col("r.winner")).alias("shipped"), F.when(F.col("r.runner_up").isNotNull(), slot("parked", F.col("after"), F.col("r.runner_up"))).alias("runnerUp"),
        F.when(F.col("qty") % 6 == 0, slot("previous", F.col("after") + 1, F.lit("plain"))).alias("previous"), slot("original", F.col("before"), F.lit("original")).alias("original"))
    return S.version_cards(r.withColumnRenamed("pos", "line"), ["run", "line", "size"], ["shipped", "runnerUp", "previous", "original"])


def variant_pairs(spark, sf_dir):
    v = versions(spark, sf_dir).where("pos <= 2").withColumn("variant", F.when(F.col("searchable"), "mrc").otherwise("plain"))
    out = S.variant_pairs(v, "run", "variant", "after")
    return out.withColumns({"consent": R.consent(F.lit("plain"), F.lit("mrc")), "verdict": T.percent_text(F.col("mrc_bytes"), F.col("plain_bytes"))})


def retain_live(spark, sf_dir):
    """Side rows of labels: kept where the document is live, else discarded."""
    live = files(spark, sf_dir).where("state <> 'failed'").select("doc_id")
    side = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return K.live_only(side, live, "doc_id").withColumn("fate", F.lit("kept")).unionByName(K.discarded(side, live, "doc_id").withColumn("fate", F.lit("discarded")))


def superseded_parked(spark, sf_dir):
    """Parked files of runs that fresh versions leave unused."""
    v = versions(spark, sf_dir)
    url = lambda k: F.concat(F.lit("p"), (F.col("qty") % k).cast("string"))
    store = v.where("pos = 1").select("run", K.parked_urls(url(7), url(5)).alias("parked"))
    fresh = v.where("pos = 2").select("run", K.parked_urls(url(7), F.when(F.col("searchable"), url(3))).alias("parked"))
    return K.record_versions(store, fresh, "run")[1].select("run", "url")


def restored_overrides(spark, sf_dir):
    """All labelled rows as they are now, back at a snapshot that had those of good quality."""
    lab = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return K.restored(lab.where("quality = 1"), lab, "doc_id", "quality")


def state_overlay(spark, sf_dir):
    f = files(spark, sf_dir).select("doc_id", "state")
    p = priced(spark, sf_dir).where("preset = 'balanced'").select("doc_id", "predicted")
    pick = lambda k, r: f.where(F.col("doc_id") % k == r).select("doc_id")
    out = K.overlay(f, "doc_id", p, pick(11, 3).withColumn("message", F.lit("The file could not be found.")), pick(7, 2).withColumn("fraction", F.col("doc_id") % 10 / 10.0), pick(5, 1), pick(3, 0))
    return out.select("doc_id", "predicted", "shown_state", R.failure_problem(F.col("failure")).alias("problem"), "shown_fraction")


def searchable_rows(spark, sf_dir):
    f = files(spark, sf_dir)
    flag = lambda c: F.when(F.col(c).isNotNull(), F.col(c) == 1)
    return f.groupBy("source").agg(F.count_if(R.made_searchable(flag("quality"), flag("toxic"))).alias("n"))


def committed_reruns(spark, sf_dir):
    v = versions(spark, sf_dir)
    rows = v.select("run", "pos", F.col("compress").alias("outcome"), F.col("after").alias("shipped"), F.floor(F.col("before") / 2).cast("long").alias("candidate"), F.lit(None).cast("long").alias("previous"))
    return K.committed(rows).select("run", "pos", "shipped", "previous", "futile")


def futile_attempts(spark, sf_dir):
    """Attempts already known to be futile, by row, preset and verbs."""
    v = versions(spark, sf_dir).select("run", "pos", (F.col("qty") % 3).alias("preset"), F.col("searchable").alias("ocr"))
    known = v.where("NOT ocr").distinct()
    return K.live_only(v, known, ["run", "pos", "preset", "ocr"])


def page_rates(spark, sf_dir):
    v = versions(spark, sf_dir)
    return v.select("run", "pos", A.page_rate(F.col("before"), F.col("qty") - 1).alias("rate"))


def pending_totals(spark, sf_dir):
    f = files(spark, sf_dir).join(priced(spark, sf_dir).where("preset = 'smallest' AND NOT is_fallback").select("doc_id", "predicted"), "doc_id", "left")
    return A.pending_totals(f.where(R.pending(F.col("state"))), "source")


def start_gate(spark, sf_dir):
    f = files(spark, sf_dir).withColumns({"compress_on": F.col("doc_id") % 2 == 0, "ocr_on": F.lit(False), "folder_exists": F.lit(True), "folder_writable": F.col("source") != "src3"})
    return A.can_start(f.where("state <> 'running' AND problem IS NULL OR source = 'src5'"), "source")


def object_numbering(spark, sf_dir):
    v = versions(spark, sf_dir).withColumn("n", F.when(F.col("searchable"), 5).otherwise(3))
    return O.object_numbers(v, ["run"], ["pos", "before", "qty"], "n").select("run", "pos", "before", "first_object")


def xref_runs(spark, sf_dir):
    v = versions(spark, sf_dir)
    return O.sections(v.withColumn("object", F.col("qty")), ["run"], "object")


def extents(spark, sf_dir):
    v = versions(spark, sf_dir).groupBy("run", "qty").agg(F.count(F.lit(1)).alias("n"))
    return O.extents(v, ["run"], "qty", F.lit(1000).cast("long")).select("run", "qty", "end_offset")


def output_names(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("base", F.concat(F.lit("scan"), (F.col("size") % 97).cast("string")))
    return K.output_names(f, "source", "base", "doc_id").select("doc_id", "output_name")


def page_sample(spark, sf_dir):
    f = files(spark, sf_dir)
    return f.select("doc_id", F.explode(O.page_sample(F.col("pages").cast("long"), (F.col("doc_id") % 6).cast("long"))).alias("page"))


def change_quality(spark, sf_dir):
    """Lines of the change-quality list: deltas and mechanisms."""
    v = versions(spark, sf_dir)
    state = F.when(F.col("qty") % 3 == 0, "armed").when(F.col("qty") % 3 == 1, "instantSwitch").otherwise("futile")
    line = T.mechanism_line(state, F.lit(150), F.when(F.col("searchable"), F.col("qty") / 8.0), F.col("pos"), F.col("pos") == 5)
    more = F.col("after") - F.col("before")
    return v.select("run", "pos", line.alias("line"), F.when(more < 0, "less").otherwise(T.delta_text(F.col("before"), F.when(more == 0, F.col("before")).otherwise(F.col("after")), F.lit(True))).alias("delta"))


def version_store(spark, sf_dir):
    """Presets, shown sizes and flags of rows whose shipped slot may be empty."""
    v = versions(spark, sf_dir)
    slot = F.when(F.col("state") == "done", F.struct(F.when(F.col("searchable"), "balanced").alias("preset"), F.col("after").alias("bytes")))
    none = F.lit(None).cast("struct<preset:string,bytes:bigint>")
    v = v.withColumn("store", V.with_slot(F.struct(none.alias("shipped"), none.alias("previous")), "shipped", slot))
    flags = V.flagged(F.create_map(F.lit("a"), F.lit(True)), F.when(F.col("pos") % 2 == 0, "a").otherwise("b"), F.col("searchable"))
    shown = V.display_sizes(F.col("before"), F.col("store.shipped"))
    return v.select("run", "pos", "before", V.row_preset(F.col("store.shipped"), F.lit("smallest")).alias("preset"), shown["before"].alias("shown_before"), shown["after"].alias("shown_after"),
        V.provenance(flags, F.lit("b"), F.lit("o"))["searchable"].alias("b"), V.provenance(flags, F.lit("a"), F.lit("o"))["searchable"].alias("a"))


def queue_append(spark, sf_dir):
    """Two drops of files appended as a bag: repeats stay, each row with its drop."""
    f = files(spark, sf_dir).select("doc_id", "source")
    return f.withColumn("drop", F.lit(1)).unionByName(f.withColumn("drop", F.lit(2))).groupBy("source", "drop").agg(F.count(F.lit(1)).alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    batch_savings, run_saved, finished_totals, run_fraction, price_presets, preset_totals, override_pricing, calibrated_prediction, armed_summary, row_partition, screen_state,
    next_queued, row_descriptions, recompress_state, first_failure_note, history_recent, history_by_day, history_day_rows, lifetime_saved, candidate_race, runner_up, version_cards, variant_pairs,
    retain_live, superseded_parked, restored_overrides, state_overlay, searchable_rows, committed_reruns, futile_attempts, page_rates, pending_totals, start_gate,
    object_numbering, xref_runs, extents, output_names, page_sample, change_quality, version_store, queue_append)}

SQL: dict[str, str] = {
    "batch_savings": f"WITH {RECORDS} SELECT *, CASE WHEN success_count < file_count THEN success_count || ' of ' ELSE '' END || file_count || CASE WHEN file_count = 1 THEN ' file' ELSE ' files' END || ' in Orders' AS title FROM b",
    "run_saved": f"WITH {VERSIONS} SELECT run, sum(before - after)::BIGINT AS saved FROM v WHERE state = 'done' GROUP BY run",
    "finished_totals": f"WITH {VERSIONS} SELECT qty, sum(before) FILTER (state = 'done')::BIGINT AS total_before, sum(after) FILTER (state = 'done')::BIGINT AS total_after, count(*) FILTER (state = 'done') AS counted, count(*) FILTER (searchable) AS searchable_count FROM v WHERE state IN ('done', 'failed') GROUP BY qty",
    "run_fraction": f"WITH {VERSIONS} SELECT run, avg(CASE WHEN state IN ('done', 'failed') THEN 1.0 WHEN state = 'running' THEN qty / 64.0 ELSE 0.0 END::DOUBLE) AS run_fraction, count(*) FILTER (state = 'done') AS delivered, count(*) AS total, bool_and(state IN ('done', 'failed')) AS all_finished FROM v GROUP BY run",
    "price_presets": f"WITH {FILES}, {PRICED} SELECT doc_id, preset, predicted, is_fallback FROM r",
    "preset_totals": f"WITH {FILES}, {PRICED} SELECT a.preset, sum(CASE WHEN a.is_fallback THEN 0 WHEN a.source = 'src1' THEN b.predicted ELSE a.predicted END)::BIGINT AS total, count(*) AS n FROM r a JOIN r b ON a.doc_id = b.doc_id AND b.preset = 'balanced' GROUP BY a.preset",
    "override_pricing": f"""WITH {FILES}, {PRICED}, o AS (SELECT doc_id, quality, coalesce(CASE WHEN quality IS NOT NULL AND doc_id % 3 = 0 THEN 'smallest' END, 'balanced') AS preset, quality IS NOT NULL AND coalesce(toxic = 1, false) AS ocr FROM f)
SELECT o.doc_id, o.preset, o.ocr, o.preset <> 'balanced' OR o.ocr AS differs, o.doc_id % 5 <> 0 OR NOT o.ocr AS compress, predicted FROM o LEFT JOIN r ON r.doc_id = o.doc_id AND r.preset = o.preset""",
    "calibrated_prediction": f"WITH {VERSIONS}, c AS (SELECT *, before * 3 // 5 AS raw, before * 7 // 8 AS base FROM v), d AS (SELECT *, CASE WHEN searchable AND base > 0 THEN trunc(after::DOUBLE / base * raw)::BIGINT ELSE raw END AS s FROM c) SELECT run, pos, CASE WHEN s < before THEN s END AS predicted FROM d",
    "armed_summary": f"WITH {VERSIONS}, c AS (SELECT *, state = 'done' AND coalesce(compress IN ('compressed', 'noGain'), false) AS armed FROM v) SELECT run, count(*) FILTER (armed) AS armed, count(*) FILTER (state IN ('queued', 'analysing')) AS waiting, sum(after - before // 2) FILTER (armed AND searchable)::BIGINT AS extra_saving FROM c GROUP BY run HAVING count(*) FILTER (armed) > 0",
    "row_partition": f"WITH {CLASSED} SELECT doc_id, cls, state IN ('queued', 'analysing') AS waiting FROM k",
    "screen_state": f"""WITH {CLASSED}, g AS (SELECT doc_id // 3 AS queue, count(*) AS n_rows, count(*) FILTER (cls IN ('failedActionable', 'problemUnresolved')) AS needs_attention, count(*) FILTER (cls = 'cleanPending') AS healthy_queued,
  bool_or(state = 'running') AS run, bool_or(cls IN ('delivered', 'failedSkipped', 'failedActionable')) AS fin, bool_or(cls = 'failedActionable') AS bad, bool_or(cls = 'problemUnresolved') AS opn FROM k GROUP BY doc_id // 3)
SELECT queue, n_rows, needs_attention, healthy_queued, CASE WHEN run THEN 'working' WHEN NOT fin THEN 'ready' WHEN healthy_queued > 0 AND NOT bad AND NOT opn THEN 'ready' WHEN bad OR opn THEN 'problems' ELSE 'finished' END AS screen FROM g""",
    "next_queued": f"WITH {CLASSED} SELECT source, min(doc_id) AS doc_id FROM k WHERE state = 'queued' AND NOT coalesce(skipped, false) GROUP BY source",
    "row_descriptions": f"""WITH {CLASSED} SELECT doc_id, CASE problem WHEN 'locked' THEN 'Needs a password to open' WHEN 'missing' THEN 'Moved or renamed since you added it' ELSE CASE WHEN doc_id % 11 = 0 THEN '' ELSE concat_ws(', ', pages || CASE WHEN pages = 1 THEN ' page' ELSE ' pages' END,
  CASE WHEN content_type = 'bornDigital' THEN 'text and vectors' WHEN toxic = 0 THEN 'no text layer yet' WHEN content_type IS NOT NULL THEN 'mostly photographs' END) END END AS line FROM k""",
    "recompress_state": f"""WITH {VERSIONS}, c AS (SELECT *, (['maximum', 'balanced', 'smallest'])[(qty % 3 + 1)::INT] AS own, (['maximum', 'balanced', 'smallest'])[((qty + 1) % 3 + 1)::INT] AS prev FROM v)
SELECT run, pos, CASE WHEN run % 50 = 0 OR pos = 6 OR state <> 'done' OR NOT coalesce(compress IN ('compressed', 'noGain'), false) OR qty % 9 = 0 THEN 'none' WHEN qty % 11 = 0 THEN 'futile' WHEN own = 'balanced' THEN 'none' WHEN prev = 'balanced' AND searchable THEN 'instantSwitch' ELSE 'armed' END AS rerun FROM c""",
    "first_failure_note": f"WITH {VERSIONS} SELECT run, arg_min(CASE qty % 3 WHEN 0 THEN 'one was password-locked' WHEN 1 THEN 'one had moved' ELSE 'one couldn''t be read' END, pos * 1000000000000 + before * 100 + qty) FILTER (state = 'failed') AS failure_note FROM v GROUP BY run",
    "history_recent": f"""WITH {BATCHES}, t AS (SELECT *, row_number() OVER (ORDER BY placed DESC, run DESC) AS rn FROM h)
SELECT run, saved_bytes, concat_ws(' · ', strftime(placed, '%H:%M'), CASE WHEN run % 4 = 0 THEN 'Balanced' WHEN run % 3 = 0 THEN 'OCR only' END,
  CASE WHEN run % 13 = 0 THEN 'one had moved' WHEN problem THEN 'some files needed attention' WHEN searchable_count > 0 THEN CASE WHEN searchable_count = file_count THEN 'all searchable' WHEN searchable_count = 1 THEN 'one made searchable' ELSE searchable_count || ' made searchable' END END) AS subtitle,
  CASE WHEN placed::DATE = DATE '1998-08-01' THEN 'TODAY' WHEN placed::DATE = DATE '1998-07-31' THEN 'YESTERDAY' ELSE upper(strftime(placed, '%-d %b %Y')) END AS day, rn <= 2 AS recent, saved_bytes <= 0 AS no_change FROM t WHERE rn <= 200""",
    "history_day_rows": f"WITH {BATCHES} SELECT placed::DATE AS day, run, saved_bytes, row_number() OVER (PARTITION BY placed::DATE ORDER BY run DESC)::INT AS rank FROM h",
    "history_by_day": f"WITH {BATCHES} SELECT placed::DATE AS day, count(*) AS n, sum(saved_bytes)::BIGINT AS saved, string_agg(run::VARCHAR, ',' ORDER BY run DESC) AS runs FROM h GROUP BY 1",
    "lifetime_saved": f"WITH {BATCHES} SELECT sum(saved_bytes)::BIGINT AS lifetime, count(*) AS n FROM h",
    "candidate_race": f"WITH {_RACE_SQL} SELECT run, pos, status, winner, shipped_bytes FROM g",
    "runner_up": f"WITH {_RACE_SQL} SELECT coalesce(winner, 'none') AS winner, coalesce(runner_up, 'none') AS runner_up, count(*) AS n, sum(coalesce(shipped_bytes, 0))::BIGINT AS shipped_bytes FROM g GROUP BY 1, 2",
    "version_cards": f"""WITH {_RACE_SQL}, u AS (SELECT run, pos AS line, qty, before, after, winner, runner_up, shipped_bytes, run || '-' || pos AS n FROM g WHERE status = 'shipped'),
w AS (SELECT run, line, before AS size, 1 AS k, 'shipped' AS slot, 'shipped/' || n AS url, shipped_bytes AS bytes, winner AS variant FROM u UNION ALL SELECT run, line, before, 2, 'runnerUp', 'parked/' || n, after, runner_up FROM u WHERE runner_up IS NOT NULL
  UNION ALL SELECT run, line, before, 3, 'previous', 'previous/' || n, after + 1, 'plain' FROM u WHERE qty % 6 = 0 UNION ALL SELECT run, line, before, 4, 'original', 'original/' || n, before, 'original' FROM u WHERE coalesce(runner_up, '') <> 'original')
SELECT run, line, size, (row_number() OVER (PARTITION BY run, line, size ORDER BY k) - 1)::INT AS pos, slot, url, bytes, variant FROM w""",
    "variant_pairs": f"""WITH {VERSIONS}, c AS (SELECT run, count(*) AS n, max(after) FILTER (searchable) AS mrc_bytes, max(after) FILTER (NOT searchable) AS plain_bytes FROM v WHERE pos <= 2 GROUP BY run)
SELECT run, mrc_bytes, plain_bytes, true AS consent, CASE WHEN plain_bytes > 0 AND mrc_bytes < plain_bytes THEN round((1 - mrc_bytes::DOUBLE / plain_bytes) * 100)::BIGINT || '% smaller' WHEN plain_bytes > 0 AND mrc_bytes > plain_bytes THEN round((mrc_bytes::DOUBLE / plain_bytes - 1) * 100)::BIGINT || '% bigger' ELSE 'same size' END AS verdict
FROM c WHERE n = 2 AND mrc_bytes IS NOT NULL AND plain_bytes IS NOT NULL""",
    "retain_live": f"WITH {CLASSED} SELECT l.doc_id, l.quality, l.toxic, CASE WHEN l.doc_id IN (SELECT doc_id FROM f WHERE state <> 'failed') THEN 'kept' ELSE 'discarded' END AS fate FROM labels l",
    "superseded_parked": f"""WITH {VERSIONS}, o AS (SELECT run, unnest(list_distinct(['p' || qty % 7, 'p' || qty % 5])) AS url FROM v WHERE pos = 1),
n AS (SELECT run, unnest(list_distinct(list_filter(['p' || qty % 7, CASE WHEN searchable THEN 'p' || qty % 3 END], lambda x: x IS NOT NULL))) AS url FROM v WHERE pos = 2)
SELECT run, url FROM o WHERE run IN (SELECT run FROM v WHERE pos = 2) AND NOT EXISTS (SELECT 1 FROM n WHERE n.run = o.run AND n.url = o.url)""",
    "restored_overrides": "WITH l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) SELECT doc_id, CASE WHEN quality = 1 THEN quality END AS quality, coalesce(quality <> 1, true) AS deleted FROM l",
    "state_overlay": f"""WITH {FILES}, {PRICED} SELECT doc_id, predicted, CASE WHEN doc_id % 11 = 3 THEN 'failed' WHEN doc_id % 7 = 2 THEN 'running' WHEN doc_id % 5 = 1 THEN 'queued' WHEN doc_id % 3 = 0 THEN 'analysing' ELSE state END AS shown_state,
  CASE WHEN doc_id % 11 = 3 THEN 'missing' END AS problem, CASE WHEN doc_id % 7 = 2 THEN (doc_id % 10)::DOUBLE / 10.0::DOUBLE END AS shown_fraction FROM r WHERE preset = 'balanced'""",
    "searchable_rows": f"WITH {CLASSED} SELECT source, count(*) FILTER (quality = 1 AND coalesce(toxic, 0) <> 1) AS n FROM k GROUP BY source",
    "committed_reruns": f"WITH {VERSIONS} SELECT run, pos, CASE WHEN compress = 'compressed' THEN before // 2 ELSE after END AS shipped, CASE WHEN compress = 'compressed' THEN after END AS previous, compress = 'noGain' AS futile FROM v",
    "futile_attempts": f"WITH {VERSIONS} SELECT run, pos, qty % 3 AS preset, searchable AS ocr FROM v WHERE NOT searchable",
    "page_rates": f"WITH {VERSIONS} SELECT run, pos, CASE WHEN qty <> 1 THEN before::DOUBLE / (qty - 1) END AS rate FROM v",
    "pending_totals": f"""WITH {FILES}, {PRICED} SELECT source, sum(size)::BIGINT AS input_bytes, count(size) AS sized, count(*) AS pending, CASE WHEN count(*) FILTER (is_fallback) = 0 THEN sum(predicted)::BIGINT END AS predicted_bytes FROM r WHERE preset = 'smallest' AND state IN ('queued', 'analysing') GROUP BY source""",
    "start_gate": f"WITH {CLASSED} SELECT source, bool_or(cls = 'cleanPending') AND bool_or(doc_id % 2 = 0) AND NOT bool_or(state = 'running') AND NOT bool_or(cls = 'problemUnresolved') AND source <> 'src3' AS can_start FROM k WHERE state <> 'running' AND problem IS NULL OR source = 'src5' GROUP BY source",
    "object_numbering": f"WITH {VERSIONS} SELECT run, pos, before, (3 + coalesce(sum(CASE WHEN searchable THEN 5 ELSE 3 END) OVER (PARTITION BY run ORDER BY pos, before, qty ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS first_object FROM v",
    "xref_runs": f"WITH {VERSIONS}, d AS (SELECT DISTINCT run, qty FROM v), g AS (SELECT run, qty, qty - row_number() OVER (PARTITION BY run ORDER BY qty) AS i FROM d) SELECT run, min(qty) AS first_number, count(*) AS size FROM g GROUP BY run, i",
    "extents": f"WITH {VERSIONS}, d AS (SELECT DISTINCT run, qty FROM v) SELECT run, qty, coalesce(lead(qty) OVER (PARTITION BY run ORDER BY qty), 1000) AS end_offset FROM d",
    "output_names": f"WITH {CLASSED}, d AS (SELECT doc_id, 'scan' || size % 97 AS base, row_number() OVER (PARTITION BY source, size % 97 ORDER BY doc_id) - 1 AS n FROM k) SELECT doc_id, base || '-small' || CASE WHEN n > 0 THEN '-' || n ELSE '' END || '.pdf' AS output_name FROM d",
    "page_sample": f"""WITH {CLASSED}, d AS (SELECT doc_id, pages::BIGINT AS n, doc_id % 6 AS k FROM f), e AS (SELECT doc_id, n, k, unnest(range(0, n)) AS page FROM d WHERE n > 0 AND k > 0),
g AS (SELECT *, page > 0 AND page <> n - 1 AND page % greatest(1, n // k) = 0 AS mid, sum(CASE WHEN page > 0 AND page <> n - 1 AND page % greatest(1, n // k) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page) AS rank FROM e)
SELECT doc_id, page FROM g WHERE k >= n OR (k = 1 AND page = 0) OR (k > 1 AND (page IN (0, n - 1) OR (mid AND rank <= k - 2)))""",
    "version_store": f"""WITH {VERSIONS} SELECT run, pos, before, CASE WHEN state = 'done' AND searchable THEN 'balanced' ELSE 'smallest' END AS preset, CASE WHEN state = 'done' THEN before END AS shown_before, CASE WHEN state = 'done' THEN after END AS shown_after,
  CASE WHEN pos % 2 = 1 THEN searchable END AS b, CASE WHEN pos % 2 = 0 THEN searchable ELSE true END AS a FROM v""",
    "queue_append": f"WITH {CLASSED} SELECT source, d.k AS \"drop\", count(*) AS n FROM k CROSS JOIN (VALUES (1), (2)) d(k) GROUP BY source, d.k",
    "change_quality": f"""WITH {VERSIONS} SELECT run, pos, CASE WHEN pos = 5 THEN 'Not included' WHEN qty % 3 = 0 THEN 'Redone from the original at 150 DPI' || CASE WHEN searchable THEN ' · about ' || greatest(1, round(qty / 8.0::DOUBLE * pos)::BIGINT) || CASE WHEN greatest(1, round(qty / 8.0::DOUBLE * pos)::BIGINT) = 1 THEN ' second' ELSE ' seconds' END ELSE '' END
  WHEN qty % 3 = 1 THEN 'Already on disk — swapped in immediately' ELSE 'Already optimised — nothing to change' END AS line, CASE WHEN after < before THEN 'less' WHEN after = before THEN 'what you have' ELSE 'for printing' END AS delta FROM v""",
}
