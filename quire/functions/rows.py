"""Column logic of queue rows: classes, problems, descriptions and gates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Messages of run-time failures and the problems they stand for, and the copy of each problem.
FAILURE_MESSAGES = {
    "The PDF is password-protected.": "locked",
    "The file could not be found.": "missing",
    "The PDF is damaged and cannot be read.": "unreadable",
}
PROBLEM_COPY = {
    "locked": "Needs a password to open",
    "missing": "Moved or renamed since you added it",
    "unreadable": "This file can't be read as a PDF",
}
FAILURE_NOTES = {"locked": "one was password-locked", "missing": "one had moved"}
DESCRIPTORS = {"vector": "text and vectors", "bare": "no text layer yet", "scan": "mostly photographs"}
ACCURATE_ONLY = ["zh-Hans", "ja-JP", "ko-KR"]


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The table's value of a key, null for others."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def partition_class(state: Column, problem: Column, skipped: Column) -> Column:
    """One of eight classes of a row; null flags count as false."""
    skip, bad = F.coalesce(skipped, F.lit(False)), problem.isNotNull()
    waiting = F.when(bad & skip, "problemSkipped").when(bad, "problemUnresolved").when(skip, "cleanSkipped").otherwise("cleanPending")
    return (
        F.when(state == "done", "delivered")
        .when(state == "failed", F.when(skip, "failedSkipped").otherwise("failedActionable"))
        .when(state.isin("queued", "analysing"), waiting)
        .when(state == "running", "transient")
    )


def content_class(text_pages: Column, image_pages: Column, two_tone: Column) -> Column:
    """Born digital where pages of text are at least as many as those of images; else by the tones of the scan."""
    return F.when((text_pages > 0) & (text_pages >= image_pages), "bornDigital").when(two_tone, "scanBilevel").otherwise("scanColour")


def pending(state: Column) -> Column:
    return state.isin("queued", "analysing")


def terminal(state: Column) -> Column:
    return state.isin("done", "failed")


def degraded(compress: Column, ocr: Column) -> Column:
    """Whether an outcome fell short; a null verb was off and never degrades."""
    return F.coalesce(compress == "skipped", F.lit(False)) | F.coalesce(ocr.isin("tooFaint", "cancelled", "failed"), F.lit(False))


def failure_problem(message: Column) -> Column:
    return lookup(message, FAILURE_MESSAGES)


def failure_note(problem: Column) -> Column:
    return F.coalesce(lookup(problem, FAILURE_NOTES), F.lit("one couldn't be read"))


def content_descriptor(content_type: Column, has_text: Column) -> Column:
    """Born-digital comes first, then a known absence of text, then the scans."""
    return (
        F.when(content_type == "bornDigital", DESCRIPTORS["vector"])
        .when(has_text == F.lit(False), DESCRIPTORS["bare"])
        .when(content_type.isin("scanColour", "scanBilevel", "mixedColour"), DESCRIPTORS["scan"])
    )


def row_description(problem: Column, pages: Column, descriptor: Column) -> Column:
    counted = F.concat(pages.cast("string"), F.when(pages == 1, " page").otherwise(" pages"))
    return F.coalesce(lookup(problem, PROBLEM_COPY), F.when(pages.isNull(), "").otherwise(F.concat_ws(", ", counted, descriptor)))


def clamp_accuracy(accuracy: Column, languages: Column) -> Column:
    """Fast reading of a language that only the accurate reader knows becomes accurate."""
    only = F.array(*map(F.lit, ACCURATE_ONLY))
    return F.when((accuracy == "fast") & F.coalesce(F.arrays_overlap(languages, only), F.lit(False)), "accurate").otherwise(accuracy)


def rerun_state(running: Column, excluded: Column, state: Column, compress: Column, recorded: Column, futile: Column, own_preset: Column, target: Column, previous_preset: Column, previous_exists: Column) -> Column:
    """none, futile, instantSwitch or armed: the first rule that holds decides."""
    no = F.lit(False)
    ready = (state == "done") & compress.isin("compressed", "noGain") & F.coalesce(recorded, no)
    return (
        F.when(F.coalesce(running, no) | F.coalesce(excluded, no) | ~F.coalesce(ready, no), "none")
        .when(F.coalesce(futile, no), "futile")
        .when(F.coalesce(own_preset == target, no), "none")
        .when(F.coalesce(previous_preset == target, no) & F.coalesce(previous_exists, no), "instantSwitch")
        .otherwise("armed")
    )


def ocr_outcome(recognised: Column, skipped: Column, pages: Column, runs: Column) -> Column:
    return F.when((recognised == 0) & (skipped == pages), "alreadySearchable").when((recognised > 0) & (runs == 0), "tooFaint").otherwise("added")


def made_searchable(shipped: Column, original: Column) -> Column:
    """The shipped flag is true and the original's is not; a missing flag is not true."""
    return shipped.eqNullSafe(F.lit(True)) & ~original.eqNullSafe(F.lit(True))


def consent(first: Column, second: Column) -> Column:
    """A pair of variants, one rebuilt and one plain, in either order."""
    return F.coalesce((F.least(first, second) == "mrc") & (F.greatest(first, second) == "plain"), F.lit(False))
