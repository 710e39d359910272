"""Column logic of texts: lossy characters, escapes, counts and labels."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LOSSY = r"[^\x20-\xFF\t]"
BLANKS = r"\x{0009}-\x{000D}\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE = f"[{BLANKS}]"

# The words of counts, deltas, mechanisms, batches and progress.
WORDS = {
    "same": "what you have", "less": " less", "more": " more", "print": "for printing", "unchanged": "no change",
    "redone": "Redone from the original at ", "instant": "Already on disk — swapped in immediately", "nothing": "Already optimised — nothing to change", "excluded": "Not included",
    "reading": "Reading page ", "of": " of ", "rebuilding": "Rebuilding scan…", "compressing": "Compressing…",
    "ocr": "OCR only", "all": "all searchable", "one": "one made searchable", "some": " made searchable", "attention": "some files needed attention",
}


def lossy(text: Column) -> Column:
    """Some character is outside 0x20 to 0xFF and no tab; a newline is."""
    return text.rlike(LOSSY)


def has_text(text: Column) -> Column:
    """Something is left after trimming Unicode blanks at both ends."""
    return F.coalesce(text.rlike(f"[^{BLANKS}]"), F.lit(False))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def escaped(text: Column) -> Column:
    """Backslash and parentheses escaped, a tab as a space, other characters outside 0x20 to 0xFF as '?'."""
    out = F.regexp_replace(text, r"([\\()])", r"\\$1")
    return F.regexp_replace(F.replace(out, F.lit("\t"), F.lit(" ")), r"[^\x20-\xFF]", "?")


def counted(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {noun}").otherwise(f" {noun}s"))


def display_title(success: Column, files: Column, folder: Column) -> Column:
    plain = F.concat(counted(files, "file"), F.lit(" in "), folder)
    return F.when(success < files, F.concat(success.cast("string"), F.lit(" of "), plain)).otherwise(plain)


def byte_text(n: Column) -> Column:
    """Decimal units with one place from a megabyte on; not any locale's formatter."""
    size = F.abs(n)
    return (
        F.when(size < 1000, F.format_string("%d bytes", n))
        .when(size < 1_000_000, F.format_string("%d KB", F.round(n / 1000).cast("long")))
        .when(size < 1_000_000_000, F.format_string("%.1f MB", n / 1_000_000))
        .otherwise(F.format_string("%.2f GB", n / 1_000_000_000))
    )


def saved_text(saved: Column) -> Column:
    return F.when(saved <= 0, WORDS["unchanged"]).otherwise(byte_text(saved))


def batch_subtitle(time: Column, compress_on: Column, preset: Column, ocr_on: Column, note: Column, problem: Column, searchable: Column, files: Column) -> Column:
    """The parts that apply, joined by a middle dot."""
    how = F.when(compress_on & preset.isNotNull(), preset).when(ocr_on, WORDS["ocr"])
    found = F.when(searchable == files, WORDS["all"]).when(searchable == 1, WORDS["one"]).otherwise(F.concat(searchable.cast("string"), F.lit(WORDS["some"])))
    end = F.when(note.isNotNull(), note).when(problem, WORDS["attention"]).when(searchable > 0, found)
    return F.concat_ws(" · ", time, how, end)


def day_label(day: Column, now: Column) -> Column:
    """TODAY, YESTERDAY or the date, relative to a given instant."""
    today = F.to_date(now)
    return F.when(day == today, "TODAY").when(day == F.date_sub(today, 1), "YESTERDAY").otherwise(F.upper(F.date_format(day, "d MMM yyyy")))


def breadcrumb(path: Column) -> Column:
    """The last two parts of a folder's path."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    n = F.size(parts)
    return F.when(n == 0, path).otherwise(F.concat_ws(" › ", F.slice(parts, F.greatest(n - 1, F.lit(1)), 2)))


def percent_text(size: Column, original: Column) -> Column:
    """Percent smaller or bigger, rounded half away from zero; 'same size' without an original."""
    ratio = F.try_divide(size.cast("double"), original.cast("double"))
    smaller = F.concat(F.round((1 - ratio) * 100).cast("long").cast("string"), F.lit("% smaller"))
    bigger = F.concat(F.round((ratio - 1) * 100).cast("long").cast("string"), F.lit("% bigger"))
    return F.when((original > 0) & (size < original), smaller).when((original > 0) & (size > original), bigger).otherwise("same size")


def delta_text(current: Column, candidate: Column, maximum: Column) -> Column:
    more = candidate - current
    return (
        F.when(more == 0, WORDS["same"]).when(more < 0, F.concat(byte_text(-more), F.lit(WORDS["less"])))
        .when(maximum, WORDS["print"]).otherwise(F.concat(byte_text(more), F.lit(WORDS["more"])))
    )


def mechanism_line(state: Column, dpi: Column, rate: Column, pages: Column, excluded: Column) -> Column:
    made = F.concat(F.lit(WORDS["redone"]), dpi.cast("string"), F.lit(" DPI"))
    seconds = F.greatest(F.lit(1).cast("long"), F.round(rate * pages).cast("long"))
    timed = F.when(rate.isNotNull() & (pages > 0), F.concat(made, F.lit(" · about "), counted(seconds, "second"))).otherwise(made)
    return (
        F.when(excluded, WORDS["excluded"]).when(state == "armed", timed)
        .when(state == "instantSwitch", WORDS["instant"]).otherwise(WORDS["nothing"])
    )


def reading_label(fraction: Column, pages: Column) -> Column:
    """The page that a fraction of a document's pages has come to, from one to the last."""
    page = F.least(pages, F.greatest(F.lit(1).cast("long"), F.round(fraction * pages).cast("long")))
    return F.concat(F.lit(WORDS["reading"]), page.cast("string"), F.lit(WORDS["of"]), pages.cast("string"))


def leg_label(fraction: Column, rebuild: Column) -> Column:
    """A row that is rebuilt says so from 0.45 on."""
    return F.when((fraction >= 0.45) & rebuild, WORDS["rebuilding"]).otherwise(WORDS["compressing"])


def runs(text: Column) -> Column:
    """The lines of a text that have something in them; null if there is none, or one of them is lossy."""
    lines = F.filter(F.split(text, "\n"), has_text)
    return F.when((F.size(lines) > 0) & ~F.exists(lines, lossy), lines)


def tail_lines(text: Column, n: int = 2) -> Column:
    """The last n lines that are not blank, trimmed, joined by a space."""
    parts = F.filter(F.transform(F.split(text, r"\r\n|[\n\r]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.concat_ws(" ", F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n))


def error_tail(out: Column, err: Column, most: int = 300) -> Column:
    """The tails of both streams, cut to `most` characters."""
    both = F.array_compact(F.array(*(F.nullif(tail_lines(F.coalesce(x, F.lit(""))), F.lit("")) for x in (err, out))))
    return F.left(F.concat_ws(" ", both), F.lit(most))


def _clusters(text: str) -> list[str]:
    """Base characters with the combining marks and joiners that follow them."""
    out: list[str] = []
    for c in text:
        if out and (unicodedata.combining(c) or c in "‍️" or out[-1].endswith("‍")):
            out[-1] += c
        else:
            out.append(c)
    return out


def utf8_budget(text: Column, budget: int) -> Column:
    """The text without as many last characters (with their marks) as put it over a budget of UTF-8 bytes."""

    @F.pandas_udf("string")
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(t: str | None) -> str | None:
            if t is None or len(t.encode()) <= budget:
                return t
            size, kept = 0, []
            for c in _clusters(t):
                size += len(c.encode())
                if size > budget:
                    break
                kept.append(c)
            return "".join(kept)

        for part in parts:
            yield part.map(one, na_action="ignore")

    return F.when(F.octet_length(text) <= budget, text).otherwise(cut(text))


def reservation_key(path: Column) -> Column:
    """The path in canonical composition and lower case."""

    @F.pandas_udf("string")
    def composed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    ascii_only = F.octet_length(path) == F.char_length(path)
    return F.lower(F.when(ascii_only, path).otherwise(composed(path)))
